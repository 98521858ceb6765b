"""Passages that repeat across a corpus: what substring removal has in common.

A window is ``span`` consecutive units (words or bytes) of one text. Equal windows
choose the same anchor: the rightmost smallest hash among their q-grams. So only
anchors are shuffled, one for some tens of units, and only passages around anchors
that stand in two places are ever cut out of their texts. A bucket is all distinct
passages with one anchor hash; an operator's own method decides within buckets.

Equal texts are treated once: tables are keyed by two independent 64-bit hashes of
the text's SHA-256.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut, named, row_of, stored, tidy, with_fields

#: Units hashed at a time; an anchor's place takes 20 bits beside its hash.
BLOCK = 1 << 17
#: Distinct passages of one anchor that a bucket holds. Larger buckets are refined: their
#: passages are cut into pieces of so many windows, and the pieces put in buckets again.
BUCKET, STEPS = 1024, (16, 1)
#: Bytes of distinct passages that one shard of buckets holds.
SHARD_BYTES = 1 << 19
#: Bytes of passages that a worker holds before it hands them on.
FLUSH_BYTES = 4 << 20
#: Ranks after every other id: where a document has none.
NO_ID = (1 << 63) - 1

_C1, _C2, _S = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xBF58476D1CE4E5B9), np.uint64(29)
_PLACE = np.uint64((1 << 20) - 1)
RUNS = "array<struct<first:int,last:int,value:bigint>>"


def mix(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """64-bit hashes of pairs of hashes."""
    x = a * _C1
    x += b
    x ^= x >> _S
    x *= _C2
    x ^= x >> _S
    return x


def two_longs(data: bytes) -> tuple[int, int]:
    """A 128-bit digest as two signed longs."""
    h = xxhash.xxh3_128_intdigest(data)
    return (h >> 64) - (1 << 63), (h & ((1 << 64) - 1)) - (1 << 63)


def lists(column: pa.ListArray, fields: tuple[str, ...]) -> Iterator[list[np.ndarray] | None]:
    """The fields of each row's list of structs, as arrays; None where the list is null."""
    if not len(column):
        return
    offsets = column.offsets.to_numpy()
    values = column.values
    flat = [values.field(f).to_numpy(zero_copy_only=False) for f in fields]
    valid = column.is_valid().to_numpy(zero_copy_only=False)
    for ok, a, b in zip(valid.tolist(), offsets[:-1].tolist(), offsets[1:].tolist(), strict=True):
        yield [x[a:b] for x in flat] if ok else None


@dataclass(frozen=True)
class Units:
    """How texts are cut into units. ``span`` units make a window, ``q`` a q-gram."""

    span: int
    q: int
    #: UTF-8 bytes as a sequence of units: themselves, or the list of words.
    split: Callable[[bytes], bytes | list[bytes]]
    #: Hashes of the q-grams of such a sequence.
    grams: Callable[[bytes | list[bytes]], np.ndarray]
    #: The bytes of such a sequence.
    join: Callable[[bytes | list[bytes]], bytes]


def window_anchors(grams: np.ndarray, ends: np.ndarray, span: int, q: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Anchors of all windows: place, first and last window that choose it.

    ``ends[i]`` is where the text that holds unit i ends; windows don't cross it.
    """
    width, n = span - q + 1, len(ends) - span + 1
    none = np.empty(0, np.int64)
    if n <= 0:
        return none, none, none
    at = np.arange(len(grams), dtype=np.uint64)
    key = (grams & ~_PLACE) | (_PLACE - at)
    pad = -len(key) % width
    if pad:
        key = np.concatenate([key, np.full(pad, ~np.uint64(0))])
    block = key.reshape(-1, width)
    ahead = np.minimum.accumulate(block[:, ::-1], axis=1)[:, ::-1].ravel()
    behind = np.minimum.accumulate(block, axis=1).ravel()
    least = np.minimum(ahead[:n], behind[width - 1 : width - 1 + n])
    anchor = (_PLACE - (least & _PLACE)).astype(np.int64)
    starts = np.flatnonzero(np.arange(n) + span <= ends[:n])
    if not len(starts):
        return none, none, none
    chosen = anchor[starts]
    new = np.flatnonzero(np.concatenate([[True], chosen[1:] != chosen[:-1]]))
    last = np.concatenate([new[1:], [len(starts)]]) - 1
    return chosen[new], starts[new], starts[last]


def _anchor_batches(units: Units) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def block_anchors(block: list[tuple[int, int, np.ndarray, int]], found: dict[int, list]) -> None:
        """block: row, units before the segment in its text, its grams, its units."""
        sizes = [n for *_, n in block]
        bounds = np.cumsum([0, *sizes])
        grams = np.zeros(bounds[-1], np.uint64)
        for (_, _, g, _), b in zip(block, bounds[:-1], strict=True):
            grams[b : b + len(g)] = g
        places, lo, hi = window_anchors(grams[: max(0, len(grams) - units.q + 1)], np.repeat(bounds[1:], sizes), units.span, units.q)
        cuts = np.searchsorted(lo, bounds)
        for k, (row, before, _, _) in enumerate(block):
            s = slice(cuts[k], cuts[k + 1])
            if s.start < s.stop:
                found.setdefault(row, []).append((grams[places[s]], lo[s] - bounds[k] + before, hi[s] - bounds[k] + before))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found: dict[int, list] = {}
            block: list[tuple[int, int, np.ndarray, int]] = []
            held = 0
            for row, t in enumerate(batch.column("text")):
                sequence = units.split((t.as_py() or "").encode())
                n = len(sequence)
                for before in range(0, n - units.span + 1, BLOCK):
                    part = min(n - before, BLOCK + units.span - 1)
                    if held + part > 2 * BLOCK - 1:
                        block_anchors(block, found)
                        block, held = [], 0
                    block.append((row, before, units.grams(sequence[before : before + part]), part))
                    held += part
            if block:
                block_anchors(block, found)
            if not found:
                continue
            rows = sorted(found)
            per = [[np.concatenate(x) for x in zip(*found[r], strict=True)] for r in rows]
            all_keys, owner = np.concatenate([p[0] for p in per]), np.repeat(np.arange(len(per)), [len(p[0]) for p in per])
            order = np.lexsort((all_keys, owner))
            same = (np.diff(all_keys[order].view(np.int64)) == 0) & (np.diff(owner[order]) == 0)
            again = np.zeros(len(order), bool)
            again[order[1:][same]] = again[order[:-1][same]] = True
            offsets = pa.array(np.cumsum([0, *(len(p[0]) for p in per)]), pa.int32())
            as_list = lambda parts, kind: pa.ListArray.from_arrays(offsets, pa.array(np.concatenate(parts).astype(kind)))
            lists = [as_list([p[0].view(np.int64) for p in per], np.int64), as_list([p[1] for p in per], np.int32), as_list([p[2] for p in per], np.int32), as_list([again], bool)]
            taken = batch.take(pa.array(rows))
            yield pa.RecordBatch.from_arrays([taken.column("doc"), taken.column("d1"), taken.column("d2"), *lists], ["doc", "d1", "d2", "keys", "lo", "hi", "again"])

    return run


def keyed(docs: DataFrame, text: str, id_col: str, carry: list[str]) -> DataFrame:
    """doc (NO_ID where null), text (empty where null), absent (whether it was null),
    the text's two hashes, ``row`` with the columns to carry."""
    t = F.coalesce(named(text), F.lit(""))
    sha = F.sha2(t, 256)
    return docs.select(row_of(carry), F.coalesce(named(id_col).cast("bigint"), F.lit(NO_ID)).alias("doc"), t.alias("text"), named(text).isNull().alias("absent"), F.xxhash64(sha).alias("d1"), F.xxhash64(F.lit(7), sha).alias("d2"))


def anchor_table(rows: DataFrame, units: Units) -> DataFrame:
    """One row for each distinct text that has a window: its anchors, smallest id, copies."""
    found = rows.select("doc", "text", "d1", "d2").mapInArrow(_anchor_batches(units), "doc bigint, d1 bigint, d2 bigint, keys array<bigint>, lo array<int>, hi array<int>, again array<boolean>")
    grouped = found.groupBy("d1", "d2").agg(F.min("doc").alias("min_doc"), F.count(F.lit(1)).alias("copies"), F.first(F.struct("keys", "lo", "hi", "again")).alias("a"))
    return stored(grouped.select("d1", "d2", "min_doc", "copies", "a.*"))


def passage_table(rows: DataFrame, anchors: DataFrame, units: Units, across: bool = False) -> DataFrame:
    """Passages around anchors that stand in two places (``across``: in two texts), one row
    for each place."""
    each = anchors.select("d1", "d2", F.inline(F.arrays_zip("keys", "lo", "hi", "again"))).withColumnRenamed("keys", "key")
    two = each.groupBy("key").agg(F.min("d1").alias("a"), F.max("d1").alias("b"), F.max("again").alias("again"))
    two = cut(two.filter("a <> b" if across else "a <> b OR again").select("key"))  # so that a hot key's side of the join can be split
    shared = each.drop("again").join(two, "key").groupBy("d1", "d2").agg(F.collect_list(F.struct("key", "lo", "hi")).alias("places"))
    shared = shared.join(anchors.select("d1", "d2", F.col("min_doc").alias("doc"), "copies"), ["d1", "d2"])
    texts = rows.select("doc", "text", "d1", "d2").join(shared, ["d1", "d2", "doc"])

    names = ["d1", "d2", "doc", "copies", "lo", "key", "p1", "p2", "passage"]
    kinds = [pa.int64()] * 4 + [pa.int32()] + [pa.int64()] * 3 + [pa.binary()]

    def batch_of(out: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out, strict=True), kinds, strict=True)], names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out: list[tuple] = []
        size = 0
        for batch in batches:
            fixed_ = zip(*(batch.column(c).to_pylist() for c in ("d1", "d2", "doc", "copies")), strict=True)
            for fixed, t, places in zip(fixed_, batch.column("text"), lists(batch.column("places"), ("key", "lo", "hi")), strict=True):
                sequence = units.split(t.as_py().encode())
                for key, lo, hi in zip(*(x.tolist() for x in places), strict=True):
                    passage = units.join(sequence[lo : hi + units.span])
                    out.append((*fixed, lo, key, *two_longs(passage), passage))
                    size += len(passage)
                    if size > FLUSH_BYTES:
                        yield batch_of(out)
                        out, size = [], 0
        if out:
            yield batch_of(out)
        tidy()

    found = texts.mapInArrow(run, "d1 bigint, d2 bigint, doc bigint, copies bigint, lo int, key bigint, p1 bigint, p2 bigint, passage binary")
    return stored(found)


def _pieces(units: Units, step: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Cut passages of crowded buckets into pieces of up to ``step`` windows.

    Equal windows stand at one distance from their anchor, so in pieces of one number,
    and have the units in common that all windows of such a piece share. Bucket, number
    and these units make up a piece's own bucket.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[list] = [[] for _ in PIECES]
            size = 0
            for doc, copies, p1, p2, key, anchor, passage in zip(*(batch.column(c).to_pylist() for c in ("doc", "copies", "p1", "p2", "key", "anchor", "passage")), strict=True):
                sequence = units.split(passage)
                n = len(sequence) - units.span + 1
                if anchor is None:  # the bucket's name is the anchor's hash
                    anchor = int(np.flatnonzero(units.grams(sequence)[: units.span - units.q + 1].view(np.int64) == key)[-1])
                for number in range(-anchor // step, (n - 1 - anchor) // step + 1):
                    start = anchor + number * step
                    first, last = max(0, start), min(n, start + step)
                    piece = units.join(sequence[first : last - 1 + units.span])
                    common = sequence[start + step - 1 : start + units.span] if step <= units.span else sequence[:0]
                    bucket = two_longs(b"%d %d " % (key, number) + units.join(common))[0]
                    for column, v in zip(out, (doc, copies, p1, p2, first, bucket, *two_longs(piece), anchor - first, piece), strict=True):
                        column.append(v)
                    size += len(piece)
                if size > FLUSH_BYTES:
                    yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(out, PIECES.values(), strict=True)], list(PIECES))
                    out, size = [[] for _ in PIECES], 0
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(out, PIECES.values(), strict=True)], list(PIECES))
        tidy()

    return run


#: Columns of a piece: of its passage, its first window there, and its own; ``anchor`` is its anchor's place in it.
PIECES = dict.fromkeys(("doc", "copies", "p1", "p2"), pa.int64()) | {"at": pa.int32(), "key": pa.int64(), "q1": pa.int64(), "q2": pa.int64(), "anchor": pa.int32(), "passage": pa.binary()}


def resolved(places: DataFrame, decide: Callable[..., tuple[np.ndarray, ...]], units: Units, total: Callable[[str], F.Column] = F.sum) -> DataFrame:
    """Runs of windows and their values, for each distinct passage: p1, p2, runs.

    ``decide`` gets whole buckets as keys, passages, smallest ids, places (the ``total``
    of copies), and a number that tells calls apart, and returns runs of window offsets,
    those to keep only, as passage (its place among them, ascending), first, last and value.
    """
    distinct = places.groupBy("key", "p1", "p2", "passage").agg(F.min("doc").alias("doc"), total("copies").alias("copies"))
    distinct = stored(distinct.withColumn("anchor", F.lit(None).cast("int")))
    return _resolved(distinct, decide, units, STEPS, total)


def _resolved(distinct: DataFrame, decide: Callable, units: Units, steps: tuple[int, ...], total: Callable[[str], F.Column]) -> DataFrame:
    """Decide on buckets; crowded ones are refined to buckets of pieces first, by ``steps``.

    Pieces of one window have buckets that hold nothing but that window, so the last
    step leaves none crowded.
    """
    spark = distinct.sparkSession
    size = distinct.agg(F.sum(F.octet_length("passage"))).first()[0] or 0
    shards = max(int(spark.conf.get("spark.sql.shuffle.partitions")), size // SHARD_BYTES)
    level = len(steps)

    def shard(table: pa.Table) -> pa.Table:
        table = table.sort_by([("key", "ascending"), ("p1", "ascending")])
        numbers = [table[c].to_numpy() for c in ("key", "doc", "copies")]
        row, first, last, value = decide(numbers[0], table["passage"].to_pylist(), *numbers[1:], level << 28 | table["shard"][0].as_py())
        own, at = np.unique(row, return_index=True)
        runs = pa.StructArray.from_arrays([pa.array(first.astype(np.int32)), pa.array(last.astype(np.int32)), pa.array(value.astype(np.int64))], ["first", "last", "value"])
        out = pa.table({c: table[c].take(pa.array(own)) for c in ("p1", "p2")} | {"runs": pa.ListArray.from_arrays(pa.array(np.append(at, len(row)).astype(np.int32)), runs)})
        tidy()
        return out

    bounded, crowded = distinct, None
    if steps:
        crowded = cut(distinct.groupBy("key").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") > BUCKET).select("key"))
        if crowded.isEmpty():
            crowded = None
        else:
            bounded = distinct.join(crowded, "key", "left_anti")
    sharded = bounded.withColumn("shard", F.pmod(F.xxhash64("key"), F.lit(shards)).cast("int"))
    small = sharded.groupBy("shard").applyInArrow(shard, f"p1 bigint, p2 bigint, runs {RUNS}")
    if crowded is None:
        return small
    pieces = stored(distinct.join(crowded, "key").mapInArrow(_pieces(units, steps[0]), "doc bigint, copies bigint, p1 bigint, p2 bigint, at int, key bigint, q1 bigint, q2 bigint, anchor int, passage binary"))
    own = stored(pieces.groupBy("key", "q1", "q2", "passage").agg(F.min("doc").alias("doc"), total("copies").alias("copies"), F.first("anchor").alias("anchor")).withColumnsRenamed({"q1": "p1", "q2": "p2"}))
    inner = cut(_resolved(own, decide, units, steps[1:], total)).withColumnsRenamed({"p1": "q1", "p2": "q2"})
    each = pieces.select("p1", "p2", "at", "q1", "q2").join(inner, ["q1", "q2"]).select("p1", "p2", "at", F.inline("runs"))
    moved = F.struct((F.col("at") + F.col("first")).alias("first"), (F.col("at") + F.col("last")).alias("last"), "value")
    return small.unionAll(each.groupBy("p1", "p2").agg(F.collect_list(moved).alias("runs")))


def located(places: DataFrame, runs: DataFrame, keep: F.Column) -> DataFrame:
    """Windows that are kept, for each distinct text: d1, d2, copies, windows (first and
    last start, value)."""
    each = places.select("d1", "d2", "copies", "doc", "lo", "p1", "p2").join(runs, ["p1", "p2"]).select("d1", "d2", "copies", "doc", "lo", F.inline("runs"))
    window = F.struct((F.col("lo") + F.col("first")).alias("first"), (F.col("lo") + F.col("last")).alias("last"), "value")
    return each.filter(keep).groupBy("d1", "d2").agg(F.first("copies").alias("copies"), F.collect_list(window).alias("windows"))


def covered(windows: list[np.ndarray] | None, span: int) -> list[tuple[int, int]]:
    """Maximal runs [from, to) of units that windows, given by first and last starts, cover."""
    if windows is None or not len(windows[0]):
        return []
    order = np.argsort(windows[0], kind="stable")
    first, end = windows[0][order], np.maximum.accumulate(windows[1][order]) + span
    new = np.flatnonzero(np.concatenate([[True], first[1:] > end[:-1]]))
    return list(zip(first[new].tolist(), end[np.append(new[1:], len(end)) - 1].tolist(), strict=True))


def without(rows: DataFrame, anchors: DataFrame, windows: DataFrame, units: Units, whole: F.Column, with_kept: bool, shorter: DataFrame | None = None, shorter_span: int = 0) -> DataFrame:
    """Each row's n_units, n_removed, n_spans, kept_sha256 and, if asked for, the kept text.

    The digest is of the kept bytes, those of a null text are none; in the text a character that a cut goes through
    is left out.

    ``whole`` says of a row with doc, min_doc and copies that all its windows go.
    n_shorter is what ``shorter`` windows of ``shorter_span`` units cover; null if not given.
    """
    marks = anchors.select("d1", "d2", "min_doc", "copies").join(windows.select("d1", "d2", "windows"), ["d1", "d2"], "left")
    other = F.lit(None).cast("array<struct<first:int,last:int>>")
    if shorter is not None:
        marks, other = marks.join(shorter.select("d1", "d2", F.col("windows").alias("shorter")), ["d1", "d2"], "left"), F.col("shorter")
    marks = marks.withColumn("shorter", other)
    marked = rows.join(marks, ["d1", "d2"], "left").select("row", "text", "absent", F.coalesce(whole, F.lit(False)).alias("whole"), "windows", "shorter")
    return cut_out(marked, units, with_kept, shorter is not None, shorter_span)


def cut_out(marked: DataFrame, units: Units, with_kept: bool, asked: bool = False, shorter_span: int = 0) -> DataFrame:
    """What ``without`` returns, of rows with row, text, absent, whole, windows and shorter."""
    names = ["n_units", "n_removed", "n_spans", "kept_sha256", "kept", "n_shorter"]
    kinds = [pa.int64()] * 3 + [pa.string(), pa.string(), pa.int64()]

    def covers(all_: bool, found: list[np.ndarray] | None, n: int, span: int) -> list[tuple[int, int]]:
        return ([(0, n)] if n >= span else []) if all_ else covered(found, span)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[list] = [[] for _ in names]
            flags = zip(batch.column("absent").to_pylist(), batch.column("whole").to_pylist(), strict=True)
            windows_ = zip(*(lists(batch.column(c), ("first", "last")) for c in ("windows", "shorter")), strict=True)
            for t, (absent, all_), (found, less) in zip(batch.column("text"), flags, windows_, strict=True):
                data = t.as_py().encode()
                sequence = units.split(data)
                n = len(sequence)
                spans = covers(all_, found, n, units.span)
                n_shorter = sum(b - a for a, b in covers(all_, less, n, shorter_span)) if asked else None
                kept = sequence[:0]
                for a, b in zip([0, *(b for _, b in spans)], [*(a for a, _ in spans), n], strict=True):
                    kept += sequence[a:b]
                kept = units.join(kept)
                for column, v in zip(out, (n, sum(b - a for a, b in spans), len(spans), hashlib.sha256(kept).hexdigest(), kept.decode("utf-8", "ignore") if with_kept and not absent else None, n_shorter), strict=True):
                    column.append(v)
            yield pa.RecordBatch.from_arrays([batch.column("row"), *(pa.array(c, k) for c, k in zip(out, kinds, strict=True))], ["row", *names])

    return marked.mapInArrow(run, with_fields(marked, ["row"], "n_units bigint, n_removed bigint, n_spans bigint, kept_sha256 string, kept string, n_shorter bigint"))
