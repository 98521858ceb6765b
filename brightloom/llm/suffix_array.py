"""Removal of repeated byte strings by bucket-pointer refinement.

Passages around shared anchors (``passages``) are put in buckets by anchor hash, so
equal strings are always in one shard. A shard sorts the suffixes of its passages:
initial buckets are q-grams of 8 bytes, and a bucket is refined by sorting on the
bucket identifiers that its suffixes have d bytes on. Refined identifiers are the
pointers of the next round, so the depth doubles: 8, 16, ... 128, and 200 as
128 + 64 + 8. Buckets of one suffix are final and leave the sort.

The last round goes over the corpus: strings of 400 bytes are pairs of pointers to
strings of 200, those at their start and 200 bytes on.
"""

from __future__ import annotations

import dataclasses
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from . import passages
from .common import cut, read_table, stored
from .passages import Units, mix

SPAN = 400
#: Bytes of repeated strings that are counted too, and that strings of SPAN bytes are refined from: most
#: passages of fifty words have more than these, about half of them less than SPAN.
SHORTER = 200


def _grams8(data: bytes, order: str) -> np.ndarray:
    n = len(data)
    out, padded = np.zeros(max(0, n - 7), np.uint64), data + b"\0" * 8
    for k in range(min(8, len(out))):
        out[k::8] = np.frombuffer(padded, f"{order}u8", -(-(len(out) - k) // 8), k)
    return out


def _grams(data: bytes) -> np.ndarray:
    """Hashes of the 32-byte q-grams."""
    g = _grams8(data, "<")
    for d in (8, 16):
        g = mix(g[:-d], g[d:])
    return g


def byte_units(span: int = SPAN) -> Units:
    if span < 33:
        raise ValueError("spans of less than 33 bytes have no anchor")
    return Units(span, 32, bytes, _grams, bytes)


def named(keys: np.ndarray) -> tuple[np.ndarray, int]:
    """A number for each distinct key, and how many there are."""
    order = np.argsort(keys)
    ordered = keys[order]
    out = np.empty(len(keys), np.int32)
    out[order] = np.cumsum(np.concatenate([[0], ordered[1:] != ordered[:-1]]))[: len(keys)]
    return out, int(out.max(initial=-1)) + 1


def refine(ids: np.ndarray, valid: np.ndarray, offset: int, pointers: np.ndarray, buckets: int) -> tuple[np.ndarray, int]:
    """Refine the buckets of ``valid`` suffixes by sorting on their pointers at an offset.

    Suffixes alone in their bucket are final. Returns new identifiers (those of
    refined suffixes are new) and their bound.
    """
    sizes = np.bincount(ids, minlength=buckets)
    active = valid[sizes[ids[valid]] > 1]
    if not len(active):
        return ids, buckets
    names, n = named(ids[active].astype(np.int64) * buckets + pointers[active + offset])
    refined = ids.copy()
    refined[active] = buckets + names
    return refined, buckets + n


def initial(data: bytes, at: np.ndarray, ends: np.ndarray, q: int) -> tuple[np.ndarray, int]:
    """Buckets of the q-grams that begin at each place, those cut off in one of their own.

    Buckets of 32 bytes come from a sort of 64-bit hashes, and all that one holds is
    compared; if hashes ever clash, buckets of 8 bytes are refined instead.
    """
    eight = _grams8(data, ">")
    ids, whole = np.zeros(len(data), np.int32), max(0, len(data) - q + 1)
    if q == 8:
        ids[:whole], n = named(eight)
    else:
        keys = _grams(data)[:whole]
        ids[:whole], n = named(keys)
        order = np.argsort(ids[:whole], kind="stable")
        left, right = order[:-1], order[1:]
        same = ids[left] == ids[right]
        left, right = left[same], right[same]
        if any((eight[left + d] != eight[right + d]).any() for d in range(0, q, 8)):
            ids, n = initial(data, at, ends, 8)
            for d in (8, 16):
                ids, n = refine(ids, np.flatnonzero(at + 2 * d <= len(data)), d, ids, n)
            return ids, n
    ids[whole:] = n
    return ids, n + 1


def pointers(texts: list[bytes], span: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of all texts joined: the places where a string of ``span`` bytes of one text starts,
    the first place of each one's final bucket, and whether the bucket has another."""
    sizes = np.array([len(t) for t in texts])
    ends = np.repeat(np.cumsum(sizes).astype(np.int32), sizes)
    at = np.arange(len(ends), dtype=np.int32)
    q = 32 if span >= 32 else 8
    ids, buckets = initial(b"".join(texts), at, ends, q)
    levels, depth = {q: ids}, q
    while depth * 2 <= span:
        levels[2 * depth], buckets = refine(levels[depth], np.flatnonzero(at + 2 * depth <= ends), depth, levels[depth], buckets)
        depth *= 2
        if depth // 2 > q and not span & (depth // 2):
            levels.pop(depth // 2)
    ids, windows = levels[depth], np.flatnonzero(at + span <= ends)
    while depth < span:
        step = max((d for d in levels if d <= span - depth), default=0)
        if not step:  # what is left is shorter than the initial q-grams: let them overlap
            step, depth = q, span - q
        ids, buckets = refine(ids, windows, depth, levels[step], buckets)
        depth += step
    own = ids[windows]
    least = np.zeros(buckets, np.int64)
    least[own[::-1]] = windows[::-1]
    return windows, least[own], np.bincount(own, minlength=buckets)[own] > 1


def repeated(texts: list[bytes], span: int) -> list[np.ndarray]:
    """For each text, whether the string of ``span`` bytes at each place starts elsewhere too."""
    windows, _, twice = pointers(texts, span)
    return np.split(twice, np.searchsorted(windows, np.cumsum([len(t) for t in texts]))[:-1])


def _shared(first: np.ndarray, owner: np.ndarray, low: np.ndarray, high: np.ndarray) -> np.ndarray:
    """Whether the final bucket of each string has strings of two texts; ``low`` and ``high``
    are the smallest and largest text of each passage."""
    size, ends = first.max(initial=-1) + 1, np.iinfo(np.int64)
    least, most = np.full(size, ends.max), np.full(size, ends.min)
    np.minimum.at(least, first, low[owner])
    np.maximum.at(most, first, high[owner])
    return (least < most)[first]


def _decide(span: int, across: bool = False):
    def decide(keys: np.ndarray, passages_: list[bytes], docs: np.ndarray, copies: np.ndarray, number: int) -> tuple[np.ndarray, ...]:
        """Runs of strings that stand in two places; values are pointers, equal for equal strings
        only, and count up along a run. A passage alone in its bucket has no two equal strings.

        With ``across``, of strings that stand in two texts: ``docs`` and ``copies`` are then
        the smallest and the largest text that has the passage."""
        sizes = np.array([len(p) for p in passages_])
        starts = np.cumsum([0, *sizes])[:-1]
        _, at, counts = np.unique(keys, return_inverse=True, return_counts=True)
        alone = counts[at] == 1
        whole = np.flatnonzero(alone & (copies > docs if across else copies > 1))
        out = [np.stack([whole, np.zeros_like(whole), sizes[whole] - span, starts[whole]])]
        sort = np.flatnonzero(~alone)
        if len(sort):
            ends = np.cumsum(sizes[sort])
            windows, first, twice = pointers([passages_[i] for i in sort], span)
            owner = np.searchsorted(ends, windows, "right")
            keep = _shared(first, owner, docs[sort], copies[sort]) if across else twice | (copies[sort][owner] > 1)
            windows, first, owner = windows[keep], first[keep], owner[keep]
            # from places in what was sorted to places in all passages of the call
            shift = starts[sort] - (ends - sizes[sort])
            value = first + shift[np.searchsorted(ends, first, "right")]
            cut_ = np.flatnonzero((np.diff(windows) != 1) | (np.diff(value) != 1) | (np.diff(owner) != 0)) + 1
            if len(windows):
                a, z = np.concatenate([[0], cut_]), np.concatenate([cut_, [len(windows)]]) - 1
                begin = (ends - sizes[sort])[owner[a]]
                out.append(np.stack([sort[owner[a]], windows[a] - begin, windows[z] - begin, value[a]]))
        found = np.concatenate(out, axis=1)
        row, first, last, value = found[:, np.argsort(found[0], kind="stable")]
        return row, first, last, (number << 32) + value

    return decide


def _later(offset: int):
    """Strings of which both the one at their start and the one ``offset`` bytes on repeat."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[np.ndarray] = []
            for row, (first, last, value) in enumerate(passages.lists(batch.column("windows"), ("first", "last", "value"))):
                order = np.argsort(first)
                first, last, value = first[order].astype(np.int64), last[order].astype(np.int64), value[order]
                at = np.unique(np.concatenate([first, last + 1, first - offset, last + 1 - offset]))
                stop = at[1:]
                i, j = np.searchsorted(first, at[:-1], "right") - 1, np.searchsorted(first, at[:-1] + offset, "right") - 1
                both = (i >= 0) & (j >= 0) & (at[:-1] <= last[i]) & (at[:-1] + offset <= last[j])
                at, stop, i, j = at[:-1][both], stop[both], i[both], j[both]
                a, b = value[i] + at - first[i], value[j] + at + offset - first[j]
                out.append(np.stack([np.full(len(at), row), at, a, b - a, stop - at]))
            found = np.concatenate([*out, np.empty((5, 0), np.int64)], axis=1)
            columns = [*(batch.column(c).take(pa.array(found[0])) for c in ("d1", "d2", "copies")), pa.array(found[1].astype(np.int32)), pa.array(found[2]), pa.array(found[3]), pa.array(found[4].astype(np.int32))]
            yield pa.RecordBatch.from_arrays(columns, ["d1", "d2", "copies", "first", "value", "apart", "n"])

    return run


#: Pointers that one cell counts places of, as a power of two.
_CELL = 12


def refined(windows: DataFrame, offset: int) -> DataFrame:
    """Windows of repeated strings that are ``offset`` bytes longer: d1, d2, windows.

    ``windows`` has the pointers of the shorter strings, as ``located`` returns them. A
    longer string is known by two of them: at its start and ``offset`` bytes on. Runs of
    such pairs lie on lines of one difference; pairs that two places have are where runs
    overlap, counted in cells of a line.
    """
    pairs = windows.select("d1", "d2", "copies", "windows").mapInArrow(_later(offset), "d1 bigint, d2 bigint, copies bigint, first int, value bigint, apart bigint, n int")
    cell = F.explode(F.sequence(F.shiftright("value", _CELL), F.shiftright(F.col("value") + F.col("n") - 1, _CELL))).alias("cell")
    base = F.shiftleft("cell", _CELL)
    each = pairs.select("*", cell)
    each = stored(each.select("d1", "d2", "copies", "apart", "cell", (F.col("first") + F.greatest(F.lit(0), base - F.col("value"))).cast("int").alias("first"), F.greatest(F.lit(0), F.col("value") - base).cast("int").alias("a"), F.least(F.lit((1 << _CELL) - 1), F.col("value") - base + F.col("n") - 1).cast("int").alias("z")))
    ends = each.groupBy("apart", "cell", "a", "z").agg(F.sum("copies").alias("n")).select("apart", "cell", F.inline(F.array(F.struct(F.col("a").alias("x"), F.col("n")), F.struct((F.col("z") + 1).alias("x"), (-F.col("n")).alias("n")))))
    ends = ends.groupBy("apart", "cell", "x").agg(F.sum("n").alias("n"))
    line = Window.partitionBy("apart", "cell").orderBy("x")
    over = ends.select("apart", "cell", "x", F.lead("x").over(line).alias("stop"), F.sum("n").over(line).alias("places")).filter("places > 1")
    over = cut(over.groupBy("apart", "cell").agg(F.collect_list(F.struct("x", (F.col("stop") - 1).alias("z"))).alias("over")))
    twice = each.join(over, ["apart", "cell"]).select("d1", "d2", "first", "a", "z", F.explode("over").alias("o")).filter("o.x <= z AND o.z >= a")
    moved = F.struct((F.col("first") + F.greatest(F.col("o.x"), F.col("a")) - F.col("a")).alias("first"), (F.col("first") + F.least(F.col("o.z"), F.col("z")) - F.col("a")).alias("last"))
    return twice.groupBy("d1", "d2").agg(F.collect_list(moved).alias("windows"))


def remove_repeats(docs: DataFrame, span: int = SPAN, text: str = "text", id_col: str = "doc_id", carry: list[str] | None = None, with_kept: bool = True, shorter: int | None = None, across: bool = False) -> DataFrame:
    """Remove every byte that a string of ``span`` bytes covers which also starts elsewhere;
    with ``across``, which also starts in another document.

    Returns ``row`` (a struct of the ``carry`` columns, all by default), n_units
    (bytes), n_removed, n_spans, kept_sha256, kept and n_shorter. Null text is empty;
    texts of under ``span`` bytes stay. Repeated rows and equal texts lose everything
    from ``span`` bytes on, in every copy; null ids change nothing. Columns may have any
    names: they travel inside ``row``.

    With ``shorter`` (half of ``span`` to all of it), strings of so many bytes are
    looked for first and those of ``span`` bytes are refined from them; n_shorter says
    how many bytes a removal of ``shorter`` would take. Without it n_shorter is null.
    ``across`` knows no ``shorter``. What a document has twice and no other has stays then;
    equal texts and repeated rows are documents of their own.
    """
    if across and shorter is not None:
        raise ValueError("strings of other documents are looked for at one span")
    if shorter is not None and not span <= 2 * shorter <= 2 * span:
        raise ValueError("a shorter span is half of the span at least, and not longer")
    units = byte_units(shorter or span)
    rows = passages.keyed(docs, text, id_col, docs.columns if carry is None else carry)
    anchors = passages.anchor_table(rows, units)
    places = passages.passage_table(rows, anchors, units, across)
    if across:
        texts = places.withColumns({"doc": F.col("d1"), "copies": F.col("d1")})
        runs = passages.resolved(texts, _decide(units.span, True), units, F.max)
    else:
        runs = passages.resolved(places, _decide(units.span), units)
    windows = passages.located(places, runs, F.lit(True))
    whole = F.col("copies") > 1
    if shorter is None:
        return passages.without(rows, anchors, windows, units, whole, with_kept)
    windows = stored(windows)
    return passages.without(rows, anchors, refined(windows, span - shorter), dataclasses.replace(units, span=span), whole, with_kept, windows, shorter)


def op10_suffix_array_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = remove_repeats(read_table(spark, sf_dir, "documents"), carry=["doc_id"], with_kept=False, shorter=SHORTER)
    return out.select("row.doc_id", F.col("n_units").alias("n_bytes"), "n_removed", "n_spans", "kept_sha256", F.col("n_shorter").alias(f"n_repeated_{SHORTER}"))
