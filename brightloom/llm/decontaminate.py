"""Benchmark decontamination by q-gram lemma filtering.

A segment is any window of 80 bytes of a benchmark item, or a shorter item as a
whole. A copy of a segment of m bytes with at most k edits shares m - q + 1 - k * q
of its q-grams, on diagonals that k edits can't spread further than k apart. So the
q-grams that a text shares with an item are counted in overlapping bands of
diagonals; in a band that reaches the bound, each window that reaches it is verified
by an alignment: a segment is found where its edit distance to some part of the text
is within the budget. No cap, no early stop: the filter loses nothing within the
budget, wherever an excerpt starts. Items too short for q-grams are searched exactly.

A text that repeats what an item repeats has as many pairs of places as the product of
both. So pairs are made for a stretch of the text and a range of items at a time, which
are halved until the pairs are few; long items are held as parts that overlap by a
segment. A stretch that came before, byte for byte, is not searched again.
"""

from __future__ import annotations

import functools
import re
import sys
from bisect import bisect_right
from collections.abc import Iterator, Sequence
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import named, read_table, row_of, ship, with_fields
from .passages import mix

Q = 10
#: Bytes of a segment.
SEGMENT = 80
#: Edits for each hundred bytes of a segment.
BUDGET = 5
#: Bytes of items that one pass over the documents looks for. Larger benchmarks are
#: looked for block by block.
BLOCK_BYTES = 4 << 20
_BITS = 22
#: Diagonals of a band, without what it overlaps with the next.
BAND = 8
#: Added to diagonals, which may be negative by the length of an item.
_FAR = 1 << 36
#: Pairs of places of one q-gram that are held at a time; least places of a stretch of text, and segments of a part of an item.
PAIRS, STRETCH, PART = 1 << 20, 64, 2048


@functools.cache
def _folds_oddly() -> re.Pattern:
    """Characters whose lower case has another size in UTF-8, or depends on what stands around them."""
    other = [c for c in map(chr, range(0x80, sys.maxunicode + 1)) if c == "Σ" or (c.isupper() or c != c.lower()) and len(c.lower().encode("utf-8", "surrogatepass")) != len(c.encode("utf-8", "surrogatepass"))]
    return re.compile("[" + "".join(map(re.escape, other)) + "]")


def normal(text: str) -> tuple[bytes, np.ndarray]:
    """Lower case, character by character, white space runs as one space; and each byte's place in the text.

    What a character is folded to doesn't depend on any other. Where that is longer or
    shorter than the character, its bytes have the places of the character's.
    """
    origin = None
    if text.isascii() or not _folds_oddly().search(text):
        folded = text.lower().encode("utf-8", "surrogatepass")
    else:
        each = [c.lower().encode("utf-8", "surrogatepass") for c in text]
        sizes = np.array([len(c.encode("utf-8", "surrogatepass")) for c in text])
        folded, new = b"".join(each), np.array([len(c) for c in each])
        within = np.arange(len(folded)) - np.repeat(np.cumsum(new) - new, new)
        origin = np.repeat(np.cumsum(sizes) - sizes, new) + np.minimum(within, np.repeat(sizes, new) - 1)
    data = np.frombuffer(folded, np.uint8)
    space = (data == 32) | ((data >= 9) & (data <= 13))
    keep = np.flatnonzero(~(space & np.concatenate([[False], space[:-1]])))
    return np.where(space, np.uint8(32), data)[keep].tobytes(), keep if origin is None else origin[keep]


def grams(data: bytes) -> np.ndarray:
    """Hashes of the q-grams of ten bytes."""
    n = len(data) - Q + 1
    if n <= 0:
        return np.empty(0, np.uint64)
    eight, padded = np.empty(n + 2, np.uint64), data + b"\0" * 8
    for k in range(min(8, n + 2)):
        eight[k::8] = np.frombuffer(padded, "<u8", -(-(n + 2 - k) // 8), k)
    return mix(eight[:-2], eight[2:])


def stepped(n: int) -> int:
    """Segments of an item of n bytes."""
    return max(0, n - SEGMENT) + 1


class Segments(Sequence):
    """The segments of all items, cut when asked for."""

    def __init__(self, texts: list[bytes]) -> None:
        self.texts, self.firsts = texts, np.concatenate([[0], np.cumsum([stepped(len(t)) for t in texts])]).astype(np.int64).tolist()

    def __len__(self) -> int:
        return self.firsts[-1]

    def item(self, s: int) -> int:
        """Number of the text that a segment is of."""
        return bisect_right(self.firsts, s) - 1

    def __getitem__(self, s: int) -> bytes:
        if not 0 <= s < len(self):
            raise IndexError(s)
        i = self.item(s)
        at = s - self.firsts[i]
        return self.texts[i][at : at + SEGMENT]


class Index(NamedTuple):
    """Items of a block and their q-grams, sorted by hash; ``short``: for each length the sorted hashes of items under 2 * Q bytes, and their numbers.

    ``part`` is each q-gram's part, ``place`` its place there; ``item`` and ``begins`` say
    which item a part is of and where it begins. ``entry`` is hash and part as one sorted number.
    """

    items: list[int | None]
    segments: Segments
    present: np.ndarray
    hashes: np.ndarray
    entry: np.ndarray
    part: np.ndarray
    place: np.ndarray
    item: np.ndarray
    begins: np.ndarray
    sizes: np.ndarray
    short: dict[int, tuple[np.ndarray, np.ndarray]]


def budget(m: int) -> int:
    return m * BUDGET // 100


def bound(m: int) -> int:
    """Shared q-grams that a copy within the budget has at least."""
    return m - Q + 1 - budget(m) * Q


_PRIME = np.uint64(0x9E3779B97F4A7C15)


def build(items: list[tuple[int | None, str | None]]) -> Index:
    owner, texts, hashes, of, place, item, begins, sizes = [], [], [], [], [], [], [], []
    short: dict[int, list[tuple[int, int]]] = {}
    for item_id, text in items:
        data = normal(text or "")[0].strip()
        if not data:
            continue
        if len(data) < 2 * Q:
            value = 0
            for c in data:
                value = (value * int(_PRIME) + c + 1) & ((1 << 64) - 1)
            short.setdefault(len(data), []).append((value, len(texts)))
        else:
            h = grams(data)
            for at in range(0, stepped(len(data)), PART):
                part = h[at : at + PART + SEGMENT - Q]
                hashes.append(part)
                of.append(np.full(len(part), len(item), np.int32))
                place.append(np.arange(len(part), dtype=np.int32))
                item.append(len(texts))
                begins.append(at)
                sizes.append(min(len(data) - at, PART + SEGMENT - 1))
        owner.append(item_id)
        texts.append(data)
    h = np.concatenate([*hashes, np.empty(0, np.uint64)])
    order = np.argsort(h, kind="stable")
    names, starts = np.unique(h[order], return_index=True)
    present = np.zeros(1 << _BITS, bool)
    present[(names >> np.uint64(64 - _BITS)).astype(np.int64)] = True
    cat = lambda x: np.concatenate([*x, np.empty(0, np.int32)]).astype(np.int32)[order]
    part = cat(of)
    entry = np.repeat(np.arange(len(names), dtype=np.int64), np.diff(np.append(starts, len(h)))) * max(1, len(item)) + part
    exact = {n: (np.array([v for v, _ in sorted(x)], np.uint64), np.array([i for _, i in sorted(x)], np.int64)) for n, x in short.items()}
    return Index(owner, Segments(texts), present, names, entry, part, cat(place), np.array(item, np.int64), np.array(begins, np.int64), np.array(sizes, np.int64), exact)


def _distances(segment: bytes, window: bytes, anchored: bool) -> list[int]:
    """Edits from the segment to what ends after each byte of the window: its best part, or all from the start.

    Bit-parallel: a column of the table is two integers of vertical differences.
    """
    m = len(segment)
    full, top = (1 << m) - 1, 1 << (m - 1)
    where: dict[int, int] = {}
    for i, c in enumerate(segment):
        where[c] = where.get(c, 0) | 1 << i
    more, less, score, out = full, 0, m, []
    for c in window:
        eq = where.get(c, 0)
        xv = eq | less
        xh = (((eq & more) + more) ^ more) | eq
        up = (less | ~(xh | more)) & full
        down = more & xh
        if up & top:
            score += 1
        elif down & top:
            score -= 1
        up = (up << 1 | anchored) & full
        down = (down << 1) & full
        more = (down | ~(xv | up)) & full
        less = up & xv
        out.append(score)
    return out


def aligned(segment: bytes, window: bytes, most: int) -> tuple[int, int, int] | None:
    """Least edits from a segment to a part of the window, and where: (edits, from, to).

    Of equal parts the one that ends first, and of these the longest.
    """
    at = window.find(segment)
    if at >= 0:
        return 0, at, at + len(segment)
    ends = [len(segment), *_distances(segment, window, False)]
    edits = min(ends)
    if edits > most:
        return None
    to = ends.index(edits)
    starts = [len(segment), *_distances(segment[::-1], window[:to][::-1], True)]
    return edits, to - max(n for n, e in enumerate(starts) if e == edits), to


def _letter(c: int) -> bool:
    return 48 <= c <= 57 or 97 <= c <= 122


def _exact(data: bytes, index: Index) -> Iterator[tuple[int, int, int]]:
    """Items too short for q-grams, as whole words of ASCII or between any other bytes: (segment, from, to)."""
    codes = np.frombuffer(data, np.uint8).astype(np.uint64) + np.uint64(1)
    value = np.zeros(len(codes), np.uint64)
    for n in range(1, min(max(index.short), len(data)) + 1):
        value = value[: len(codes) - n + 1] * _PRIME + codes[n - 1 :]
        if n not in index.short:
            continue
        names, numbers = index.short[n]
        low, high = np.searchsorted(names, value), np.searchsorted(names, value, "right")
        for at in np.flatnonzero(high > low).tolist():
            end = at + n
            cut_word = (at and _letter(data[at]) and _letter(data[at - 1])) or (end < len(data) and _letter(data[end - 1]) and _letter(data[end]))
            for i in [] if cut_word else numbers[low[at] : high[at]].tolist():
                if index.segments.texts[i] == data[at:end]:
                    yield index.segments.firsts[i], at, end


def _candidates(near: np.ndarray, at: np.ndarray, low: np.ndarray, counts: np.ndarray, core: tuple[int, int], n: int, index: Index) -> Iterator[tuple[int, int, int, int]]:
    """Where a segment may be: (segment, edits at most, from, to), of windows that begin in the core.

    ``near`` are places of the text and ``at`` their q-grams' numbers; of each of these
    ``counts`` entries of the index from ``low`` on are paired with it.
    """
    each = np.repeat(low - np.cumsum(counts) + counts, counts) + np.arange(counts.sum())
    part, place = index.part[each].astype(np.int64), index.place[each].astype(np.int64)
    diagonal = np.repeat(near, counts) - place + _FAR
    band, rest = diagonal // BAND, diagonal % BAND
    again = rest < np.minimum(index.sizes[part], SEGMENT) * BUDGET // 100
    keys = np.concatenate([part << 34 | band, part[again] << 34 | (band[again] - 1)])
    places = np.concatenate([place, place[again]])
    order = np.lexsort((places, keys))
    keys, places = keys[order], places[order]
    first = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]]))
    for a, z in zip(first.tolist(), [*first[1:].tolist(), len(keys)], strict=True):
        p, b = int(keys[a]) >> 34, int(keys[a]) & ((1 << 34) - 1)
        size = int(index.sizes[p])
        m = min(size, SEGMENT)
        if z - a < bound(m):
            continue
        k, start = budget(m), b * BAND - _FAR
        # only segments that hold the first of their shared q-grams can reach the bound
        w = np.arange(max(0, int(places[a]) - m, core[0] - start), min(stepped(size), int(places[z - 1]) + 1, core[1] - start))
        shared = np.searchsorted(places[a:z], w + m - Q, "right") - np.searchsorted(places[a:z], w)
        number = index.segments.firsts[int(index.item[p])] + int(index.begins[p])
        for v in w[shared >= bound(m)].tolist():
            yield number + v, k, max(0, v + start - k), min(n, v + start + BAND + k + m + k)


class _Found(dict):
    """For each segment its least edits, first place and last end."""

    def put(self, s: int, edits: int, a: int, z: int) -> None:
        old = self.get(s)
        self[s] = (edits, a, z) if old is None else (min(edits, old[0]), min(a, old[1]), max(z, old[2]))


def _search(data: bytes, index: Index, found: _Found, one: bool) -> None:
    """Segments of items with q-grams, put into ``found``; any one of them if ``one``."""
    h = grams(data)
    near = np.flatnonzero(index.present[(h >> np.uint64(64 - _BITS)).astype(np.int64)])
    if not len(near) or not len(index.hashes):
        return
    at = np.searchsorted(index.hashes, h[near])
    at[at == len(index.hashes)] = 0
    same = index.hashes[at] == h[near]
    at, near = at[same], near[same]
    if not len(near):
        return
    parts, most = len(index.item), SEGMENT * BUDGET // 100
    ahead = SEGMENT + 2 * BAND + 3 * most  # a window's q-grams, and what it is aligned to, end within so much of its start
    known: dict[tuple[bytes, int, int, int], list[tuple[int, int, int, int]]] = {}

    def search(s: int, size: int, p0: int, p1: int) -> bool:
        """Windows that begin in ``size`` places from ``s`` on, of parts from p0 to p1; whether to stop."""
        a, z = np.searchsorted(near, [s - most, s + size + ahead])
        low = np.searchsorted(index.entry, at[a:z] * parts + p0)
        counts = np.searchsorted(index.entry, at[a:z] * parts + p1) - low
        total = int(counts.sum())
        if not total:
            return False
        if total > PAIRS and size > STRETCH:
            return search(s, size // 2, p0, p1) or search(s + size // 2, size // 2, p0, p1)
        if total > PAIRS and p1 - p0 > 1:
            return search(s, size, p0, (p0 + p1) // 2) or search(s, size, (p0 + p1) // 2, p1)
        begin = max(0, s - most)
        key = (data[begin : s + size + ahead], begin - s, p0, p1)
        hits = known.get(key)
        if hits is None:
            inner = _Found()
            for segment, k, x, y in _candidates(near[a:z], at[a:z], low, counts, (s, s + size), len(data), index):
                hit = aligned(index.segments[segment], data[x:y], k)
                if hit:
                    inner.put(segment, hit[0], x + hit[1] - s, x + hit[2] - s)
                    if one:
                        break
            hits = known[key] = [(segment, *v) for segment, v in inner.items()]
            if sum(map(len, known.values())) + len(known) > PAIRS // 16:
                known.clear()
        for segment, edits, x, y in hits:
            found.put(segment, edits, x + s, y + s)
        return one and bool(hits)

    size = STRETCH
    while size < len(data) + 2 * ahead:
        size *= 2
    search(-ahead, size, 0, parts)


def regions(text: str | None, index: Index, one: bool = False) -> list[tuple[int, int, int, int]]:
    """The segments that a text has copies of: (segment, least edits, first place, last end), in bytes of the text. ``one``: any one of them is enough."""
    if not text or not len(index.segments):
        return []
    data, places = normal(text)
    found = _Found()
    if index.short:
        for s, a, z in _exact(data, index):
            found.put(s, 0, a, z)
    if not (one and found):
        _search(data, index, found, one)
    whole = len(text.encode("utf-8", "surrogatepass")) if found else 0
    return sorted((s, e, int(places[a]), int(places[z]) if z < len(places) else whole) for s, (e, a, z) in found.items())


def item_blocks(items: DataFrame, id_col: str = "item_id", text: str = "text") -> list[list[tuple[int | None, str | None]]]:
    """Items in blocks of at most BLOCK_BYTES, one block at the driver at a time is enough."""
    total = items.agg(F.sum(F.octet_length(named(text)))).first()[0] or 0
    n = -(-total // BLOCK_BYTES) or 1
    keyed = items.select(named(id_col).cast("bigint").alias("i"), named(text).alias("t"), F.pmod(F.xxhash64(named(id_col), named(text)), F.lit(n)).alias("b"))
    for b in range(n):
        yield [(r["i"], r["t"]) for r in keyed.filter(F.col("b") == b).select("i", "t").collect()]


def find(docs: DataFrame, items: DataFrame, text: str = "text", carry: list[str] | None = None) -> DataFrame:
    """One row for each document and item that it has a copied segment of.

    ``row`` (the ``carry`` columns), item_id, n_segments (how many of its segments, which
    overlap, are found), edits (of the best), first and last (bytes of the text from the
    first copy to the end of the last). Memory and time grow with the text, also where
    text and item repeat one unit. Null and empty texts have none; repeated rows are found each; null
    ids change nothing. Other columns may have any names: they travel in ``row``.
    """
    spark = docs.sparkSession
    ship(spark)
    source = docs.select(row_of(docs.columns if carry is None else carry), named(text).alias("text"))
    found = None
    for block in item_blocks(items):
        index = spark.sparkContext.broadcast(build(block))

        def run(batches: Iterator[pa.RecordBatch], index=index) -> Iterator[pa.RecordBatch]:
            index = index.value
            for batch in batches:
                out: list[list] = [[], [], [], [], [], []]
                for i, t in enumerate(batch.column("text")):
                    by_item: dict[int | None, list] = {}
                    for s, *r in regions(t.as_py(), index):
                        by_item.setdefault(index.items[index.segments.item(s)], []).append(r)
                    for item, rs in by_item.items():
                        for column, v in zip(out, (i, item, len(rs), min(r[0] for r in rs), min(r[1] for r in rs), max(r[2] for r in rs)), strict=True):
                            column.append(v)
                yield pa.RecordBatch.from_arrays([batch.column("row").take(pa.array(out[0], pa.int64())), *(pa.array(c, pa.int64()) for c in out[1:])], ["row", "item_id", "n_segments", "edits", "first", "last"])

        part = source.mapInArrow(run, with_fields(source, ["row"], "item_id bigint, n_segments bigint, edits bigint, first bigint, last bigint"))
        found = part if found is None else found.unionAll(part)
    return found


def clean(docs: DataFrame, items: DataFrame, text: str = "text") -> DataFrame:
    """Documents without a copied segment of any item, all their columns as they were."""
    spark = docs.sparkSession
    ship(spark)
    columns = docs.columns
    kept = docs.select(row_of(columns), named(text).alias("text"))
    for block in item_blocks(items):
        index = spark.sparkContext.broadcast(build(block))

        def run(batches: Iterator[pa.RecordBatch], index=index) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                yield batch.filter(pa.array([not regions(t.as_py(), index.value, one=True) for t in batch.column("text")], pa.bool_()))

        kept = kept.mapInArrow(run, kept.schema)
    return kept.select(*(named(c, "row").alias(c) for c in columns))


def op2_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, items = read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "benchmark")
    out = find(docs, items, carry=["doc_id"])
    return out.select("row.doc_id", "item_id", "n_segments", "edits", "first", "last")
