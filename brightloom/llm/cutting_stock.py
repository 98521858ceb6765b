"""Packing of tokenized documents by cutting-stock column generation.

Sequences are stock of one length and documents are the pieces that are cut from it. A
pattern says how many documents of each size class stand in a sequence. How often each
pattern is used is a linear program over the histogram of sizes, which has a row for each
class; its columns are made as they are needed: a knapsack by dynamic programming prices
them with the program's dual values, until no pattern is worth more than a sequence.
Whole copies of the patterns are taken, and what these leave is packed by best fit. That
needs the histogram only, so it runs at the driver in a size that the capacity bounds.

Documents are ranked within their class, and a rank is a place in a copy of a pattern.
Nothing is cut so far but what is longer than a sequence. The gaps that classes leave,
which are rounded up, are then filled: the emptiest sequences are dissolved and their
tokens are laid in one line along the gaps of all others. What is left at the line's end
fills sequences of its own, the last ones at powers of two.
"""

from __future__ import annotations

import array
import math
import zlib
from collections import Counter
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import cut, named, read_table, ship, stored, tidy
from .packing import best_fit, tokenizer_path, word_ids

CAPACITY, END = 4096, 2
#: Tokens that sizes are rounded up to a multiple of, so a program has CAPACITY / GRID rows at most.
GRID = 8
#: Gaps of fewer tokens stay: no document is cut for them.
LEAST = 8
#: The program ends where it is so near to its bound.
NEAR = 1e-4
#: Sequences whose places in the line are summed together in one task.
RUN = 4096
#: Cells that sequences of one fill are counted in, to dissolve no more of them than needed.
CELLS = 1024


class Pattern(NamedTuple):
    #: (class, documents of it in a sequence), the largest class first.
    slots: tuple[tuple[int, int], ...]
    copies: int


def knapsack(sizes: np.ndarray, prices: np.ndarray, capacity: int) -> tuple[float, np.ndarray]:
    """The most that items of these sizes (ascending) can be worth within the capacity, and how many of each."""
    worth, last = np.zeros(capacity + 1), np.full(capacity + 1, -1)
    fits = np.searchsorted(sizes, np.arange(capacity + 1), "right")
    for c in range(1, capacity + 1):
        worth[c], k = worth[c - 1], fits[c]
        if k:
            values = worth[c - sizes[:k]] + prices[:k]
            i = int(values.argmax())
            if values[i] > worth[c]:
                worth[c], last[c] = values[i], i
    counts, c = np.zeros(len(sizes), np.int64), capacity
    while c > 0:
        if last[c] < 0:
            c -= 1
        else:
            counts[last[c]] += 1
            c -= int(sizes[last[c]])
    return float(worth[capacity]), counts


def column_generation(sizes: np.ndarray, demand: np.ndarray, capacity: int, near: float = NEAR) -> tuple[np.ndarray, np.ndarray, float]:
    """Patterns (as columns), how often each is used, and a lower bound of the number of sequences.

    Revised simplex: the basis starts with patterns of one size each, its inverse is kept,
    and the entering column is the knapsack's at the dual prices. The bound is the dual
    one (prices, scaled so that no pattern is worth more than a sequence).
    """
    m = len(sizes)
    most = capacity // sizes
    columns, inverse = np.diag(most), np.diag(1.0 / most)
    used, bound = demand / most, 0.0
    for _ in range(100 * m):  # far more than it takes; any basis is a right answer, only a longer one
        prices = inverse.sum(0)
        value, pattern = knapsack(sizes, np.maximum(prices, 0), capacity)
        bound = max(bound, float(np.maximum(prices, 0) @ demand) / max(value, 1.0))
        if value <= 1 + 1e-9 or used.sum() <= bound * (1 + near):
            break
        pattern[prices <= 0] = 0
        direction = inverse @ pattern
        steps = np.where(direction > 1e-9, used / np.where(direction > 1e-9, direction, 1), np.inf)
        leaves = int(steps.argmin())
        step = steps[leaves]
        used = np.maximum(used - step * direction, 0)
        used[leaves] = step
        row = inverse[leaves] / direction[leaves]
        rows = np.flatnonzero(np.abs(direction) > 1e-12)
        inverse[rows] -= direction[rows, None] * row
        inverse[leaves] = row
        columns[:, leaves] = pattern
    return columns, used, bound


def patterns(histogram: dict[int, int], capacity: int) -> list[Pattern]:
    """Whole copies of patterns that hold exactly as many items of each size as there are.

    What the program's whole copies leave, less than one sequence for each of its
    patterns, is packed by best fit.
    """
    if not histogram:
        return []
    sizes = np.array(sorted(histogram), np.int64)
    left = np.array([histogram[s] for s in sizes.tolist()], np.int64)
    columns, used, _ = column_generation(sizes, left.astype(np.float64), capacity)
    found: Counter[tuple[tuple[int, int], ...]] = Counter()
    slots = lambda counts: tuple((s, n) for s, n in zip(sizes.tolist()[::-1], counts.tolist()[::-1], strict=True) if n)
    for column, copies in zip(columns.T, np.floor(used + 1e-6).astype(np.int64).tolist(), strict=True):
        inside = column > 0
        copies = min(copies, int((left[inside] // column[inside]).min()))
        if copies > 0:
            found[slots(column)] += copies
            left -= copies * column
    rest = np.repeat(sizes, left).tolist()
    for bin_ in best_fit(rest, capacity):
        counts = Counter(rest[i] for i in bin_)
        found[tuple(sorted(counts.items(), reverse=True))] += 1
    return [Pattern(k, n) for k, n in found.items()]


class Places:
    """Which place in which sequence each rank of a class has."""

    def __init__(self, found: list[Pattern]) -> None:
        self.sequences = sum(p.copies for p in found)
        by: dict[int, list[tuple[int, int, int, int]]] = {}
        taken: Counter[int] = Counter()
        base = 0
        for p in found:
            slot = 0
            for class_, n in p.slots:
                by.setdefault(class_, []).append((taken[class_], n, base, slot))
                taken[class_] += n * p.copies
                slot += n
            base += p.copies
        self.of_class = {c: np.array(x, np.int64).T for c, x in by.items()}

    def at(self, classes: np.ndarray, ranks: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        sequence, slot = np.zeros(len(ranks), np.int64), np.zeros(len(ranks), np.int64)
        for c in np.unique(classes).tolist():
            rows = np.flatnonzero(classes == c)
            first, n, base, before = self.of_class[c]
            i = np.searchsorted(first, ranks[rows], "right") - 1
            copy, place = np.divmod(ranks[rows] - first[i], n[i])
            sequence[rows], slot[rows] = base[i] + copy, before[i] + place
        return sequence, slot


_TOKENIZED = "doc_id bigint, start bigint, length bigint, ids_crc32 bigint, doc_tokens bigint, ids binary"


def tokenized(docs: DataFrame, path: str, capacity: int, end_id: int, text: str, id_col: str) -> DataFrame:
    """Stored pieces of at most ``capacity`` ids with a key of their own; ids of those that a sequence is larger than."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        words, end = word_ids(path), array.array("I", [end_id]).tobytes()
        for batch in batches:
            out: list[list] = [[], [], [], [], [], []]
            for doc_id, t in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                ids = words.of(t.as_py() or "") + end
                for at in range(0, len(ids), 4 * capacity):
                    part = ids[at : at + 4 * capacity]
                    for column, v in zip(out, (doc_id, at // 4, len(part) // 4, zlib.crc32(part), len(ids) // 4, part if len(part) < 4 * capacity else None), strict=True):
                        column.append(v)
            types = [pa.int64()] * 5 + [pa.binary()]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(out, types, strict=True)], ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "ids"])
        tidy()

    ship(docs.sparkSession)
    found = docs.select(named(id_col).cast("bigint").alias("doc_id"), named(text).alias("text")).mapInArrow(run, _TOKENIZED)
    return stored(found.withColumn("key", F.monotonically_increasing_id()))


def ranked(items: DataFrame) -> DataFrame:
    """Adds rank, from 0 within ``class``. No task ranks more rows of a class than one file of the items has."""
    dealt = items.withColumn("part", F.shiftright("key", 33))
    counts = dealt.groupBy("class", "part").agg(F.count(F.lit(1)).alias("n"))
    before = Window.partitionBy("class").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    counts = counts.select("class", "part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("before"))
    within = F.row_number().over(Window.partitionBy("class", "part").orderBy("key")) - 1
    return dealt.withColumn("within", within).join(counts, ["class", "part"]).withColumn("rank", F.col("before") + F.col("within")).drop("part", "within", "before")


def in_line(rows: DataFrame, size: str, order: list[str]) -> DataFrame:
    """Adds at, where each row begins if all are laid in one line by sequence; sums are made by runs of sequences."""
    dealt = rows.withColumn("run", F.floor(F.col("sequence_id") / RUN))
    totals = dealt.groupBy("run").agg(F.sum(size).alias("total"))
    before = Window.orderBy("run").rowsBetween(Window.unboundedPreceding, -1)
    totals = totals.select("run", F.coalesce(F.sum("total").over(before), F.lit(0)).alias("before"))
    within = Window.partitionBy("run").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    placed = dealt.withColumn("within", F.coalesce(F.sum(size).over(within), F.lit(0))).join(totals, "run")
    return placed.withColumn("at", F.col("before") + F.col("within")).drop("run", "within", "before")


def to_dissolve(gaps: dict[int, int], capacity: int, least: int) -> tuple[int, int]:
    """Sequences of larger gaps than the first number are dissolved, and as many of that gap as the second says.

    ``gaps`` has how many sequences have each gap. Their tokens are as many as the gaps,
    of ``least`` tokens at least, of all others need.
    """
    need = sum(g * n for g, n in gaps.items() if g >= least)
    for gap in sorted((g for g in gaps if g >= least), reverse=True):
        if need <= gaps[gap] * capacity:
            return gap, -(-need // capacity)
        need -= gaps[gap] * capacity
    return capacity, 0


def _cut_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Pieces of items, with the CRC of each one's ids."""
    for batch in batches:
        out: list[list] = [[], [], [], [], [], [], []]
        for doc_id, start, total, ids, parts in zip(*(batch.column(c) for c in ("doc_id", "start", "doc_tokens", "ids", "parts")), strict=True):
            data = memoryview(ids.as_buffer())
            for p in parts.as_py():
                crc = zlib.crc32(data[4 * p["from"] : 4 * (p["from"] + p["length"])])
                for column, v in zip(out, (doc_id.as_py(), start.as_py() + p["from"], p["length"], crc, total.as_py(), p["sequence_id"], p["offset"]), strict=True):
                    column.append(v)
        yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in out], ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"])


def pack_documents(docs: DataFrame, path: str | None = None, capacity: int = CAPACITY, end_id: int = END, grid: int = GRID, least: int = LEAST, text: str = "text", id_col: str = "doc_id") -> DataFrame:
    """doc_id, start, length, ids_crc32, doc_tokens, sequence_id and offset of each piece.

    A document's ids end with ``end_id``; null text is empty, a document of one id.
    Documents longer than a sequence are cut into full ones and a rest. Of the others
    only those are cut that fill gaps of ``least`` tokens or more, so a sequence is
    padded by fewer than that, or not at all where its tokens are a power of two. Of
    ``grid`` what divides the capacity counts. Null
    ids and repeated rows pass through, each row a document of its own; an empty table
    gives an empty table. Columns other than ``id_col`` and ``text`` are not read.
    """
    spark, grid = docs.sparkSession, math.gcd(grid, capacity)
    pieces = tokenized(docs, path or tokenizer_path(), capacity, end_id, text, id_col)
    columns = ["doc_id", "start", "length", "ids_crc32", "doc_tokens"]
    items = pieces.filter(F.col("length") < capacity).select("key", *columns).withColumn("class", F.ceil(F.col("length") / grid))
    histogram = {int(r["class"]): int(r["n"]) for r in items.groupBy("class").agg(F.count(F.lit(1)).alias("n")).collect()}
    places = Places(patterns(histogram, capacity // grid))

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sequence, slot = places.at(batch.column("class").to_numpy(), batch.column("rank").to_numpy())
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in ("key", *columns)), pa.array(sequence), pa.array(slot)], ["key", *columns, "sequence_id", "slot"])

    given = ranked(items).select("key", *columns, "class", "rank").mapInArrow(place, "key bigint, doc_id bigint, start bigint, length bigint, ids_crc32 bigint, doc_tokens bigint, sequence_id bigint, slot bigint")
    one = Window.partitionBy("sequence_id")
    before = one.orderBy("slot").rowsBetween(Window.unboundedPreceding, -1)
    fill = F.sum("length").over(one)
    laid = given.withColumn("offset", F.coalesce(F.sum("length").over(before), F.lit(0))).withColumn("fill", fill).drop("slot")
    laid = stored(laid.withColumn("gap", F.when(F.bit_count("fill") == 1, 0).otherwise(capacity - F.col("fill"))))

    each = laid.filter("offset = 0")
    gaps = {int(r["gap"]): int(r["n"]) for r in each.groupBy("gap").agg(F.count(F.lit(1)).alias("n")).collect()}
    gap, wanted = to_dissolve(gaps, capacity, least)
    cell = F.pmod(F.xxhash64("sequence_id"), F.lit(CELLS))
    cells = {int(r["cell"]): int(r["n"]) for r in each.filter(F.col("gap") == gap).groupBy(cell.alias("cell")).agg(F.count(F.lit(1)).alias("n")).collect()}
    below, found = 0, 0
    while found < wanted:
        found += cells.get(below, 0)
        below += 1
    dissolved = (F.col("gap") > gap) | ((F.col("gap") == gap) & (cell < below))

    whole = laid.filter(~dissolved).select(*columns, "sequence_id", "offset")
    fillers = laid.filter(dissolved)
    holes = laid.filter(~dissolved & (F.col("offset") == 0) & (F.col("gap") >= least))
    total = fillers.agg(F.sum("length")).first()[0] or 0
    room = holes.agg(F.sum("gap")).first()[0] or 0
    lines = in_line(fillers.select("key", "length", "sequence_id", "offset"), "length", ["sequence_id", "offset"]).select("key", "at", "length")
    open_ = in_line(holes.select("sequence_id", F.col("gap").alias("size"), F.col("fill").alias("from")), "size", ["sequence_id"]).select("sequence_id", "at", "size", "from")
    full, rest = divmod(max(0, total - room), capacity)
    own = spark.range(full).select((F.col("id") + places.sequences).alias("sequence_id"), (F.col("id") * capacity + room).alias("at"), F.lit(capacity).cast("bigint").alias("size"), F.lit(0).cast("bigint").alias("from"))
    tail, at = [], room + full * capacity
    for bit in range(rest.bit_length() - 1, -1, -1):
        if rest >> bit & 1:
            tail.append((places.sequences + full + len(tail), at, 1 << bit, 0))
            at += 1 << bit
    open_ = open_.unionAll(own).unionAll(spark.createDataFrame(tail, "sequence_id bigint, at bigint, size bigint, `from` bigint"))

    # each filler meets the holes that it overlaps, in the stretch of the line where the overlap begins
    stretch = lambda size: F.explode(F.sequence(F.floor(F.col("at") / capacity), F.floor((F.col("at") + F.col(size) - 1) / capacity))).alias("stretch")
    left = lines.select("key", F.col("at").alias("a"), (F.col("at") + F.col("length")).alias("z"), stretch("length"))
    right = open_.select("sequence_id", "from", F.col("at").alias("b"), (F.col("at") + F.col("size")).alias("y"), stretch("size"))
    begin, end = F.greatest("a", "b"), F.least("z", "y")
    met = left.join(right, "stretch").filter((begin < end) & (F.floor(begin / capacity) == F.col("stretch")))
    parts = met.groupBy("key").agg(F.collect_list(F.struct((begin - F.col("a")).alias("from"), (end - begin).alias("length"), "sequence_id", (F.col("from") + begin - F.col("b")).alias("offset"))).alias("parts"))
    cut_ = cut(parts).join(pieces.filter(F.col("length") < capacity).select("key", "doc_id", "start", "doc_tokens", "ids"), "key")
    cut_ = cut_.select("doc_id", "start", "doc_tokens", "ids", "parts").mapInArrow(_cut_up, "doc_id bigint, start bigint, length bigint, ids_crc32 bigint, doc_tokens bigint, sequence_id bigint, offset bigint")

    alone = pieces.filter(F.col("length") == capacity).select(*columns, (F.col("key") + places.sequences + full + len(tail)).alias("sequence_id"), F.lit(0).cast("bigint").alias("offset"))
    return whole.unionAll(cut_).unionAll(alone)


def op13_cutting_stock_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack_documents(read_table(spark, sf_dir, "documents"))
