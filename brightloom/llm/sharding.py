"""Sharding by longest-processing-time scheduling.

Groups that must stay together, sorted by size, go to the least-loaded shard
through a heap. Groups of one size are interchangeable, so the driver needs the
histogram of group sizes only: d distinct sizes add up to d*d/2 bytes at least,
hence at most sqrt(2 * corpus bytes) entries reach it, whatever the number of
groups. A class of many equal groups is dealt in one step that leaves the heap
exactly as dealing them one by one would.
"""

from __future__ import annotations

import heapq

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from .common import cut, named, read_table, text_bytes

#: Cells that the groups of one size are counted in before they are ranked.
RANK_CELLS = 256
#: Rows of one shard that are numbered together in one task.
ROWS_PER_CELL = 50_000
#: Size classes up to which their table is broadcast; beyond, it is joined.
BROADCAST_CLASSES = 200_000


def deal(histogram: list[tuple[int, int]], n_shards: int) -> dict[int, list[int]]:
    """LPT over (size, count) pairs: for each size, how many groups each shard gets.

    Equal to popping the least-loaded shard (the lowest number among equals) from
    a heap once for each group, largest groups first.
    """
    heap = [(0, s) for s in range(n_shards)]
    dealt: dict[int, list[int]] = {}
    for size, count in sorted(histogram, reverse=True):
        given = [0] * n_shards
        if size > 0 and count > 4 * n_shards:
            loads = sorted(heap)
            low, high = loads[0][0], loads[-1][0] + size * (count // n_shards + 2)
            taken = lambda level: sum(max(0, -(-(level - x) // size)) for x, _ in loads)
            while low < high:  # the highest level that count groups don't exceed
                mid = (low + high + 1) // 2
                low, high = (mid, high) if taken(mid) <= count else (low, mid - 1)
            heap = []
            for load, s in loads:
                given[s] = max(0, -(-(low - load) // size))
                heap.append((load + size * given[s], s))
            heapq.heapify(heap)
            count -= sum(given)
        for _ in range(count):
            load, s = heap[0]
            heapq.heapreplace(heap, (load + size, s))
            given[s] += 1
        dealt[size] = given
    return dealt


def _cell(data: F.Column, cells: int) -> F.Column:
    """One of so many cells, by the digest of some bytes."""
    return F.pmod(F.conv(F.substring(F.sha2(data, 256), 1, 8), 16, 10).cast("bigint"), F.lit(cells))


def number_within(df: DataFrame, by: list[str], cell: str, order: list, out: str) -> DataFrame:
    """Number rows from 0 without gaps within ``by``; no task holds more than a cell."""
    counts = df.groupBy(*by, cell).agg(F.count(F.lit(1)).alias("_n"))
    before = Window.partitionBy(*by).orderBy(cell).rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select(*by, cell, F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"))
    ranked = df.withColumn("_rank", F.row_number().over(Window.partitionBy(*by, cell).orderBy(*order)) - 1)
    return ranked.join(offsets, [*by, cell]).withColumn(out, (F.col("_before") + F.col("_rank")).cast("long")).drop("_before", "_rank", cell)


def lpt_shards(rows: DataFrame, n_shards: int, group: str = "group_key", size: str = "size") -> DataFrame:
    """Add ``shard``: all rows of one ``group`` in one shard, loads near equal.

    ``group`` is binary or text and must not be null (nulls would drop out of the join); ``size`` is a
    long of at least 0. Ties are broken by the group's key, so the result depends
    on the rows only. An empty table gives an empty table. A group of a third of
    all rows is summed before the shuffle and joined back by a skew-split join.
    """
    spark = rows.sparkSession
    groups = rows.groupBy(group).agg(F.sum(size).alias("_size"))
    groups = cut(groups.withColumn("_cell", _cell(F.col(group).cast("binary"), RANK_CELLS)))
    histogram = [(int(r["_size"]), int(r["n"])) for r in groups.groupBy("_size").agg(F.count(F.lit(1)).alias("n")).collect()]
    bounds = []
    for s, given in deal(histogram, n_shards).items():
        total = 0
        bounds.append((s, [total := total + x for x in given]))
    schema = T.StructType([T.StructField("_size", T.LongType()), T.StructField("_bounds", T.ArrayType(T.LongType()))])
    classes = spark.createDataFrame(bounds, schema)
    if len(bounds) <= BROADCAST_CLASSES:
        classes = F.broadcast(classes)
    ranked = number_within(groups, ["_size"], "_cell", [group], "_class_rank")
    placed = ranked.join(classes, "_size").select(group, F.size(F.filter("_bounds", lambda b: b <= F.col("_class_rank"))).alias("shard"))
    return rows.join(placed, group)


def shard_documents(docs: DataFrame, n_shards: int = 8, text: str = "text", id_col: str = "doc_id") -> DataFrame:
    """Shards of documents with near equal bytes; equal texts stay together.

    Null text counts as empty text, of size 1. Null and repeated ids are kept, each
    row with its own slot. Columns other than ``id_col`` and ``text`` are not read,
    so their names can't clash.
    """
    t = F.coalesce(named(text), F.lit(""))
    rows = docs.select(
        named(id_col).alias("doc_id"),
        (text_bytes(named(text)) + 1).alias("size"),
        F.crc32(t).cast("long").alias("text_crc32"),
        F.unhex(F.sha2(t, 256)).alias("group_key"),
    )
    rows = cut(rows)
    cells = max(16, rows.count() // n_shards // ROWS_PER_CELL)
    placed = lpt_shards(rows, n_shards).withColumn("_cell", _cell(F.concat_ws(":", F.col("doc_id").cast("string"), F.hex("group_key")), cells))
    return number_within(cut(placed), ["shard"], "_cell", ["doc_id", "group_key"], "slot")


def op4_lpt_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = shard_documents(read_table(spark, sf_dir, "documents"))
    return out.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))
