"""Recursive resolution: everything that roots refer to, directly or not."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from brightloom.session import cut


#: Tables of found nodes that stand side by side before they are joined into one.
TABLES = 8
#: Roots that travel together as the bits of one number, and those that one task numbers.
BITS, ROOTS_PER_TASK = 64, 1 << 20


def closure(roots: DataFrame, edges: DataFrame) -> DataFrame:
    """(root, node, depth) for each node reachable from each root; depth is the least.

    ``roots`` has root, ``edges`` has src and dst. A root reaches itself at depth 0.
    A node met on several ways counts once, so diamonds and cycles end. Null roots and
    ends are ignored, an end without edges of its own is a leaf. Each step joins only
    the nodes that were new in the last one. What was found stands in at most TABLES
    checkpointed tables, so the plan stays the same however deep the graph is.

    Roots are numbered and travel in blocks of BITS, as the bits of a mask: an edge is
    followed once for all roots of a block that its node was new to. Edges are dealt by
    src and sorted once, not in each step; repeated ones change nothing.
    """
    spark = edges.sparkSession
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    edges = edges.filter("src IS NOT NULL AND dst IS NOT NULL").select("src", "dst")
    edges = cut(edges.repartition(parts, "src").sortWithinPartitions("src"))
    known = cut(roots.filter("root IS NOT NULL").select("root").distinct())
    known = cut(known.coalesce(known.count() // ROOTS_PER_TASK + 1).withColumn("i", F.monotonically_increasing_id()))
    block, bit = F.shiftright("i", BITS.bit_length() - 1), (F.col("i") % BITS).cast("int")
    frontier = cut(known.groupBy(F.col("root").alias("node"), block.alias("block")).agg(F.bit_or(F.call_function("shiftleft", F.lit(1).cast("bigint"), bit)).alias("mask")).withColumn("depth", F.lit(0)))
    tables, depth = [frontier], 0
    while not frontier.isEmpty():
        depth += 1
        met = frontier.join(edges, F.col("node") == F.col("src")).groupBy(F.col("dst").alias("node"), "block").agg(F.bit_or("mask").alias("met"))
        seen = reduce(DataFrame.unionAll, tables).groupBy("node", "block").agg(F.bit_or("mask").alias("seen"))
        new = F.col("met").bitwiseAND(F.bitwise_not(F.coalesce("seen", F.lit(0).cast("bigint"))))
        frontier = cut(met.join(seen, ["node", "block"], "left").select("node", "block", new.alias("mask"), F.lit(depth).alias("depth")).filter("mask <> 0"))
        tables.append(frontier)
        if len(tables) > TABLES:
            tables = [cut(reduce(DataFrame.unionAll, tables))]
    bits = F.explode(F.expr(f"filter(sequence(0, {BITS - 1}), b -> getbit(mask, b) = 1)"))
    found = reduce(DataFrame.unionAll, tables).select("node", "depth", "block", bits.alias("bit"))
    return found.select("node", "depth", (F.col("block") * BITS + F.col("bit")).alias("i")).join(known, "i").select("root", "node", "depth")
