"""Cycles and load order of a module graph."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from brightloom.operators.closure import TABLES
from brightloom.session import cut


def _spread(start: DataFrame, along: DataFrame) -> DataFrame:
    """(node, label): the least label that reaches each node along (src, dst).

    ``start`` has node and label. Each step sends only the labels that became smaller in
    the last one.
    """
    found = start.withColumn("new", F.lit(True))
    while not found.filter("new").isEmpty():
        sent = found.filter("new").join(along, F.col("node") == F.col("src")).groupBy(F.col("dst").alias("node")).agg(F.min("label").alias("sent"))
        found = cut(found.join(sent, "node", "left").select("node", F.least("label", "sent").alias("label"), F.coalesce(F.col("sent") < F.col("label"), F.lit(False)).alias("new")))
    return found.select("node", "label")


def strong_components(edges: DataFrame) -> DataFrame:
    """(node, component): nodes that reach each other have one component, its smallest node.

    Forward and backward reachability with trimming: nodes that no edge enters or none
    leaves are in no cycle and go first, again and again. Of the rest each node takes the
    smallest label that reaches it; the nodes that reach back to the label's owner, along
    nodes of that label, are its component. They go, and what is left starts anew.
    ``edges`` has src and dst; null ends are ignored, repeated edges change nothing, and a
    node with an edge to itself only is a component of one. No edges give no rows.
    """
    rest = cut(edges.filter("src IS NOT NULL AND dst IS NOT NULL").select("src", "dst").distinct())
    nodes = cut(rest.select(F.col("src").alias("node")).unionAll(rest.select("dst")).distinct())
    rest, done = _trimmed(rest.filter("src <> dst")), []
    while True:
        core = rest.select(F.col("src").alias("node")).distinct()
        done.append(cut(nodes.join(core, "node", "left_anti").select("node", F.col("node").alias("component"))))
        if rest.isEmpty():
            return reduce(DataFrame.unionAll, done)
        labels = _spread(cut(core.withColumn("label", F.col("node"))), rest)
        ends = cut(rest.join(labels.toDF("src", "a"), "src").join(labels.toDF("dst", "b"), "dst"))
        back = cut(_back(labels, ends.filter("a = b").select(F.col("dst").alias("src"), F.col("src").alias("dst"))))
        done.append(back.select("node", F.col("label").alias("component")))
        nodes = cut(core.join(back, "node", "left_anti"))
        rest = _trimmed(rest.join(nodes.toDF("src"), "src", "left_semi").join(nodes.toDF("dst"), "dst", "left_semi"))
        if len(done) > TABLES:
            done = [cut(reduce(DataFrame.unionAll, done))]


def _trimmed(edges: DataFrame) -> DataFrame:
    """The edges from nodes that an edge enters to nodes that an edge leaves, until all are such."""
    edges = cut(edges)
    n = edges.count()
    while n:
        edges = cut(edges.join(edges.select(F.col("dst").alias("src")).distinct(), "src", "left_semi").join(edges.select(F.col("src").alias("dst")).distinct(), "dst", "left_semi"))
        before, n = n, edges.count()
        if n == before:
            break
    return edges


def _back(labels: DataFrame, backward: DataFrame) -> DataFrame:
    """(node, label) of the nodes from which their label's owner is reached; ``backward`` edges stay within a label."""
    found = news = cut(labels.filter("node = label"))
    tables = [found]
    while True:
        met = news.join(backward, F.col("node") == F.col("src")).select(F.col("dst").alias("node"), "label").distinct()
        news = cut(met.join(reduce(DataFrame.unionAll, tables), "node", "left_anti"))
        if news.isEmpty():
            return reduce(DataFrame.unionAll, tables)
        tables.append(news)
        if len(tables) > TABLES:
            tables = [cut(reduce(DataFrame.unionAll, tables))]


def load_order(edges: DataFrame) -> DataFrame:
    """(node, component, layer): a module can be loaded when all lower layers are.

    ``edges`` has src, which refers to dst. Modules of a cycle have one component and
    one layer. Layer 0 refers to nothing outside its components; every other layer is one
    more than the highest that it refers to. One step for each layer, over those
    components only whose references became settled in the last one.
    """
    edges = cut(edges.filter("src IS NOT NULL AND dst IS NOT NULL").select("src", "dst").distinct())
    found = cut(strong_components(edges))
    ends = edges.join(found.toDF("src", "a"), "src").join(found.toDF("dst", "b"), "dst")
    between = cut(ends.filter("a <> b").select("a", "b").distinct())
    open_ = cut(between.groupBy("a").agg(F.count(F.lit(1)).alias("n")))
    components = found.select("component").distinct()
    ready = cut(components.join(open_.select(F.col("a").alias("component")), "component", "left_anti").withColumn("layer", F.lit(0)))
    tables, layer = [ready], 0
    while not open_.isEmpty():
        layer += 1
        settled = between.join(ready.select(F.col("component").alias("b")), "b", "left_semi").groupBy("a").agg(F.count(F.lit(1)).alias("k"))
        left = cut(open_.join(settled, "a", "left").select("a", (F.col("n") - F.coalesce("k", F.lit(0))).alias("n")))
        ready, open_ = left.filter("n = 0").select(F.col("a").alias("component"), F.lit(layer).alias("layer")), left.filter("n > 0")
        tables.append(ready)
        if len(tables) > TABLES:
            tables = [cut(reduce(DataFrame.unionAll, tables))]
    return found.join(reduce(DataFrame.unionAll, tables), "component").select("node", "component", "layer")
