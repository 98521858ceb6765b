"""Packing queries over a graph made from foreign keys.

Regions, nations, customers and orders stand for modules; each refers to those below
it, a tree of four levels. Suppliers and parts refer to each other, in cycles.
"""

from __future__ import annotations

import uuid
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from brightloom.operators import bundle, closure, difference, order, pack
from brightloom.plans.registry import query, table
from brightloom.session import cut, shared_dir

_EDGES = """edges AS (
    SELECT 'r' || n_regionkey AS src, 'n' || n_nationkey AS dst FROM nation
    UNION SELECT 'n' || c_nationkey, 'c' || c_custkey FROM customer
    UNION SELECT 'c' || o_custkey, 'o' || o_orderkey FROM orders)"""
_REACHED = f"""WITH RECURSIVE {_EDGES}, reached AS (
    SELECT 'r' || r_regionkey AS root, 'r' || r_regionkey AS node, 0 AS depth FROM region
    UNION ALL SELECT root, dst, depth + 1 FROM reached JOIN edges ON node = src)"""


def _pairs(spark: SparkSession, sf_dir: str, name: str, src: str, a: str, dst: str, b: str) -> DataFrame:
    return table(spark, sf_dir, name).select(F.concat(F.lit(src), F.col(a)).alias("src"), F.concat(F.lit(dst), F.col(b)).alias("dst"))


def edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = (("nation", "r", "n_regionkey", "n", "n_nationkey"), ("customer", "n", "c_nationkey", "c", "c_custkey"), ("orders", "c", "o_custkey", "o", "o_orderkey"))
    return reduce(DataFrame.union, (_pairs(spark, sf_dir, *x) for x in found))


def roots(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "region").select(F.concat(F.lit("r"), F.col("r_regionkey")).alias("root"))


@query(f"{_REACHED} SELECT root, CAST(depth AS INT) AS depth, count(*) AS n_modules FROM reached GROUP BY root, depth")
def module_closure(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Recursive resolution: modules reached from each root, by depth."""
    return closure.closure(roots(spark, sf_dir), edges(spark, sf_dir)).groupBy("root", "depth").agg(F.count(F.lit(1)).alias("n_modules"))


def _files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "customer").select(F.concat(F.lit("c"), F.col("c_custkey")).alias("node"), F.col("c_name").alias("path"), F.encode("c_name", "UTF-8").alias("content"))


@query(f"{_REACHED} SELECT root, node, c_name AS path, CAST(strlen(c_name) AS BIGINT) AS length, sha256(c_name) AS sha256 FROM reached JOIN customer ON node = 'c' || c_custkey")
def module_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The files that each root's package holds."""
    return bundle.manifest(closure.closure(roots(spark, sf_dir), edges(spark, sf_dir)), _files(spark, sf_dir))


_ENTRY = "sha256(sha256(node) || sha256(c_name) || sha256(sha256(c_name)))"


@query(
    f"""{_REACHED}, entries AS (SELECT root, strlen(c_name) AS n, {_ENTRY} AS member FROM reached JOIN customer ON node = 'c' || c_custkey),
    cells AS (SELECT root, substr(member, 1, 3) AS cell, count(*) AS n_files, sum(n) AS n_bytes, sha256(string_agg(member, '' ORDER BY member)) AS inner_digest FROM entries GROUP BY 1, 2)
    SELECT root, CAST(sum(n_files) AS BIGINT) AS n_files, CAST(sum(n_bytes) AS BIGINT) AS n_bytes, sha256(string_agg(cell || inner_digest, '' ORDER BY cell)) AS digest FROM cells GROUP BY root"""
)
def module_package(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One package for each root: its files' count, bytes and digest."""
    return bundle.bundle(cut(closure.closure(roots(spark, sf_dir), edges(spark, sf_dir))), _files(spark, sf_dir))


@query(
    f"""{_REACHED} SELECT root, c_name AS path, CAST(strlen(c_name) AS BIGINT) AS length,
    CAST(coalesce(sum(512 + 512 * ((strlen(c_name) + 511) // 512)) OVER (PARTITION BY root ORDER BY encode(c_name) ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS "offset"
    FROM reached JOIN customer ON node = 'c' || c_custkey"""
)
def module_archive(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The members of each root's archive and where they stand in it."""
    reached = closure.closure(roots(spark, sf_dir), edges(spark, sf_dir))
    return pack.members(bundle.manifest(reached, _files(spark, sf_dir)).select("root", "path", "length"))


@query(
    """WITH RECURSIVE edges AS (
    SELECT 'r' || n_regionkey AS src, 'n' || n_nationkey AS dst FROM nation
    UNION SELECT 'n' || s_nationkey, 's' || s_suppkey FROM supplier
    UNION SELECT 's' || l_suppkey, 'p' || l_partkey FROM lineitem
    UNION SELECT 'p' || l_partkey, 's' || l_suppkey FROM lineitem),
    reached AS (SELECT 'r' || r_regionkey AS root, 'r' || r_regionkey AS node FROM region UNION SELECT root, dst FROM reached JOIN edges ON node = src)
    SELECT root, node FROM reached"""
)
def module_cycles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Recursive resolution of a graph full of cycles and diamonds: suppliers refer to parts and back."""
    lines = table(spark, sf_dir, "lineitem").select(F.concat(F.lit("s"), F.col("l_suppkey")).alias("src"), F.concat(F.lit("p"), F.col("l_partkey")).alias("dst"))
    down = _pairs(spark, sf_dir, "nation", "r", "n_regionkey", "n", "n_nationkey").union(_pairs(spark, sf_dir, "supplier", "n", "s_nationkey", "s", "s_suppkey"))
    return closure.closure(roots(spark, sf_dir), down.union(lines).union(lines.select("dst", "src"))).select("root", "node")


_DEAREST = "row_number() OVER (PARTITION BY {} ORDER BY l_extendedprice DESC, l_orderkey, l_linenumber, l_partkey, l_suppkey)"


@query(
    f"""WITH RECURSIVE edges AS (
    SELECT 'r' || n_regionkey AS src, 'n' || n_nationkey AS dst FROM nation
    UNION SELECT 'n' || s_nationkey, 's' || s_suppkey FROM supplier
    UNION SELECT 's' || l_suppkey, 'p' || l_partkey FROM (SELECT *, {_DEAREST.format("l_suppkey")} AS rn FROM lineitem) WHERE rn <= 3
    UNION SELECT 'p' || l_partkey, 's' || l_suppkey FROM (SELECT *, {_DEAREST.format("l_partkey")} AS rn FROM lineitem) WHERE rn = 1),
    nodes AS (SELECT src AS node FROM edges UNION SELECT dst FROM edges),
    reached AS (SELECT node AS a, node AS b FROM nodes UNION SELECT a, dst FROM reached JOIN edges ON b = src),
    found AS MATERIALIZED (SELECT x.a AS node, min(x.b) AS component FROM reached x JOIN reached y ON y.a = x.b AND y.b = x.a GROUP BY x.a),
    between AS (SELECT DISTINCT p.component AS a, q.component AS b FROM edges JOIN found p ON p.node = src JOIN found q ON q.node = dst WHERE p.component <> q.component),
    depths AS (SELECT component, 0 AS d FROM found UNION SELECT a, d + 1 FROM depths JOIN between ON b = component)
    SELECT node, component, CAST(layer AS INT) AS layer FROM found JOIN (SELECT component, max(d) AS layer FROM depths GROUP BY component) USING (component)"""
)
def module_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Load order of a graph with cycles: suppliers refer to the parts of their three dearest
    lines, and each part to the supplier of its dearest."""
    lines = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice")

    def dearest(key: str, n: int) -> DataFrame:
        w = Window.partitionBy(key).orderBy(F.desc("l_extendedprice"), "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey")
        return lines.withColumn("rn", F.row_number().over(w)).filter(F.col("rn") <= n)

    name = lambda kind, key: F.concat(F.lit(kind), F.col(key))
    parts = dearest("l_suppkey", 3).select(name("s", "l_suppkey").alias("src"), name("p", "l_partkey").alias("dst"))
    suppliers = dearest("l_partkey", 1).select(name("p", "l_partkey").alias("src"), name("s", "l_suppkey").alias("dst"))
    down = _pairs(spark, sf_dir, "nation", "r", "n_regionkey", "n", "n_nationkey").union(_pairs(spark, sf_dir, "supplier", "n", "s_nationkey", "s", "s_suppkey"))
    return order.load_order(down.union(parts).union(suppliers))


@query(
    f"""{_REACHED}, files AS (SELECT root, node, c_name AS path, c_custkey, c_name || CASE WHEN c_acctbal < 0 THEN c_mktsegment ELSE '' END AS content FROM reached JOIN customer ON node = 'c' || c_custkey),
    older AS (SELECT root, node, path, sha256(path) AS old_sha256 FROM files WHERE c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_orderpriority = '1-URGENT')),
    newer AS (SELECT root, node, path, sha256(content) AS new_sha256 FROM files WHERE c_custkey IN (SELECT o_custkey FROM orders))
    SELECT coalesce(o.root, n.root) AS root, coalesce(o.node, n.node) AS node, coalesce(o.path, n.path) AS path,
    CASE WHEN old_sha256 IS NULL THEN 'added' WHEN new_sha256 IS NULL THEN 'removed' ELSE 'changed' END AS change, old_sha256, new_sha256
    FROM older o FULL JOIN newer n ON o.root = n.root AND o.node = n.node AND o.path = n.path WHERE old_sha256 IS DISTINCT FROM new_sha256"""
)
def module_difference(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two versions of each root's package: customers without an urgent order, then those with any order,
    and in the second one the segment is added to the files of those in debt."""
    reached = cut(closure.closure(roots(spark, sf_dir), edges(spark, sf_dir)))
    orders = table(spark, sf_dir, "orders")
    customers = table(spark, sf_dir, "customer").select("c_custkey", "c_name", "c_acctbal", "c_mktsegment")
    older = customers.join(orders.filter("o_orderpriority = '1-URGENT'").select(F.col("o_custkey").alias("c_custkey")), "c_custkey", "left_anti")
    newer = customers.join(orders.select(F.col("o_custkey").alias("c_custkey")), "c_custkey", "left_semi")
    added = F.when(F.col("c_acctbal") < 0, F.col("c_mktsegment")).otherwise("")
    at = f"{shared_dir(spark)}/packages-{uuid.uuid4().hex}"
    for name, rows, content in (("old", older, F.col("c_name")), ("new", newer, F.concat("c_name", added))):
        files = rows.select(F.concat(F.lit("c"), F.col("c_custkey")).alias("node"), F.col("c_name").alias("path"), F.encode(content, "UTF-8").alias("content"))
        difference.write_index(bundle.manifest(reached, files), f"{at}/{name}")
    return difference.difference(spark, f"{at}/old", f"{at}/new")
