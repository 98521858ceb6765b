"""Stored indexes of packages, and what differs between two of them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from brightloom.functions import digests

MEMBERS, CELLS, PACKAGES = "members", "cells", "packages"
#: Digits of a cell's name that name the folder of its members.
FOLDER_DIGITS = 2


def write_index(manifest: DataFrame, path: str) -> None:
    """Store the digest tree of each root's package below ``path``, level by level.

    ``packages`` has a digest for each root, ``cells`` one for each cell of a root, and
    ``members`` the manifest's rows in folders of a few cells each, sorted by cell, so that
    a reader of some cells opens their files only. ``manifest`` has root, node, path, length and sha256.
    """
    member = digests.member(F.col("node"), F.col("path"), F.col("sha256"))
    rows = manifest.select("root", "node", "path", "length", "sha256", member.alias("member")).withColumn("cell", digests.cell("member"))
    rows = rows.withColumn("folder", F.substring("cell", 1, FOLDER_DIGITS)).repartition("folder").sortWithinPartitions("folder", "cell")
    rows.write.partitionBy("folder").parquet(f"{path}/{MEMBERS}")
    spark = manifest.sparkSession
    digests.cells(_members(spark, path), "root").write.parquet(f"{path}/{CELLS}")
    digests.top(spark.read.parquet(f"{path}/{CELLS}"), "root").write.parquet(f"{path}/{PACKAGES}")


def _members(spark: SparkSession, path: str) -> DataFrame:
    schema = "root string, node string, path string, length bigint, sha256 string, member string, cell string, folder string"
    return spark.read.schema(schema).parquet(f"{path}/{MEMBERS}")


def difference(spark: SparkSession, old: str, new: str) -> DataFrame:
    """(root, node, path, change, old_sha256, new_sha256): files ``added``, ``removed`` or ``changed`` from one index to another.

    The trees are descended: of roots with equal digests nothing is read, of the others
    the cells, and of the members the cells only that one tree has not or has with
    another digest. A changed file has another digest and so, most likely, another cell;
    both of them differ then, so both of its rows are read. A root that one index lacks
    has all its files removed or added. Files of no difference have no row.
    """
    packages = _outer(spark, old, new, PACKAGES, ["root"], "digest")
    cells = _outer(spark, old, new, CELLS, ["root", "cell"], "inner", packages)
    folders = [r["f"] for r in cells.select(F.substring("cell", 1, FOLDER_DIGITS).alias("f")).distinct().collect()]  # 256 at most

    def read(path: str, name: str) -> DataFrame:
        rows = _members(spark, path).filter(F.col("folder").isin(folders) if folders else F.lit(False))
        return rows.join(cells, ["root", "cell"], "left_semi").select("root", "node", "path", F.col("sha256").alias(name))

    rows = read(old, "old_sha256").join(read(new, "new_sha256"), ["root", "node", "path"], "full")
    change = F.when(F.col("old_sha256").isNull(), "added").when(F.col("new_sha256").isNull(), "removed").otherwise("changed")
    return rows.filter(~F.col("old_sha256").eqNullSafe(F.col("new_sha256"))).select("root", "node", "path", change.alias("change"), "old_sha256", "new_sha256")


def _outer(spark: SparkSession, old: str, new: str, level: str, keys: list[str], digest: str, within: DataFrame | None = None) -> DataFrame:
    """Keys of a level whose digests differ, of the roots that differ above it."""
    a, b = (spark.read.parquet(f"{path}/{level}").withColumnRenamed(digest, name) for path, name in ((old, "a"), (new, "b")))
    if within is not None:
        a, b = (x.join(within, "root", "left_semi") for x in (a, b))
    return a.join(b, keys, "full").filter(~F.col("a").eqNullSafe(F.col("b"))).select(*keys)
