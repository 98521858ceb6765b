"""Bundling: one manifest and one digest for all that a root reaches."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from brightloom.functions import digests


def manifest(reached: DataFrame, files: DataFrame) -> DataFrame:
    """(root, node, path, length, sha256): the files of every node that a root reaches.

    ``reached`` has root and node, ``files`` has node, path and content (binary). Null
    content is an empty file. A node without files has no row.
    """
    listed = files.select("node", "path", F.length(F.coalesce("content", F.lit(b""))).cast("long").alias("length"), F.sha2(F.coalesce("content", F.lit(b"")), 256).alias("sha256"))
    return reached.select("root", "node").distinct().join(listed, "node").select("root", "node", "path", "length", "sha256")


def bundle(reached: DataFrame, files: DataFrame) -> DataFrame:
    """(root, n_files, n_bytes, digest) for each root; the digest doesn't depend on order.

    It is a tree of SHA-256 digests over node, path and content of each file, so no task
    ever gathers a root's manifest, however large the package.
    """
    return bundle_of(manifest(reached, files))


def bundle_of(rows: DataFrame) -> DataFrame:
    """``bundle`` of a manifest's rows."""
    totals = rows.groupBy("root").agg(F.count(F.lit(1)).alias("n_files"), F.sum("length").alias("n_bytes"))
    members = rows.select("root", digests.member(F.col("node"), F.col("path"), F.col("sha256")).alias("member"))
    return totals.join(digests.tree(members, "root"), "root")
