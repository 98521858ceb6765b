"""Trees of infrastructure modules: files in, references between modules out."""

from __future__ import annotations

import posixpath
import re
from functools import reduce

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from brightloom.session import cut

_TOKEN = re.compile(r'#[^\n]*|//[^\n]*|/\*.*?\*/|<<[-~]?(\w+)\n.*?\n\s*\1\b|"(?:[^"\\]|\\.)*"|[{}]|[A-Za-z_][\w-]*|=|\S', re.S)


#: Names of empty files that the driver holds before it stores them.
EMPTY_FILES = 10_000
#: Files that make a folder a module.
CONFIGURATION = r"\.(?:tf|tofu|hcl)$"


def files(spark: SparkSession, root: str) -> DataFrame:
    """(node, path, content): every file under a folder; node is its module.

    That is the nearest folder up from the file that holds configuration: data and
    templates in folders of their own belong to the module above them.
    Read by Spark's binary source, so the folder may be in any store. Hidden folders
    (what tools have fetched or cached) are left out.
    """
    rows = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(root)
    base = spark._jvm.org.apache.hadoop.fs.Path(root)
    base = base.getFileSystem(spark._jsc.hadoopConfiguration()).makeQualified(base).toUri().getPath().rstrip("/")
    rows = rows.select("path", "content").unionAll(_empty(spark, root))
    path = F.regexp_replace(F.col("path"), r"^[a-z][a-z0-9+.-]*:(?://[^/]*)?", "")
    rows = rows.select(path.alias("full"), "content").withColumn("path", F.expr(f"substring(full, {len(base) + 2})"))
    rows = rows.filter(~F.col("path").rlike(r"(?:^|/)\.[^/]+/"))
    parts = F.split("path", "/")
    above = F.transform(F.sequence(F.lit(0), F.size(parts) - 1), lambda i: F.when(i == 0, F.lit(".")).otherwise(F.array_join(F.slice(parts, F.lit(1), i), "/")))
    folders = rows.select("path", above.alias("above"))
    modules = folders.filter(F.col("path").rlike(CONFIGURATION)).select(F.element_at("above", -1).alias("node")).distinct()
    owner = folders.select("path", F.explode("above").alias("node")).join(modules, "node").groupBy("path").agg(F.max_by("node", F.when(F.col("node") == ".", 0).otherwise(F.length("node"))).alias("node"))
    own = F.element_at(above, -1)
    return rows.join(owner, "path", "left").select(F.coalesce("node", own).alias("node"), "path", "content")


def _empty(spark: SparkSession, root: str) -> DataFrame:
    """(path, content) of empty files, which the binary source leaves out.

    Listed one by one; the driver holds EMPTY_FILES of their names at most.
    """
    top = spark._jvm.org.apache.hadoop.fs.Path(root)
    listed = top.getFileSystem(spark._jsc.hadoopConfiguration()).listFiles(top, True)
    found, tables = [], []
    while listed.hasNext():
        status = listed.next()
        if status.getLen() == 0:
            found.append((status.getPath().toString(), bytearray()))
            if len(found) == EMPTY_FILES:
                tables.append(cut(spark.createDataFrame(found, "path string, content binary")))
                found = []
    return reduce(DataFrame.unionAll, tables, spark.createDataFrame(found, "path string, content binary"))


def sources(text: str) -> list[str]:
    """Sources of the module blocks of one file, comments and strings minded."""
    found: list[str] = []
    depth, inside, words = 0, 0, []
    for m in _TOKEN.finditer(text):
        t = m[0]
        if t[:1] == "#" or t[:2] in ("//", "/*", "<<"):
            continue
        if t == "{":
            depth += 1
            if depth == 1 and len(words) >= 2 and words[-2] == "module":
                inside = depth
            words = []
        elif t == "}":
            if depth == inside:
                inside = 0
            depth -= 1
            words = []
        else:
            if inside and depth == inside and len(words) >= 2 and words[-2:] == ["source", "="] and t[0] == '"':
                found.append(t[1:-1])
            words = [*words[-2:], t]
    return found


def references(found: DataFrame) -> DataFrame:
    """(src, dst, local): what each module refers to. Local sources are resolved
    against the module's folder, others stay as written."""

    @F.pandas_udf("array<string>")
    def parsed(content: pd.Series) -> pd.Series:
        return content.map(lambda x: sources(bytes(x).decode("utf-8", "replace")) if x is not None else [])

    @F.pandas_udf("string")
    def resolved(src: pd.Series, dst: pd.Series) -> pd.Series:
        return pd.Series([posixpath.normpath(posixpath.join(s, d)) if d.startswith(("./", "../")) or d in (".", "..") else d for s, d in zip(src, dst, strict=True)], dtype=object)

    each = found.filter(F.col("path").rlike(CONFIGURATION)).select(F.col("node").alias("src"), F.explode(parsed("content")).alias("source"))
    return each.select("src", resolved("src", "source").alias("dst"), F.col("source").rlike(r"^\.\.?(?:/|$)").alias("local")).distinct()
