"""Pack modules, and all modules they refer to, into one package."""

from __future__ import annotations

import os
import tarfile
import uuid
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.errors import UnsupportedOperationException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from brightloom.operators.bundle import bundle_of, manifest
from brightloom.operators.closure import closure
from brightloom.session import cut
from brightloom.sources import module_tree

#: Bytes of an archive that one task writes as a file, more where its last member is larger.
CHUNK_BYTES = 64 << 20
#: References that a tree can't resolve that ``pack`` names; it counts them all.
NAMED_MISSING = 100


def resolve(spark: SparkSession, tree: str, roots: list[str]) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Reached modules, the tree's files, and references that lead out of the tree."""
    files = module_tree.files(spark, tree)
    edges = module_tree.references(files)
    reached = closure(spark.createDataFrame([(r,) for r in roots], "root string"), edges.filter("local"))
    known = files.select("node").distinct()
    outside = reached.select("root", F.col("node").alias("src")).join(edges, "src").join(known, F.col("dst") == F.col("node"), "left_anti").select("root", "src", "dst").distinct()
    return reached, files, outside


def _placed(listed: DataFrame) -> DataFrame:
    """(root, path, offset, length, size); size is that of header and content, in whole blocks."""

    @F.pandas_udf("long")
    def header(path: pd.Series) -> pd.Series:
        return path.map(lambda x: len(tarfile.TarInfo(x).tobuf(tarfile.PAX_FORMAT)))

    plain = (F.octet_length("path") <= 100) & ~F.col("path").rlike(r"[^\x00-\x7F]") & (F.col("length") < 1 << 33)
    sized = listed.withColumn("size", F.when(plain, F.lit(512).cast("long")).otherwise(header("path")) + F.ceil(F.col("length") / 512) * 512)
    ordered = cut(sized.repartitionByRange("root", "path").withColumn("part", F.spark_partition_id()))
    sums = ordered.groupBy("root", "part").agg(F.sum("size").alias("total"))
    before = Window.partitionBy("root").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    sums = sums.select("root", "part", F.coalesce(F.sum("total").over(before), F.lit(0)).alias("before"))
    within = Window.partitionBy("root", "part").orderBy("path").rowsBetween(Window.unboundedPreceding, -1)
    placed = ordered.withColumn("within", F.coalesce(F.sum("size").over(within), F.lit(0))).join(sums, ["root", "part"])
    return placed.select("root", "path", (F.col("before") + F.col("within")).cast("long").alias("offset"), "length", "size")


def members(listed: DataFrame) -> DataFrame:
    """(root, path, offset, length): where each file stands in its root's archive.

    ``listed`` has root, path and length. Members come in order of their paths, a header
    of 512 bytes (more where the path needs it) and the content in blocks of 512 each.
    Paths are sorted over all partitions, and what each holds is summed first, so one
    package of any size is spread over them.
    """
    return _placed(listed).select("root", "path", "offset", "length")


def _stretches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """From after a member's header to the end of the next one's, without its last byte, which is a zero.

    A stretch ends with the archive where there is no next member.
    """
    for batch in batches:
        out = []
        for content, end, path, length in zip(*(batch.column(c) for c in ("content", "end", "next_path", "next_length")), strict=True):
            data = content.as_py() or b""
            data += b"\0" * (-len(data) % tarfile.BLOCKSIZE)
            if path.is_valid:
                info = tarfile.TarInfo(path.as_py())
                info.size = length.as_py()
                data += info.tobuf(tarfile.PAX_FORMAT)
            else:
                close = 2 * tarfile.BLOCKSIZE
                data += b"\0" * (close + -(end.as_py() + close) % tarfile.RECORDSIZE)
            out.append(data[:-1])
        yield pa.RecordBatch.from_arrays([batch.column("chunk"), batch.column("offset"), pa.array(out, pa.binary())], ["chunk", "offset", "data"])


def write_parts(listed: DataFrame, files: DataFrame, path: str) -> None:
    """Write one root's archive as files in folders ``chunk=0``, ``chunk=1``, ... of ``path``.

    Joined in order of their numbers they are the archive. Each task writes the bytes of
    its own chunk: content goes from the files' rows to the part files, in one shuffle.
    Headers end in a zero byte, so an archive is a text of lines that zero bytes end:
    what stands after one header, to the end of the next. ``listed`` has root, path and
    length, ``files`` has path and content. Nothing listed makes an empty archive.
    """
    spark = listed.sparkSession
    placed = cut(_placed(listed))
    following = placed.select(F.col("offset").alias("end"), F.col("path").alias("next_path"), F.col("length").alias("next_length"))
    content = placed.select("path", "offset", (F.col("offset") + F.col("size")).alias("end")).join(files.select("path", "content"), "path")
    start = spark.createDataFrame([(-1, 0, None)], "offset long, end long, content binary")
    rows = content.select("offset", "end", "content").unionAll(start).join(following, "end", "left")
    rows = rows.withColumn("chunk", F.floor(F.greatest("offset", F.lit(0)) / CHUNK_BYTES)).select("chunk", "offset", "content", "end", "next_path", "next_length")
    lines = rows.mapInArrow(_stretches, "chunk long, offset long, data binary").repartition("chunk").sortWithinPartitions("chunk", "offset")
    lines.select("chunk", F.col("data").cast("string").alias("value")).write.partitionBy("chunk").option("lineSep", "\0").option("compression", "none").text(path)


def join_parts(spark: SparkSession, path: str, out: str) -> bool:
    """Join what ``write_parts`` wrote to one file; whether the file system can do that.

    A local one copies the parts within the kernel, HDFS joins their blocks. Where neither
    is possible the parts stay where they are. Of the parts only names reach the driver.
    """
    hadoop = spark._jvm.org.apache.hadoop.fs
    top = hadoop.Path(path)
    fs = top.getFileSystem(spark._jsc.hadoopConfiguration())
    found = sorted((int(s.getPath().getParent().getName().partition("=")[2]), s.getPath()) for s in fs.globStatus(hadoop.Path(f"{path}/chunk=*/part-*")))
    target = hadoop.Path(out)
    if fs.getUri().getScheme() == "file":
        with open(target.toUri().getPath(), "wb") as joined:
            for _, part in found:
                with open(part.toUri().getPath(), "rb") as source:
                    left = os.fstat(source.fileno()).st_size
                    while left:
                        left -= os.sendfile(joined.fileno(), source.fileno(), None, left)
    else:
        first, *others = (p for _, p in found)
        if others:
            array = spark.sparkContext._gateway.new_array(hadoop.Path, len(others))
            for i, p in enumerate(others):
                array[i] = p
            try:
                fs.concat(first, array)
            except UnsupportedOperationException:
                return False
        fs.delete(target, False)
        fs.rename(first, target)
    fs.delete(top, True)
    return True


def pack(spark: SparkSession, tree: str, root: str, out: str) -> dict:
    """Write ``out``, a tar archive of all files of a module and what it reaches.

    Files keep their places in the tree, so references hold as they are. Tasks write the
    archive's parts, in order of the files' paths and with fixed times and owners, and the
    file system joins them: equal trees make equal archives, and no content passes
    through the driver. Returns the manifest's totals, how many references the tree can't
    resolve, which the package then lacks, and the first NAMED_MISSING of them by name;
    ``parts`` is the folder of the parts where the file system can't join them, else null.
    """
    reached, files, outside = resolve(spark, tree, [root])
    listed = cut(manifest(cut(reached), files))
    parts = f"{out}.parts-{uuid.uuid4().hex}"
    write_parts(listed.select("root", "path", "length"), files, parts)
    joined = join_parts(spark, parts, out)
    total = bundle_of(listed).first()
    gone = cut(outside.select("dst").distinct())
    missing = [r["dst"] for r in gone.orderBy("dst").limit(NAMED_MISSING).collect()]
    return {"root": root, "files": total["n_files"] if total else 0, "bytes": total["n_bytes"] if total else 0, "digest": total["digest"] if total else None, "n_missing": gone.count(), "missing": missing, "parts": None if joined else parts}
