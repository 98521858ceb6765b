"""Helpers that the training-data operators share.

Nothing here holds data: every helper takes a session or a DataFrame.
"""

from __future__ import annotations

import contextlib
import contextvars
import ctypes
import os
import re
import uuid
from collections.abc import Iterator
from pathlib import Path

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from brightloom import session

#: Bytes of text that one partition of a text-heavy stage should hold.
TEXT_PER_TASK = 16 << 20

#: ASCII white space, as the word contracts define it: \x20 and \x09-\x0D.
#: bytes.split() without arguments splits on exactly these.
WORD_SPLIT = re.compile(rb"[^\x20\x09-\x0D]+")

#: Bytes of an Arrow batch.
BATCH = "8m"

_LOWER = bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))


def ascii_lower(data: bytes) -> bytes:
    """Lower-case A-Z only; every other byte stays."""
    return data.translate(_LOWER)


def ship(spark: SparkSession) -> None:
    """Let Python workers find this package where they share the driver's disk, and keep
    their batches small.

    Elsewhere the package comes with ``--py-files`` and the path is not there. Texts
    are long: a batch of thousands of them would take a worker's memory twice over, on
    either side of the pipe.
    """
    if spark.conf.get("spark.sql.execution.arrow.maxBytesPerBatch") != BATCH:
        spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", BATCH)
    env, home = spark.sparkContext.environment, str(Path(__file__).resolve().parents[2])
    if home not in env.get("PYTHONPATH", "").split(os.pathsep):
        env["PYTHONPATH"] = os.pathsep.join(x for x in (home, env.get("PYTHONPATH", "")) if x)


def tidy() -> None:
    """Give freed memory back: workers live on, and what one stage needed would stay theirs."""
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(AttributeError, OSError):
        ctypes.CDLL(None).malloc_trim(0)


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share, the session's ``spark.checkpoint.dir``."""
    ship(spark)
    return session.shared_dir(spark)


def table_path(spark: SparkSession) -> str:
    """A new path for a table, in the application's own folder within the shared one."""
    path = f"{shared_dir(spark)}/tables-{spark.sparkContext.applicationId}/{uuid.uuid4().hex}"
    _note(path)
    return path


#: Paths that were made within the innermost ``scratch``, of this thread.
_MADE: contextvars.ContextVar[list[str] | None] = contextvars.ContextVar("made", default=None)


def _note(path: str) -> None:
    made = _MADE.get()
    if made is not None:
        made.append(path)


def delete(spark: SparkSession, path: str) -> None:
    """Delete a table in whatever store it is."""
    found = spark._jvm.org.apache.hadoop.fs.Path(path)
    found.getFileSystem(spark._jsc.hadoopConfiguration()).delete(found, True)


@contextlib.contextmanager
def scratch(spark: SparkSession) -> Iterator[None]:
    """Tables and checkpoints that this thread makes within go at its end: for work whose result is written by then."""
    token = _MADE.set(made := [])
    try:
        yield
    finally:
        _MADE.reset(token)
        for path in made:
            delete(spark, path)


def cut(df: DataFrame) -> DataFrame:
    """Cut the lineage by a reliable checkpoint in the shared folder."""
    shared_dir(df.sparkSession)
    out = df.checkpoint(eager=True)
    if _MADE.get() is not None:
        file = out._jdf.queryExecution().analyzed().rdd().getCheckpointFile()
        if file.isDefined():
            _note(file.get())
    return out


def stored(df: DataFrame) -> DataFrame:
    """Cut the lineage by a compressed table in the shared folder.

    For wide rows: a checkpoint would write them uncompressed.
    """
    spark = df.sparkSession
    path = table_path(spark)
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def parts(spark: SparkSession, rows: int, per_task: int) -> int:
    """Partitions for so many rows, at least the session's shuffle partitions."""
    return max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-rows // per_task))


def named(column: str, of: str = "") -> F.Column:
    """A column by its very name, whatever characters that has; ``of`` a struct."""
    quoted = "`" + column.replace("`", "``") + "`"
    return F.col(f"{of}.{quoted}" if of else quoted)


def row_of(columns: list[str]) -> F.Column:
    """The columns as one struct ``row``, under their own names."""
    return F.struct(*map(named, columns)).alias("row")


def with_fields(df: DataFrame, columns: list[str], new: str) -> T.StructType:
    """The schema of some columns of ``df`` and of new ones, given as DDL. Never made of
    names put into a string, so columns may have any name."""
    return T.StructType([*(df.schema[c] for c in columns), *T.StructType.fromDDL(new)])


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    ship(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def text_bytes(col) -> F.Column:
    """UTF-8 bytes of a text; none for null."""
    return F.coalesce(F.octet_length(col), F.lit(0)).cast("long")
