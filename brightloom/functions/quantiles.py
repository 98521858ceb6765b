"""Mergeable quantile summaries with an error bound of their own."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from brightloom.session import cut

#: Values that a level of a summary holds; an even number.
WIDTH = 4096
#: Summaries that one task merges for a key, and keys that a task summarises at a time.
FAN, KEYS = 32, 64


class Summary:
    """Values at levels: one at level h stands for 2 ** h.

    A level that is full is sorted, and every second value moves up, the even and the odd
    ones in turn. That moves the rank of any value by 2 ** h at most, so the sum of
    these is a bound that holds for certain; it is kept beside the values. It comes to
    about n / WIDTH for each level, and there are log2(n / WIDTH) of them.
    """

    def __init__(self, width: int = WIDTH) -> None:
        self.width, self.n, self.error, self.turns = width, 0, 0, 0
        self.levels: list[np.ndarray] = [np.empty(0)]

    def add(self, values: np.ndarray) -> None:
        self.n += len(values)
        for at in range(0, len(values), self.width):
            self.levels[0] = np.concatenate([self.levels[0], values[at : at + self.width]])
            self._compact()

    def merge(self, other: Summary) -> None:
        self.n, self.error = self.n + other.n, self.error + other.error
        self.levels += [np.empty(0)] * (len(other.levels) - len(self.levels))
        for h, values in enumerate(other.levels):
            self.levels[h] = np.concatenate([self.levels[h], values])
        self._compact()

    def _compact(self) -> None:
        h = 0
        while h < len(self.levels):
            if len(self.levels[h]) > self.width:
                values = np.sort(self.levels[h])
                even = len(values) // 2 * 2
                moved, self.levels[h] = values[self.turns % 2 : even : 2], values[even:]
                self.turns, self.error = self.turns + 1, self.error + (1 << h)
                if h + 1 == len(self.levels):
                    self.levels.append(np.empty(0))
                self.levels[h + 1] = np.concatenate([self.levels[h + 1], moved])
            h += 1

    def quantiles(self, shares: Sequence[float]) -> list[float]:
        """The values whose ranks are nearest from above to shares of n, each off by ``error`` at most."""
        values = np.concatenate(self.levels)
        weights = np.repeat([1 << h for h in range(len(self.levels))], [len(x) for x in self.levels])
        order = np.argsort(values, kind="stable")
        ranks = np.cumsum(weights[order])
        at = np.searchsorted(ranks, [max(1, np.ceil(s * self.n)) for s in shares])
        return values[order][np.minimum(at, len(values) - 1)].tolist()

    def to_bytes(self) -> bytes:
        head = [self.width, self.n, self.error, self.turns, len(self.levels), *map(len, self.levels)]
        return np.array(head, "<i8").tobytes() + np.concatenate(self.levels).astype("<f8").tobytes()

    @classmethod
    def from_bytes(cls, data: bytes) -> Summary:
        width, n, error, turns, count = np.frombuffer(data, "<i8", 5).tolist()
        sizes = np.frombuffer(data, "<i8", count, 40)
        out = cls(width)
        out.n, out.error, out.turns = n, error, turns
        out.levels = np.split(np.frombuffer(data, "<f8", -1, 40 + 8 * count), np.cumsum(sizes)[:-1])
        return out


def summaries(rows: DataFrame, by: Sequence[str], value: str, width: int = WIDTH) -> DataFrame:
    """(by..., summary): one summary of the values of each group.

    Tasks summarise what they read before anything is shuffled, and summaries are merged
    as a tree, FAN at a time, so a group of any size is never in one task. Null values are
    left out, and groups of none with them; a NaN is larger than all others. Keys are of any type that can
    be grouped by.
    """
    keyed = rows.select(*by, F.col(value).cast("double").alias("value")).filter("value IS NOT NULL")
    names = list(by)
    schema = T.StructType([*(keyed.schema[c] for c in by), T.StructField("summary", T.BinaryType()), T.StructField("part", T.IntegerType())])

    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part, held = TaskContext.get().partitionId(), {}

        def out() -> pa.RecordBatch:
            columns = [pa.array([k[i] for k in held], field.type) for i, field in enumerate(fields)]
            return pa.RecordBatch.from_arrays([*columns, pa.array([s.to_bytes() for s in held.values()], pa.binary()), pa.array([part] * len(held), pa.int32())], [*names, "summary", "part"])

        fields: list[pa.Field] = []
        for batch in batches:
            fields = [batch.schema.field(c) for c in names]
            table = pa.Table.from_batches([batch])
            for group in table.group_by(names, use_threads=False).aggregate([("value", "list")]).to_batches() if names else [batch]:
                lists = group.column("value_list") if names else [pa.scalar(batch.column("value").to_pylist())]
                for i, values in enumerate(lists):
                    key = tuple(group.column(c)[i].as_py() for c in names)
                    if key not in held and len(held) >= KEYS:
                        yield out()
                        held.clear()
                    held.setdefault(key, Summary(width)).add(np.array(values.as_py(), np.float64))
        if held:
            yield out()

    def merged(table: pa.Table) -> pa.Table:
        total = Summary(width)
        for s in table["summary"]:
            total.merge(Summary.from_bytes(s.as_py()))
        head = table.slice(0, 1)
        return pa.table([*(head[c] for c in names), pa.array([total.to_bytes()], pa.binary()), pa.array([head["part"][0].as_py() // FAN], pa.int32())], names=[*names, "summary", "part"])

    found = cut(keyed.mapInArrow(partial, schema))
    left = (found.agg(F.max("part")).first()[0] or 0) + 1
    while True:
        found = found.groupBy(*names, F.floor(F.col("part") / FAN).cast("int").alias("_to")).applyInArrow(merged, schema)
        left = -(-left // FAN)
        if left <= 1:
            return found.select(*names, "summary")


def quantiles(found: DataFrame, shares: Sequence[float]) -> DataFrame:
    """(by..., share, value, n, rank_error) of each summary: the value's true rank is within rank_error of share * n."""
    names = [c for c in found.columns if c != "summary"]
    schema = T.StructType([*(found.schema[c] for c in names), *T.StructType.fromDDL("share double, value double, n bigint, rank_error bigint")])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            each = [Summary.from_bytes(s.as_py()) for s in batch.column("summary")]
            take = pa.array(np.repeat(np.arange(len(each)), len(shares)))
            flat = [pa.array([v for s in each for v in column(s)], kind) for column, kind in ((lambda s: shares, pa.float64()), (lambda s: s.quantiles(shares), pa.float64()), (lambda s: [s.n] * len(shares), pa.int64()), (lambda s: [s.error] * len(shares), pa.int64()))]
            yield pa.RecordBatch.from_arrays([*(batch.column(c).take(take) for c in names), *flat], schema.names)

    return found.mapInArrow(run, schema)
