"""A table function over sorted partitions: chains of steps."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql.functions import arrow_udtf


def chains(events: DataFrame, key: str, order: Sequence[str], step: str, steps: Sequence[str], id_col: str) -> DataFrame:
    """(key, first_id, last_id, n_events): complete runs through ``steps`` of each key's events.

    A key's events are taken in ``order``, the first of which should be unique with the
    others. One that is the next step is part of the run, every other is passed over, and
    after the last step a new run begins. ``n_events`` counts all events from the first to
    the last one of a run. ``key`` and ``id_col`` are longs; null keys are a key of their
    own, null steps are passed over. An Arrow table function: keys are shuffled and sorted
    by Spark, and a partition is read batch by batch, so a key of any size takes the memory
    of one batch.
    """
    wanted, columns = list(steps), (key, step, id_col)

    @arrow_udtf(returnType="key bigint, first_id bigint, last_id bigint, n_events bigint")
    class Chains:
        def __init__(self) -> None:
            self.at, self.first, self.seen = 0, None, 0

        def eval(self, batch: pa.RecordBatch) -> Iterator[pa.Table]:
            out: list[list] = [[], [], [], []]
            for k, name, event in zip(*(batch.column(c).to_pylist() for c in columns), strict=True):
                self.seen += 1
                if name != wanted[self.at]:
                    continue
                if self.at == 0:
                    self.first, self.seen = event, 1
                self.at += 1
                if self.at == len(wanted):
                    for column, v in zip(out, (k, self.first, event, self.seen), strict=True):
                        column.append(v)
                    self.at = 0
            yield pa.table({n: pa.array(c, pa.int64()) for n, c in zip(("key", "first_id", "last_id", "n_events"), out, strict=True)})

    found = Chains(events.select(*dict.fromkeys((*columns, *order))).asTable().partitionBy(key).orderBy(*order))
    return found.withColumnRenamed("key", key)
