"""What operators store for themselves."""

import threading
from pathlib import Path

from brightloom.llm import common


def files(spark):
    return set(Path(spark.conf.get("spark.checkpoint.dir")).glob("*/tables-*/*")) | set(Path(spark.conf.get("spark.checkpoint.dir")).glob("*/rdd-*"))


def test_scratch_deletes_its_own_tables_and_checkpoints(spark):
    kept = common.stored(spark.range(5).toDF("x"))
    before = files(spark)
    with common.scratch(spark):
        a, b = common.stored(spark.range(3).toDF("x")), common.cut(spark.range(4).toDF("x"))
        assert a.count() == 3 and b.count() == 4 and len(files(spark)) == len(before) + 2
    assert files(spark) == before and kept.count() == 5


def test_scratches_of_two_threads_leave_each_other_alone(spark):
    inside, leave = threading.Event(), threading.Event()
    found = []

    def other():
        with common.scratch(spark):
            table = common.stored(spark.range(7).toDF("x"))
            inside.set()
            leave.wait(60)
            found.append(table.count())

    t = threading.Thread(target=other)
    t.start()
    inside.wait(60)
    with common.scratch(spark):
        common.stored(spark.range(2).toDF("x"))
    leave.set()
    t.join()
    assert found == [7]
