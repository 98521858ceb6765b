import math
import random

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from brightloom.functions import quantiles as q
from brightloom.functions.chains import chains


def within(values, found, share, error):
    """Whether a value's ranks reach to share * n within the error."""
    ordered, n = np.sort(values), len(values)
    low, high = np.searchsorted(ordered, found, "left"), np.searchsorted(ordered, found, "right")
    return low < share * n + error + 1 and high >= share * n - error


@settings(max_examples=150, deadline=None)
@given(st.lists(st.lists(st.integers(-5, 5), max_size=60), max_size=6), st.sampled_from([2, 4, 8]))
def test_the_bound_holds_after_any_merges(parts, width):
    total = q.Summary(width)
    for p in parts:
        one = q.Summary(width)
        one.add(np.array(p, float))
        total.merge(q.Summary.from_bytes(one.to_bytes()))
    values = [float(v) for p in parts for v in p]
    assert total.n == len(values) == sum(len(x) << h for h, x in enumerate(total.levels))
    for v in set(values):
        rank = sum((x <= v).sum() << h for h, x in enumerate(total.levels))
        assert abs(rank - sum(x <= v for x in values)) <= total.error
    if values:
        for share, found in zip((0, 0.3, 0.5, 1), total.quantiles((0, 0.3, 0.5, 1)), strict=True):
            assert within(values, found, share, total.error)


def test_the_bound_is_small():
    s, rnd = q.Summary(), np.random.default_rng(1)
    values = rnd.normal(size=1_000_000)
    s.add(values)
    assert s.error < 0.003 * s.n and sum(map(len, s.levels)) < 12 * q.WIDTH
    assert all(within(values, v, p, s.error) for p, v in zip((0.01, 0.5, 0.99), s.quantiles((0.01, 0.5, 0.99)), strict=True))


def test_groups_are_summarised_before_the_shuffle_and_merged_as_a_tree(spark, monkeypatch):
    monkeypatch.setattr(q, "FAN", 2)
    monkeypatch.setattr(q, "KEYS", 2)
    rnd = random.Random(1)
    rows = [(rnd.choice(["a", "b", "c", None]), rnd.choice([1, None]), rnd.choice([None, rnd.gauss(0, 1), 7.0])) for _ in range(4000)]
    df = spark.createDataFrame(rows, "k string, j int, v double").repartition(7)
    found = q.summaries(df, ["k", "j"], "v", 64)
    assert "MapInArrow" in found._jdf.queryExecution().toString() or "Scan ExistingRDD" in found._jdf.queryExecution().executedPlan().toString()
    out = q.quantiles(found, [0.1, 0.9]).collect()
    assert len(out) == 2 * len({r[:2] for r in rows if r[2] is not None})
    for r in out:
        values = [v for k, j, v in rows if (k, j) == (r.k, r.j) and v is not None]
        assert r.n == len(values) and within(values, r.value, r.share, r.rank_error) and r.rank_error < 0.3 * r.n
    (one,) = q.quantiles(q.summaries(df, [], "v"), [1.0]).collect()
    assert one.value == max(r[2] for r in rows if r[2] is not None) and one.rank_error == 0
    assert q.quantiles(q.summaries(df.limit(0), ["k"], "v"), [0.5]).count() == 0
    nan = spark.createDataFrame([(1.0,), (math.nan,), (None,)], "v double")
    assert [math.isnan(r.value) for r in q.quantiles(q.summaries(nan, [], "v"), [0.5, 1.0]).collect()] == [False, True]


@pytest.mark.parametrize("batch", [1, 10_000])
def test_chains(spark, batch):
    before = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", batch)
    try:
        rows = [(1, 5, "b", 10), (1, 1, "a", 11), (1, 2, "a", 12), (1, 3, None, 13), (1, 6, "a", 14), (1, 9, "b", 15), (2, 1, "b", 16), (2, 2, "a", 17), (None, 1, "a", 18), (None, 2, "b", 19), (3, 1, "a", 20), (4, 1, "b", 21)]
        df = spark.createDataFrame(rows, "k long, t int, s string, id long").repartition(3)
        got = sorted(map(tuple, chains(df, "k", ["t"], "s", ["a", "b"], "id").collect()), key=repr)
        assert got == sorted([(1, 11, 10, 4), (1, 14, 15, 2), (None, 18, 19, 2)], key=repr)
        assert chains(df.limit(0), "k", ["t"], "s", ["a", "b"], "id").count() == 0
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", before)
