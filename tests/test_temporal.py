import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from brightloom.operators.temporal import _chosen, asof_join, overlap_join, point_join

small = settings(max_examples=6, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
times = st.one_of(st.none(), st.integers(-20, 20))
keys = st.one_of(st.none(), st.sampled_from("ab"))


@small
@given(left=st.lists(st.tuples(keys, times), max_size=12), right=st.lists(st.tuples(keys, times, st.integers(0, 3)), max_size=12), within=st.sampled_from([None, 0, 5]), per=st.sampled_from([1, 3, 1000]))
def test_asof_equals_a_search(spark, left, right, within, per):
    a = spark.createDataFrame([(i, *x) for i, x in enumerate(left)], "id int, k string, t long")
    b = spark.createDataFrame([(i, *x) for i, x in enumerate(right)], "rid int, k string, t long, v int")
    out = asof_join(a, b, "t", ["k"], ["v", "rid"], within, rows_per_task=per).collect()
    got = {r.id: r.match and (r.match.k, r.match.t, r.match.v, r.match.rid) for r in out}
    assert len(out) == len(left)
    for i, (k, t) in enumerate(left):
        near = [(rt, v, j) for j, (rk, rt, v) in enumerate(right) if None not in (k, t, rk, rt) and rk == k and rt <= t and (within is None or t - rt <= within)]
        want = max(near, default=None)
        assert got[i] == (want and (k, want[0], want[1], want[2]))


def test_asof_without_keys_and_one_hot_key(spark):
    a = spark.range(1000).selectExpr("id", "id * 10 AS t")
    b = spark.range(1, 40).selectExpr("id AS rid", "id * 37 AS t")
    df = asof_join(a, b, "t", rows_per_task=50)
    assert all((r.match.rid if r.match else 0) == min(39, r.t // 37) for r in df.collect())
    assert "_stretch" in df._jdf.queryExecution().executedPlan().toString()


ends = st.tuples(st.one_of(st.none(), st.integers(-40, 40)), st.one_of(st.none(), st.integers(-40, 40)))


@small
@given(left=st.lists(st.tuples(keys, ends), max_size=14), right=st.lists(st.tuples(keys, ends), max_size=14), keyed=st.booleans())
def test_overlaps_equal_all_pairs(spark, left, right, keyed):
    a, b = (spark.createDataFrame([(i, k, *e) for i, (k, e) in enumerate(rows)], "id int, k string, a long, z long") for rows in (left, right))
    got = sorted((r.l.id, r.r.id) for r in overlap_join(a, b, ("a", "z"), ("a", "z"), ["k"] if keyed else []).collect())
    good = lambda k, e: None not in e and e[0] <= e[1] and (k is not None or not keyed)
    want = sorted((i, j) for i, (k, x) in enumerate(left) for j, (m, y) in enumerate(right) if good(k, x) and good(m, y) and (k == m or not keyed) and max(x[0], y[0]) <= min(x[1], y[1]))
    assert got == want


@pytest.mark.parametrize("size", [0, 1, 2**40])
def test_points_and_long_ranges(spark, size):
    points = spark.createDataFrame([(i, p) for i, p in enumerate([-(2**41), -1, 0, 1, 2**40, 2**62])], "id int, p long")
    ranges = spark.createDataFrame([(0, size), (-1, size), (-(2**62), 2**62)], "a long, z long")
    got = sorted((r.l.p, r.r.a) for r in point_join(points, ranges, "p", ("a", "z")).collect())
    assert got == sorted((p.p, r.a) for p in points.collect() for r in ranges.collect() if r.a <= p.p <= r.z)


def test_no_nested_loop_in_the_plan(spark):
    a = spark.range(100).selectExpr("id AS a", "id + 5 AS z")
    plan = overlap_join(a, a, ("a", "z"), ("a", "z"))._jdf.queryExecution().executedPlan().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan


def test_rows_are_sent_for_few_levels(spark):
    a = spark.range(1000).selectExpr("id", "id * 1000 AS a", "id * 1000 + IF(id % 20 = 0, shiftleft(1L, CAST(id DIV 20 % 20 AS int)), 0) AS z")
    off = {"spark.sql.adaptive.enabled": "false", "spark.sql.autoBroadcastJoinThreshold": "-1"}
    before = {k: spark.conf.get(k) for k in off}
    try:
        for k, v in off.items():
            spark.conf.set(k, v)
        met = overlap_join(a, a, ("a", "z"), ("a", "z")).select("l.id", F.col("r.id").alias("other"))
        got = {tuple(r) for r in met.collect()}
        left, sent = [met._jdf.queryExecution().executedPlan()], 0
        while left:
            node = left.pop()
            left += [node.children().apply(i) for i in range(node.children().size())]
            sent += node.metrics().apply("shuffleRecordsWritten").value() if node.nodeName() == "Exchange" else 0
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)
    spans = [(r.id, r.a, r.z) for r in a.collect()]
    assert got == {(i, j) for i, x, y in spans for j, v, w in spans if max(x, v) <= min(y, w)}
    assert 0 < sent < 10 * len(spans)


@pytest.mark.parametrize("counts, levels", [({}, []), ({0: 5}, [0]), ({0: 1000, 20: 1, 31: 1}, [20, 31]), ({0: 100000, 20: 1, 31: 1}, [0, 31]), ({0: 1, 30: 9, 31: 9}, [31]), ({k: 1 << 63 - k for k in range(0, 64, 9)}, list(range(0, 64, 9)))])
def test_levels_are_few_for_their_width(counts, levels):
    assert _chosen(counts) == levels
