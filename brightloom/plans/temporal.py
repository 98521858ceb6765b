"""Joins by order and by overlap, and streams with state, over events and balances."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from brightloom.operators.temporal import asof_join, overlap_join, point_join
from brightloom.plans.registry import query, table
from brightloom.plans.relational import user_sessions
from brightloom.streaming import events, stateful


@query(
    """WITH views AS (SELECT user_id, ts, max(event_id) AS view_id FROM events WHERE event_type = 'view' GROUP BY user_id, ts)
    SELECT e.event_id, e.user_id, e.ts, v.view_id, v.ts AS view_ts FROM (SELECT * FROM events WHERE event_type <> 'view') e
    ASOF LEFT JOIN views v ON e.user_id = v.user_id AND e.ts >= v.ts"""
)
def events_asof_views(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each event that is no view with the last view of its user before it, or at that time."""
    rows = table(spark, sf_dir, "events").select("event_id", "user_id", "ts", "event_type", F.unix_micros(F.col("ts").cast("timestamp")).alias("at"))
    views = rows.filter("event_type = 'view'").select("event_id", "user_id", "ts", "at")
    out = asof_join(rows.filter("event_type <> 'view'"), views, "at", ["user_id"], ["event_id"])
    return out.select("event_id", "user_id", "ts", F.col("match.event_id").alias("view_id"), F.col("match.ts").alias("view_ts"))


_SESSIONS = """WITH g AS (SELECT user_id, ts, event_id, CASE WHEN ts - lag(ts) OVER w <= INTERVAL '30 minutes' THEN 0 ELSE 1 END AS new FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)),
    s AS (SELECT user_id, ts, sum(new) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS session FROM g),
    sessions AS (SELECT user_id, CAST(session AS BIGINT) AS session, min(ts) AS first_ts, max(ts) AS last_ts, count(*) AS n FROM s GROUP BY user_id, session)"""


@query(
    f"""{_SESSIONS} SELECT a.user_id, a.session, b.user_id AS other_id, b.session AS other_session, greatest(a.first_ts, b.first_ts) AS from_ts
    FROM sessions a JOIN sessions b ON a.user_id < b.user_id AND a.first_ts <= b.last_ts AND b.first_ts <= a.last_ts"""
)
def overlapping_sessions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sessions of two users that have a moment in common."""
    micros = lambda c: F.unix_micros(F.col(c).cast("timestamp"))
    # in order of time, so that sessions that meet the same others are next to each other and the pairs' files are small
    rows = user_sessions(spark, sf_dir).withColumns({"a": micros("first_ts"), "z": micros("last_ts")}).orderBy("a", "user_id", "session")
    met = overlap_join(rows, rows, ("a", "z"), ("a", "z")).filter("l.user_id < r.user_id")
    return met.select("l.user_id", "l.session", F.col("r.user_id").alias("other_id"), F.col("r.session").alias("other_session"), F.greatest("l.first_ts", "r.first_ts").alias("from_ts"))


@query(
    """WITH c AS (SELECT c_nationkey, CAST(CAST(c_acctbal AS DECIMAL(18, 2)) * 100 AS BIGINT) AS at FROM customer),
    s AS (SELECT s_suppkey, s_nationkey, CAST(CAST(s_acctbal AS DECIMAL(18, 2)) * 100 AS BIGINT) AS at FROM supplier)
    SELECT s_suppkey, count(*) AS n, CAST(sum(c.at) AS BIGINT) AS cents FROM s JOIN c ON c_nationkey = s_nationkey AND c.at BETWEEN s.at - 50000 AND s.at + 50000 GROUP BY s_suppkey"""
)
def balances_near_suppliers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """For each supplier the customers of its nation whose balance is within 500 of its own."""
    cents = lambda c: (F.col(c).cast("decimal(18,2)") * 100).cast("bigint")
    customers = table(spark, sf_dir, "customer").select(F.col("c_nationkey").alias("nation"), cents("c_acctbal").alias("at"))
    suppliers = table(spark, sf_dir, "supplier").select("s_suppkey", F.col("s_nationkey").alias("nation"), (cents("s_acctbal") - 50000).alias("low"), (cents("s_acctbal") + 50000).alias("high"))
    near = point_join(customers, suppliers, "at", ("low", "high"), ["nation"])
    return near.groupBy("r.s_suppkey").agg(F.count(F.lit(1)).alias("n"), F.sum("l.at").alias("cents"))


@query(
    """SELECT time_bucket(INTERVAL '1 hour', ts) AS hour, event_type, count(*) AS n FROM events GROUP BY 1, 2
    HAVING time_bucket(INTERVAL '1 hour', ts) + INTERVAL '1 hour' <= (SELECT max(ts) FROM events) - INTERVAL '1 hour'"""
)
def streamed_closed_hours(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts of a stream by the hour, each passed on once, when the watermark has closed its hour: state is the open hours."""
    out = stateful.ended(events.tumbling_counts(stateful.opened(spark, f"{sf_dir}/events.parquet")))
    return out.select(F.col("start").cast("timestamp_ntz").alias("hour"), "event_type", "n")


@query(
    f"""{_SESSIONS} SELECT user_id, first_ts, last_ts, n FROM sessions WHERE last_ts + INTERVAL '30 minutes' <= (SELECT max(ts) FROM events) - INTERVAL '1 hour'"""
)
def streamed_sessions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sessions of a stream that its watermark, an hour behind, has closed."""
    out = stateful.ended(stateful.sessions(stateful.opened(spark, f"{sf_dir}/events.parquet"), "user_id"))
    return out.select("user_id", F.col("first").cast("timestamp_ntz").alias("first_ts"), F.col("last").cast("timestamp_ntz").alias("last_ts"), "n")


@query(
    """SELECT v.event_id AS view_id, p.event_id AS purchase_id, v.user_id, v.ts AS view_ts, p.ts AS purchase_ts FROM events v
    JOIN events p ON p.user_id = v.user_id AND p.ts >= v.ts AND p.ts <= v.ts + INTERVAL '1 hour' WHERE v.event_type = 'view' AND p.event_type = 'purchase'"""
)
def streamed_view_purchases(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two streams: views, and purchases of the same user within an hour."""
    of = lambda kind: stateful.opened(spark, f"{sf_dir}/events.parquet").filter(F.col("event_type") == kind).select("event_id", "user_id", "ts")
    out = stateful.ended(stateful.interval_pairs(of("view"), of("purchase"), "user_id"))
    return out.select(F.col("l.event_id").alias("view_id"), F.col("r.event_id").alias("purchase_id"), "l.user_id", F.col("l.ts").alias("view_ts"), F.col("r.ts").alias("purchase_ts"))


@query(
    """WITH RECURSIVE e AS (SELECT event_id, user_id, event_type, ts, row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts, event_id) AS rn FROM events),
    walk AS (SELECT event_id, user_id, event_type, ts, rn, ts AS kept_ts, true AS kept FROM e WHERE rn = 1
    UNION ALL SELECT e.event_id, e.user_id, e.event_type, e.ts, e.rn, CASE WHEN e.ts > w.kept_ts + INTERVAL '1 hour' THEN e.ts ELSE w.kept_ts END, e.ts > w.kept_ts + INTERVAL '1 hour'
    FROM walk w JOIN e ON e.user_id = w.user_id AND e.event_type = w.event_type AND e.rn = w.rn + 1)
    SELECT event_id, user_id, event_type, ts FROM walk WHERE kept"""
)
def streamed_firsts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events of a stream that repeat none of their user and type of the last hour that was passed on."""
    rows = stateful.opened(spark, f"{sf_dir}/events.parquet").select("event_id", "user_id", "event_type", "ts")
    return stateful.ended(stateful.without_repeats(rows, ["user_id", "event_type"]))
