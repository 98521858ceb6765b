"""Table functions and mergeable aggregates over the tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from brightloom.functions.chains import chains
from brightloom.functions.quantiles import quantiles, summaries
from brightloom.plans.registry import query, table


@query(
    """WITH RECURSIVE e AS (SELECT event_id, user_id, event_type, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS rn FROM events),
    walk AS (SELECT user_id, CAST(0 AS BIGINT) AS rn, 0 AS step, CAST(NULL AS BIGINT) AS first_id, CAST(NULL AS BIGINT) AS first_rn, CAST(NULL AS BIGINT) AS last_id FROM (SELECT DISTINCT user_id FROM events)
    UNION ALL SELECT w.user_id, e.rn, CASE WHEN e.event_type = (['view', 'click', 'purchase'])[w.step + 1] THEN (w.step + 1) % 3 ELSE w.step END,
      CASE WHEN w.step = 0 AND e.event_type = 'view' THEN e.event_id ELSE w.first_id END, CASE WHEN w.step = 0 AND e.event_type = 'view' THEN e.rn ELSE w.first_rn END,
      CASE WHEN w.step = 2 AND e.event_type = 'purchase' THEN e.event_id END
    FROM walk w JOIN e ON e.user_id = w.user_id AND e.rn = w.rn + 1)
    SELECT user_id, first_id, last_id, CAST(rn - first_rn + 1 AS BIGINT) AS n_events FROM walk WHERE last_id IS NOT NULL"""
)
def event_chains(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Runs of a user from a view over a click to a purchase."""
    return chains(table(spark, sf_dir, "events"), "user_id", ["ts", "event_id"], "event_type", ["view", "click", "purchase"], "event_id")


@query()
def price_quantiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quantiles of prices by ship year and flag, each with the bound of its rank's error."""
    lines = table(spark, sf_dir, "lineitem").select(F.year("l_shipdate").alias("year"), "l_returnflag", "l_extendedprice")
    return quantiles(summaries(lines, ["year", "l_returnflag"], "l_extendedprice"), [0.0, 0.01, 0.25, 0.5, 0.75, 0.99, 1.0])
