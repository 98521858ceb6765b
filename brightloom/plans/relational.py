"""Relational queries over the star schema."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from brightloom.plans.registry import query, table
from brightloom.streaming import events


@query(
    """SELECT n_name, CAST(sum(CAST(l_extendedprice * (1 - l_discount) AS DECIMAL(18, 4))) AS DOUBLE) AS revenue, count(*) AS n_lines
    FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey
    GROUP BY n_name"""
)
def revenue_by_nation(spark: SparkSession, sf_dir: str) -> DataFrame:
    line = table(spark, sf_dir, "lineitem").select("l_orderkey", (F.col("l_extendedprice") * (1 - F.col("l_discount"))).cast("decimal(18,4)").alias("v"))
    orders = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey")
    customer = table(spark, sf_dir, "customer").select("c_custkey", "c_nationkey")
    nation = table(spark, sf_dir, "nation").select("n_nationkey", "n_name")
    joined = line.join(orders, F.col("l_orderkey") == F.col("o_orderkey")).join(customer, F.col("o_custkey") == F.col("c_custkey"))
    by_key = joined.groupBy("c_nationkey").agg(F.sum("v").alias("v"), F.count(F.lit(1)).alias("n"))
    return by_key.join(nation, F.col("c_nationkey") == F.col("n_nationkey")).groupBy("n_name").agg(F.sum("v").cast("double").alias("revenue"), F.sum("n").alias("n_lines"))


@query(
    """SELECT l_returnflag, l_linestatus, count(*) AS n, CAST(sum(CAST(l_quantity AS DECIMAL(18, 2))) AS DOUBLE) AS sum_qty,
    CAST(sum(CAST(l_extendedprice AS DECIMAL(18, 4))) AS DOUBLE) AS sum_price, min(l_shipdate) AS first_ship, max(l_shipdate) AS last_ship
    FROM lineitem WHERE l_shipdate <= TIMESTAMP '1998-09-02' GROUP BY l_returnflag, l_linestatus"""
)
def pricing_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "lineitem").filter(F.col("l_shipdate") <= F.lit("1998-09-02").cast("timestamp_ntz"))
    return rows.groupBy("l_returnflag", "l_linestatus").agg(
        F.count(F.lit(1)).alias("n"),
        F.sum(F.col("l_quantity").cast("decimal(18,2)")).cast("double").alias("sum_qty"),
        F.sum(F.col("l_extendedprice").cast("decimal(18,4)")).cast("double").alias("sum_price"),
        F.min("l_shipdate").alias("first_ship"),
        F.max("l_shipdate").alias("last_ship"),
    )


@query(
    """SELECT o_orderpriority, count(*) AS n FROM orders
    WHERE EXISTS (SELECT 1 FROM lineitem WHERE l_orderkey = o_orderkey AND l_returnflag = 'R') GROUP BY o_orderpriority"""
)
def orders_with_returns(spark: SparkSession, sf_dir: str) -> DataFrame:
    returned = table(spark, sf_dir, "lineitem").filter("l_returnflag = 'R'").select("l_orderkey")
    orders = table(spark, sf_dir, "orders")
    return orders.join(returned, F.col("o_orderkey") == F.col("l_orderkey"), "left_semi").groupBy("o_orderpriority").agg(F.count(F.lit(1)).alias("n"))


@query("SELECT c_custkey, c_name FROM customer WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey)")
def customers_without_orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = table(spark, sf_dir, "orders").select("o_custkey")
    return table(spark, sf_dir, "customer").join(orders, F.col("c_custkey") == F.col("o_custkey"), "left_anti").select("c_custkey", "c_name")


@query(
    """SELECT c_mktsegment, c_nationkey, CAST(grouping(c_mktsegment) AS INT) AS g_segment, CAST(grouping(c_nationkey) AS INT) AS g_nation, count(*) AS n
    FROM customer GROUP BY ROLLUP (c_mktsegment, c_nationkey)"""
)
def customer_rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "customer").rollup("c_mktsegment", "c_nationkey")
    return rows.agg(F.grouping("c_mktsegment").cast("int").alias("g_segment"), F.grouping("c_nationkey").cast("int").alias("g_nation"), F.count(F.lit(1)).alias("n"))


@query(
    """SELECT o_custkey, o_orderkey, rn FROM (SELECT o_custkey, o_orderkey, CAST(row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey) AS INT) AS rn FROM orders) WHERE rn <= 3"""
)
def latest_orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    w = Window.partitionBy("o_custkey").orderBy(F.desc("o_orderdate"), "o_orderkey")
    return table(spark, sf_dir, "orders").select("o_custkey", "o_orderkey", F.row_number().over(w).alias("rn")).filter("rn <= 3")


@query(
    """SELECT time_bucket(INTERVAL '1 hour', ts) AS hour, event_type, count(*) AS n, count(DISTINCT user_id) AS n_users,
    max(CAST(json_extract_string(props, '$.k') AS INT)) AS max_k FROM events GROUP BY 1, 2"""
)
def hourly_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "events").withColumn("hour", F.date_trunc("hour", "ts").cast("timestamp_ntz"))
    return rows.groupBy("hour", "event_type").agg(F.count(F.lit(1)).alias("n"), F.countDistinct("user_id").alias("n_users"), F.max(F.get_json_object("props", "$.k").cast("int")).alias("max_k"))


@query("SELECT time_bucket(INTERVAL '1 hour', ts) AS hour, event_type, count(*) AS n FROM events GROUP BY 1, 2")
def streamed_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts of an event-time stream by the hour."""
    return events.streamed_counts(spark, f"{sf_dir}/events.parquet").select(F.col("start").cast("timestamp_ntz").alias("hour"), "event_type", "n")


@query(
    """WITH g AS (SELECT user_id, ts, event_id, CASE WHEN ts - lag(ts) OVER w <= INTERVAL '30 minutes' THEN 0 ELSE 1 END AS new FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)),
    s AS (SELECT user_id, ts, sum(new) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS session FROM g)
    SELECT user_id, CAST(session AS BIGINT) AS session, min(ts) AS first_ts, max(ts) AS last_ts, count(*) AS n FROM s GROUP BY user_id, session"""
)
def user_sessions(spark: SparkSession, sf_dir: str) -> DataFrame:
    w = Window.partitionBy("user_id").orderBy("ts", "event_id")
    gap = F.col("ts") - F.lag("ts").over(w)
    rows = table(spark, sf_dir, "events").withColumn("new", F.when(gap <= F.expr("INTERVAL '30' MINUTE"), 0).otherwise(1))
    rows = rows.withColumn("session", F.sum("new").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    return rows.groupBy("user_id", "session").agg(F.min("ts").alias("first_ts"), F.max("ts").alias("last_ts"), F.count(F.lit(1)).alias("n"))


@query("SELECT c_custkey AS k FROM customer INTERSECT SELECT o_custkey FROM orders EXCEPT SELECT s_suppkey FROM supplier")
def key_sets(spark: SparkSession, sf_dir: str) -> DataFrame:
    customers, orders, suppliers = (table(spark, sf_dir, t).select(F.col(c).alias("k")) for t, c in (("customer", "c_custkey"), ("orders", "o_custkey"), ("supplier", "s_suppkey")))
    return customers.intersect(orders).subtract(suppliers)


@query("SELECT p_partkey, p_name, p_retailprice FROM part ORDER BY p_retailprice DESC, p_partkey LIMIT 20")
def dearest_parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "part").select("p_partkey", "p_name", "p_retailprice").orderBy(F.desc("p_retailprice"), "p_partkey").limit(20)
