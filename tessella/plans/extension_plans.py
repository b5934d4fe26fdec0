"""EXT: plans beyond the surveyed operators, over events and the star schema."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessella.plans.registry import plan, t
from tessella.streaming import events as ev


@plan("SELECT time_bucket(INTERVAL 1 HOUR, ts) AS start, event_type, count(*) AS n, round(sum(value), 4) AS total FROM events WHERE ts IS NOT NULL GROUP BY ALL")
def events_tumbling(spark: SparkSession, d: str) -> DataFrame:
    return ev.windowed(t(spark, d, "events"), "1 hour")


@plan("""WITH l AS (SELECT *, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts) < INTERVAL 30 MINUTE THEN 0 ELSE 1 END AS new FROM events WHERE ts IS NOT NULL), s AS (SELECT *, sum(new) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS g FROM l)
SELECT user_id, min(ts) AS start, count(*) AS n, round(sum(value), 4) AS total FROM s GROUP BY user_id, g""")
def events_sessions(spark: SparkSession, d: str) -> DataFrame:
    return ev.sessions(t(spark, d, "events"), "30 minutes")


@plan("""SELECT e.event_id, (SELECT max(p.event_id) FROM events p WHERE p.user_id = e.user_id AND p.event_type = 'view' AND p.event_id < e.event_id) AS last_view FROM events e WHERE e.event_type = 'purchase'""")
def asof_last_view(spark: SparkSession, d: str) -> DataFrame:
    """As-of join without a range join: one ordered pass per user over both kinds."""
    from pyspark.sql import Window

    w = Window.partitionBy("user_id").orderBy("event_id").rowsBetween(Window.unboundedPreceding, -1)
    e = t(spark, d, "events").where(F.col("event_type").isin("view", "purchase"))
    e = e.withColumn("last_view", F.max(F.when(F.col("event_type") == "view", F.col("event_id"))).over(w))
    return e.where("event_type = 'purchase'").select("event_id", "last_view")


@plan("SELECT l_returnflag, l_linestatus, count(*) AS n, round(sum(l_extendedprice), 2) AS price FROM lineitem GROUP BY CUBE (l_returnflag, l_linestatus)")
def cube_rollup(spark: SparkSession, d: str) -> DataFrame:
    return t(spark, d, "lineitem").cube("l_returnflag", "l_linestatus").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("l_extendedprice"), 2).alias("price"))


@plan("""SELECT l_returnflag, l_linestatus, round(sum(l_quantity), 2) AS sum_qty, round(sum(l_extendedprice * (1 - l_discount)), 2) AS disc_price, round(avg(l_discount), 6) AS avg_disc, count(*) AS n FROM lineitem WHERE l_shipdate <= TIMESTAMP '2000-09-02' GROUP BY ALL""")
def pricing_summary(spark: SparkSession, d: str) -> DataFrame:
    li = t(spark, d, "lineitem").where("l_shipdate <= timestamp '2000-09-02'")
    return li.groupBy("l_returnflag", "l_linestatus").agg(F.round(F.sum("l_quantity"), 2).alias("sum_qty"), F.round(F.sum(F.col("l_extendedprice") * (1 - F.col("l_discount"))), 2).alias("disc_price"), F.round(F.avg("l_discount"), 6).alias("avg_disc"), F.count(F.lit(1)).alias("n"))


@plan("""SELECT n_name, r_name, count(DISTINCT o_custkey) AS customers, round(sum(l_extendedprice * (1 - l_discount)), 2) AS revenue FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey GROUP BY ALL""")
def revenue_by_nation(spark: SparkSession, d: str) -> DataFrame:
    li = t(spark, d, "lineitem").groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.sum(F.col("l_extendedprice") * (1 - F.col("l_discount"))).alias("rev"))
    j = li.join(t(spark, d, "orders").select("o_orderkey", "o_custkey"), "o_orderkey").join(t(spark, d, "customer").select(F.col("c_custkey").alias("o_custkey"), F.col("c_nationkey").alias("n_nationkey")), "o_custkey")
    j = j.join(t(spark, d, "nation"), "n_nationkey").join(t(spark, d, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    return j.groupBy("n_name", "r_name").agg(F.countDistinct("o_custkey").alias("customers"), F.round(F.sum("rev"), 2).alias("revenue"))
