"""Plain Spark features that the document operators have no counterpart for, offered as extensions."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quire.plans.registry import query
from quire.sources.adapters import table


def asof_join(left: DataFrame, right: DataFrame, key: str, at: str, value: str) -> DataFrame:
    """left with the latest value of right at or before its own time: one union and one running window, no range join.

    Equal times count as before. A hot key's rows are sorted, and may spill, but are not gathered.
    """
    both = left.select(key, at, F.lit(1).alias("side"), F.struct(*left.columns).alias("row"), F.lit(None).cast(right.schema[value].dataType).alias(value))
    other = right.select(key, at, F.lit(0).alias("side"), F.lit(None).cast(both.schema["row"].dataType).alias("row"), F.col(value))
    order = Window.partitionBy(key).orderBy(at, "side").rowsBetween(Window.unboundedPreceding, 0)
    return both.unionByName(other).withColumn(value, F.last(value, ignorenulls=True).over(order)).where("side = 1").select("row.*", value)


@query("SELECT l_returnflag, l_linestatus, count(*) AS n, sum(l_quantity)::DOUBLE AS quantity FROM lineitem GROUP BY CUBE (l_returnflag, l_linestatus)", extension=True)
def ext_cube(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "lineitem").cube("l_returnflag", "l_linestatus").agg(F.count("*").alias("n"), F.sum("l_quantity").alias("quantity"))


@query("SELECT o_orderstatus, o_orderpriority, count(*) AS n, grouping_id(o_orderstatus, o_orderpriority)::BIGINT AS level FROM orders GROUP BY ROLLUP (o_orderstatus, o_orderpriority)", extension=True)
def ext_rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "orders").rollup("o_orderstatus", "o_orderpriority").agg(F.count("*").alias("n"), F.grouping_id().alias("level"))


@query("SELECT o_custkey, o_orderkey, rank() OVER w AS r, dense_rank() OVER w AS d, ntile(4) OVER (PARTITION BY o_custkey ORDER BY o_totalprice, o_orderkey) AS q FROM orders WINDOW w AS (PARTITION BY o_custkey ORDER BY o_orderpriority)", extension=True)
def ext_rank(spark: SparkSession, sf_dir: str) -> DataFrame:
    w = Window.partitionBy("o_custkey")
    return table(spark, sf_dir, "orders").select("o_custkey", "o_orderkey", F.rank().over(w.orderBy("o_orderpriority")).cast("long").alias("r"), F.dense_rank().over(w.orderBy("o_orderpriority")).cast("long").alias("d"), F.ntile(4).over(w.orderBy("o_totalprice", "o_orderkey")).cast("long").alias("q"))


@query("SELECT event_type, date_trunc('hour', ts) AS start, count(*) AS n FROM events GROUP BY ALL", extension=True)
def ext_tumbling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").groupBy("event_type", F.window("ts", "1 hour").alias("w")).agg(F.count("*").alias("n")).select("event_type", F.col("w.start").cast("timestamp_ntz").alias("start"), "n")


@query("WITH g AS (SELECT user_id, ts, coalesce(ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts) >= INTERVAL 2 HOUR, true)::INT AS fresh FROM events), s AS (SELECT user_id, ts, sum(fresh) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS k FROM g) SELECT user_id, min(ts) AS start, count(*) AS n FROM s GROUP BY user_id, k", extension=True)
def ext_session(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = table(spark, sf_dir, "events").groupBy("user_id", F.session_window("ts", "2 hours").alias("w")).agg(F.count("*").alias("n"))
    return s.select("user_id", F.col("w.start").cast("timestamp_ntz").alias("start"), "n")


@query("SELECT e.user_id, e.event_id, e.ts, p.value AS price FROM (SELECT * FROM events WHERE event_type = 'click') e ASOF LEFT JOIN (SELECT user_id, ts, value FROM events WHERE event_type = 'purchase') p ON p.user_id = e.user_id AND p.ts <= e.ts", extension=True)
def ext_asof(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events")
    clicks = e.where("event_type = 'click'").select("user_id", "event_id", "ts")
    return asof_join(clicks, e.where("event_type = 'purchase'").select("user_id", "ts", F.col("value").alias("price")), "user_id", "ts", "price")
