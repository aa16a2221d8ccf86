"""Selections as sets, match navigation, snapshots, baselines and scores."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quire.plans.registry import query
from quire.sources.adapters import table


def selection_key(section: Column, block: Column, rows: Column | None = None, cols: Column | None = None) -> Column:
    return F.concat_ws(":", section.cast("string"), block.cast("string"), *[c.cast("string") for c in (rows, cols) if c is not None])


def replace_selection(incoming: DataFrame, key: str = "key", order: str = "ord") -> DataFrame:
    """The incoming anchors, each once, where it first stands."""
    return incoming.groupBy(key).agg(F.min(order).alias(order))


def toggle_selection(held: DataFrame, incoming: DataFrame, key: str = "key") -> DataFrame:
    """Anchors of either side that the other has not."""
    a, b = held.select(key).distinct(), incoming.select(key).distinct()
    return a.subtract(b).union(b.subtract(a))


def union_selection(held: DataFrame, incoming: DataFrame, key: str = "key", order: str = "ord") -> DataFrame:
    """What is held in its order, then what is new in its own; equals keep their first place."""
    both = held.select(key, F.struct(F.lit(0).alias("side"), F.col(order).alias("at")).alias("at")).union(incoming.select(key, F.struct(F.lit(1).alias("side"), F.col(order).alias("at")).alias("at")))
    return both.groupBy(key).agg(F.min("at").alias("at")).select(key, F.col("at.side").alias("side"), F.col("at.at").alias(order))


def step(cursor: Column, count: Column, by: int) -> Column:
    """The next or previous match, round the ends."""
    return F.when(count > 0, F.pmod(cursor + by, count))


def prune_snapshots(saves: DataFrame, now: Column, *, keep: int = 5, days: int = 7) -> DataFrame:
    """Snapshots that stay: of each name the newest, none older than the time to live, of a user's rest the newest few.

    saves: user, name, key, ts.
    """
    newest = F.row_number().over(Window.partitionBy("user", "name").orderBy(F.desc("ts"), F.desc("key")))
    live = saves.withColumn("k", newest).where((F.col("k") == 1) & (F.col("ts") >= now - F.expr(f"interval {days} days")))
    return live.withColumn("rank", F.row_number().over(Window.partitionBy("user").orderBy(F.desc("ts"), F.desc("key"))).cast("long")).where(F.col("rank") <= keep).drop("k")


def band(similarity: Column) -> Column:
    return F.when(similarity >= 0.90, "green").when(similarity >= 0.78, "yellow").otherwise("red")


SEVERITY = ("green", "yellow", "red")


def worst_band(scores: DataFrame, by: list[str]) -> DataFrame:
    """The worst band of a group; a page that only one side has counts as red."""
    rank = F.when(F.col("similarity").isNull(), 2).otherwise(F.element_at(F.create_map(*[F.lit(x) for i, b in enumerate(SEVERITY) for x in (b, i)]), band(F.col("similarity"))))
    return scores.groupBy(*by).agg(F.element_at(F.array(*map(F.lit, SEVERITY)), F.max(rank) + 1).alias("overall"), F.avg("similarity").alias("mean"))


_KEYS = "SELECT event_id % 40 || ':' || user_id AS key, event_id AS ord FROM events WHERE event_type = "


def _anchors(spark: SparkSession, sf_dir: str, kind: str) -> DataFrame:
    return table(spark, sf_dir, "events").where(F.col("event_type") == kind).select(selection_key(F.col("event_id") % 40, F.col("user_id")).alias("key"), F.col("event_id").alias("ord"))


@query(f"SELECT key, min(ord) AS ord FROM ({_KEYS} 'view') GROUP BY key")
def selection_replace(spark: SparkSession, sf_dir: str) -> DataFrame:
    return replace_selection(_anchors(spark, sf_dir, "view"))


@query(f"WITH a AS ({_KEYS} 'view'), b AS ({_KEYS} 'click') (SELECT key FROM a EXCEPT SELECT key FROM b) UNION (SELECT key FROM b EXCEPT SELECT key FROM a)")
def selection_toggle(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toggle_selection(_anchors(spark, sf_dir, "view"), _anchors(spark, sf_dir, "click"))


@query(f"WITH a AS ({_KEYS} 'view'), b AS ({_KEYS} 'click'), u AS (SELECT key, 0 AS side, ord FROM a UNION ALL SELECT key, 1, ord FROM b) SELECT key, side, ord FROM u QUALIFY row_number() OVER (PARTITION BY key ORDER BY side, ord) = 1")
def selection_union(spark: SparkSession, sf_dir: str) -> DataFrame:
    return union_selection(_anchors(spark, sf_dir, "view"), _anchors(spark, sf_dir, "click"))


@query("SELECT user_id, event_id, (n - 1 + 1) % c AS next, (n - 1 - 1 + c) % c AS previous FROM (SELECT user_id, event_id, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS n, count(*) OVER (PARTITION BY user_id) AS c FROM events)")
def match_navigation(spark: SparkSession, sf_dir: str) -> DataFrame:
    own = Window.partitionBy("user_id")
    n, c = F.row_number().over(own.orderBy("event_id")).cast("long") - 1, F.count("*").over(own)
    return table(spark, sf_dir, "events").select("user_id", "event_id", n.alias("n"), c.alias("c")).select("user_id", "event_id", step(F.col("n"), F.col("c"), 1).alias("next"), step(F.col("n"), F.col("c"), -1).alias("previous"))


@query("""WITH s AS (SELECT user_id AS "user", event_id % 9 AS name, event_id AS key, ts FROM events WHERE ts <= TIMESTAMP '2024-01-20'), n AS (SELECT * FROM s QUALIFY row_number() OVER (PARTITION BY "user", name ORDER BY ts DESC, key DESC) = 1)
SELECT "user", name, key, ts, row_number() OVER (PARTITION BY "user" ORDER BY ts DESC, key DESC) AS rank FROM n WHERE ts >= TIMESTAMP '2024-01-20' - INTERVAL 7 DAY QUALIFY rank <= 5""")
def autosave_prune(spark: SparkSession, sf_dir: str) -> DataFrame:
    now = F.lit("2024-01-20").cast(table(spark, sf_dir, "events").schema["ts"].dataType)
    saves = table(spark, sf_dir, "events").where(F.col("ts") <= now).selectExpr("user_id as user", "event_id % 9 as name", "event_id as key", "ts")
    return prune_snapshots(saves, now)


@query("WITH s AS (SELECT l_orderkey AS doc, l_linenumber AS idx, CASE WHEN l_quantity > 48 THEN NULL ELSE 1 - l_discount * 3 END AS similarity FROM lineitem) SELECT doc, ['green', 'yellow', 'red'][max(CASE WHEN similarity IS NULL THEN 2 WHEN similarity >= 0.90 THEN 0 WHEN similarity >= 0.78 THEN 1 ELSE 2 END) + 1] AS overall, count(*) AS pages FROM s GROUP BY doc")
def band_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = table(spark, sf_dir, "lineitem").selectExpr("l_orderkey as doc", "case when l_quantity > 48 then null else 1 - l_discount * 3 end as similarity")
    pages = s.groupBy("doc").agg(F.count("*").alias("pages"))
    return worst_band(s, ["doc"]).join(pages, "doc").select("doc", "overall", "pages")


@query("SELECT c_custkey, c_acctbal, s_acctbal AS baseline, s_acctbal IS NOT NULL AND c_acctbal < s_acctbal AS regressed FROM customer LEFT JOIN supplier ON s_suppkey = c_custkey")
def baseline_left_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    base = table(spark, sf_dir, "supplier").selectExpr("s_suppkey as c_custkey", "s_acctbal as baseline")
    return table(spark, sf_dir, "customer").join(base, "c_custkey", "left").select("c_custkey", "c_acctbal", "baseline", F.coalesce(F.col("c_acctbal") < F.col("baseline"), F.lit(False)).alias("regressed"))


@query("SELECT l_orderkey, l_linenumber, l_suppkey, l_returnflag FROM lineitem l WHERE NOT EXISTS (SELECT 1 FROM supplier s WHERE s.s_suppkey = l.l_suppkey AND (s.s_nationkey < 10 OR l.l_returnflag = 'A'))")
def allowlist_anti_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    allow, seen = table(spark, sf_dir, "supplier"), table(spark, sf_dir, "lineitem")
    return seen.join(allow, (F.col("l_suppkey") == F.col("s_suppkey")) & ((F.col("s_nationkey") < 10) | (F.col("l_returnflag") == "A")), "left_anti").select("l_orderkey", "l_linenumber", "l_suppkey", "l_returnflag")


@query("SELECT vec_id, list_avg(list_transform(list_zip(embedding, embedding[2:]), lambda p: abs(coalesce(p[1], 0)::DOUBLE - coalesce(p[2], 0)::DOUBLE))) < 0.1 AS near FROM embeddings")
def pixel_agreement(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Mean absolute difference of two pixel rows; here a row and itself moved by one."""
    moved = F.concat(F.slice("embedding", F.lit(2), F.size("embedding") - 1), F.array(F.lit(0.0).cast("float")))
    diff = F.zip_with("embedding", moved, lambda a, b: F.abs(a.cast("double") - b.cast("double")))
    return table(spark, sf_dir, "embeddings").select("vec_id", (F.aggregate(diff, F.lit(0.0), lambda a, x: a + x) / F.size("embedding") < 0.1).alias("near"))
