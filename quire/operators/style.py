"""Style pools: resolution, interning, normalisation, classification, run boundaries."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quire.functions import text as X
from quire.plans.registry import query
from quire.sources.adapters import table


def pool_key(ref: Column) -> Column:
    """A reference as an unsigned number, or null: blanks around it are trimmed, signs refused."""
    value = F.btrim(ref).try_cast("bigint")
    return F.when((value >= 0) & ~F.startswith(F.btrim(ref), F.lit("-")), value)


def resolve_pool(rows: DataFrame, ref: str, pool: DataFrame) -> DataFrame:
    """rows with idx, the pool entry that ref names; 0, the default entry, where it names none. pool: xml_id, idx.

    Spark chooses a broadcast by the pool's measured size; nothing forces one.
    """
    keyed = rows.withColumn("_key", pool_key(F.col(ref)))
    return keyed.join(pool.select(F.col("xml_id").alias("_key"), "idx"), "_key", "left").withColumn("idx", F.coalesce("idx", F.lit(0).cast("long"))).drop("_key")


def intern(rows: DataFrame, shape: list[str], position: str, *, parts: int = 64) -> DataFrame:
    """Distinct shapes numbered from 1 in the order in which they are first seen.

    Numbers run within parts of the positions, whose bounds are approximate quantiles; each part's numbers begin
    where the counts of those before end. Any bounds give the same numbers. position is a number.
    """
    first = rows.groupBy(*shape).agg(F.min(position).alias("first_seen"))
    bounds = sorted(set(first.approxQuantile("first_seen", [k / parts for k in range(1, parts)], 0.01)))
    part = F.lit(0)
    for k in bounds:
        part = part + (F.coalesce(F.col("first_seen"), F.lit(float("-inf"))) > k).cast("int")
    first = first.withColumn("_part", part)
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)  # over at most `parts` rows
    offsets = first.groupBy("_part").agg(F.count("*").alias("n")).select("_part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("_before"))
    own = F.row_number().over(Window.partitionBy("_part").orderBy("first_seen", *shape))
    return first.withColumn("idx", own.cast("long")).join(offsets, "_part").withColumn("idx", F.col("idx") + F.col("_before")).drop("_part", "_before")


def mode(rows: DataFrame, by: list[str], value: str) -> DataFrame:
    """The most frequent value of each group, the least of equals."""
    counted = rows.groupBy(*by, value).agg(F.count("*").alias("n"))
    return counted.groupBy(*by).agg(F.min_by(value, F.struct(-F.col("n"), F.col(value))).alias("mode"), F.max("n").alias("n"))


def spacing_collapse(used: DataFrame, pool: DataFrame) -> DataFrame:
    """(doc_id, loose share, tight entries, target, applied): whether most paragraphs stand on a loose line spacing
    although the pool holds several tight ones; the target is the most frequent tight spacing.

    used: doc_id, spacing of each paragraph; pool: doc_id, spacing of each entry.
    """
    loose = used.groupBy("doc_id").agg(F.count("*").alias("paras"), F.count_if(F.col("spacing") >= 150).alias("loose"))
    tight = pool.where(F.col("spacing").between(100, 145))
    size = tight.groupBy("doc_id").agg(F.count("*").alias("tight"))
    target = mode(tight, ["doc_id"], "spacing").select("doc_id", F.col("mode").alias("target"))
    joined = loose.join(size, "doc_id", "left").join(target, "doc_id", "left")
    tight_n = F.coalesce("tight", F.lit(0).cast("long"))
    return joined.select("doc_id", "paras", "loose", tight_n.alias("tight"), "target", ((F.col("loose") * 10 >= F.col("paras") * 6) & (tight_n >= 5)).alias("applied"))


def style_runs(bounds: DataFrame, totals: DataFrame) -> DataFrame:
    """(doc_id, start, end, shape): each boundary's shape holds until the next; a gap before the first has shape 0; empty runs are dropped.

    bounds: doc_id, start, shape, ord; totals: doc_id, total.
    """
    order = Window.partitionBy("doc_id").orderBy("start", "ord")
    runs = bounds.join(totals, "doc_id").withColumn("end", F.coalesce(F.lead("start").over(order), F.col("total"))).select("doc_id", "start", "end", "shape")
    gap = bounds.groupBy("doc_id").agg(F.min("start").alias("end")).select("doc_id", F.lit(0).cast("long").alias("start"), "end", F.lit(0).cast("long").alias("shape"))
    return runs.unionByName(gap).where("start < end")


def splice_markers(runs: DataFrame, markers: DataFrame) -> DataFrame:
    """Runs and field markers in one order: a marker stands before the first run that starts at or after it.

    At one place ends come before begins, and begins before fields without length.
    """
    kinds = F.when(F.col("kind") == "end", 0).when(F.col("kind") == "begin", 1).otherwise(2)
    left = runs.select("doc_id", "start", F.lit(3).alias("rank"), F.col("run").alias("ord"), F.lit("run").alias("kind"))
    right = markers.select("doc_id", F.col("pos").alias("start"), kinds.alias("rank"), F.col("marker").alias("ord"), "kind")
    at = Window.partitionBy("doc_id").orderBy("start", "rank", "ord")
    return left.unionByName(right).withColumn("place", F.row_number().over(at).cast("long"))


def missing_references(refs: DataFrame, pool: DataFrame) -> DataFrame:
    """References that no pool entry answers."""
    return refs.join(pool, "ref", "left_anti")


@query("SELECT o_orderkey AS doc_id, o_orderpriority AS char_ref, coalesce(p.idx, 0)::BIGINT AS idx FROM orders LEFT JOIN (SELECT p_partkey AS xml_id, p_partkey + 1 AS idx FROM part) p ON p.xml_id = o_custkey * 2")
def pool_resolve_left_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    runs = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("doc_id"), F.col("o_orderpriority").alias("char_ref"), F.concat(F.lit(" "), (F.col("o_custkey") * 2).cast("string"), F.lit(" ")).alias("ref"))
    pool = table(spark, sf_dir, "part").selectExpr("p_partkey as xml_id", "p_partkey + 1 as idx")
    return resolve_pool(runs, "ref", pool).select("doc_id", "char_ref", "idx")


@query("SELECT p_type, p_brand, first_seen, row_number() OVER (ORDER BY first_seen, p_type, p_brand) AS idx FROM (SELECT p_type, p_brand, min(p_partkey) AS first_seen FROM part GROUP BY ALL)")
def intern_shapes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return intern(table(spark, sf_dir, "part"), ["p_type", "p_brand"], "p_partkey")


@query("SELECT p_brand, p_size::BIGINT AS mode, n FROM (SELECT p_brand, p_size, count(*) AS n, row_number() OVER (PARTITION BY p_brand ORDER BY count(*) DESC, p_size) AS k FROM part GROUP BY p_brand, p_size) WHERE k = 1")
def mode_min_tie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mode(table(spark, sf_dir, "part"), ["p_brand"], "p_size").select("p_brand", F.col("mode").cast("long"), "n")


@query("""WITH used AS (SELECT l_suppkey AS doc_id, 100 + (l_quantity * 2)::BIGINT AS spacing FROM lineitem WHERE l_quantity > 10), pool AS (SELECT p_partkey % 100 AS doc_id, 100 + p_size::BIGINT * 2 AS spacing FROM part),
loose AS (SELECT doc_id, count(*) AS paras, count(*) FILTER (spacing >= 150) AS loose FROM used GROUP BY doc_id), tight AS (SELECT * FROM pool WHERE spacing BETWEEN 100 AND 145),
size AS (SELECT doc_id, count(*) AS tight FROM tight GROUP BY doc_id), target AS (SELECT doc_id, spacing AS target FROM (SELECT doc_id, spacing, row_number() OVER (PARTITION BY doc_id ORDER BY count(*) DESC, spacing) AS k FROM tight GROUP BY doc_id, spacing) WHERE k = 1)
SELECT l.doc_id, paras, loose, coalesce(tight, 0) AS tight, target, loose * 10 >= paras * 6 AND coalesce(tight, 0) >= 5 AS applied FROM loose l LEFT JOIN size s ON s.doc_id = l.doc_id LEFT JOIN target t ON t.doc_id = l.doc_id""")
def normalize_fingerprint(spark: SparkSession, sf_dir: str) -> DataFrame:
    used = table(spark, sf_dir, "lineitem").where("l_quantity > 10").selectExpr("l_suppkey as doc_id", "100 + cast(l_quantity * 2 as long) as spacing")
    pool = table(spark, sf_dir, "part").selectExpr("p_partkey % 100 as doc_id", "100 + cast(p_size as long) * 2 as spacing")
    return spacing_collapse(used, pool)


@query("SELECT p_partkey, p_name, CASE WHEN contains(n, 'serif') OR contains(n, 'times') THEN 'serif' WHEN contains(n, 'gothic') OR contains(n, 'sans') THEN 'gothic' ELSE 'other' END AS class, CASE WHEN p_size % 4 = 2 AND p_size BETWEEN 2 AND 10 THEN 'serif' WHEN p_size % 4 = 2 AND p_size BETWEEN 11 AND 15 THEN 'gothic' END AS panose FROM (SELECT *, CASE WHEN p_brand < 'Brand#15' THEN p_name || ' Gothic' WHEN p_brand < 'Brand#2' THEN p_name || ' Serif' ELSE p_name END.lower() AS n FROM part)".replace("CASE WHEN p_brand < 'Brand#15' THEN p_name || ' Gothic' WHEN p_brand < 'Brand#2' THEN p_name || ' Serif' ELSE p_name END.lower()", "lower(CASE WHEN p_brand < 'Brand#15' THEN p_name || ' Gothic' WHEN p_brand < 'Brand#2' THEN p_name || ' Serif' ELSE p_name END)"))
def font_classify(spark: SparkSession, sf_dir: str) -> DataFrame:
    name = F.when(F.col("p_brand") < "Brand#15", F.concat("p_name", F.lit(" Gothic"))).when(F.col("p_brand") < "Brand#2", F.concat("p_name", F.lit(" Serif"))).otherwise(F.col("p_name"))
    return table(spark, sf_dir, "part").select("p_partkey", "p_name", X.font_class(name).alias("class"), X.panose_class(F.col("p_size") % 4, F.col("p_size")).alias("panose"))


@query("""SELECT p_partkey, CASE p_size % 4 WHEN 0 THEN printf('#%02x%02x%02x', p_size, p_size * 2, p_size * 3) WHEN 1 THEN printf('#%x%x%x%x%x%x', p_size % 16, p_size % 16, p_size % 7, p_size % 7, p_size % 3, p_size % 3) WHEN 2 THEN p_size || 'pt' ELSE p_size || '.5px' END AS value FROM part""")
def css_normalize(spark: SparkSession, sf_dir: str) -> DataFrame:
    size = F.col("p_size")
    value = F.when(size % 4 == 0, F.format_string(" #%02X%02X%02X", size, size * 2, size * 3)).when(size % 4 == 1, F.format_string("#%X%X%X", size % 16, size % 7, size % 3)).when(size % 4 == 2, F.format_string("%d.0pt ", size)).otherwise(F.format_string("%d.50px", size))
    prop = F.when(size % 4 < 2, F.lit("background-color")).otherwise(F.lit("font-size"))
    return table(spark, sf_dir, "part").select("p_partkey", X.normalize_css(prop, value).alias("value"))


_BOUNDS = "WITH bound AS (SELECT user_id AS doc_id, (event_id % 800 + 5) AS start, event_id % 7 + 1 AS shape, event_id AS ord FROM events WHERE event_type = 'view'), total AS (SELECT DISTINCT doc_id, 900::BIGINT AS total FROM bound)"


@query(_BOUNDS + """ SELECT doc_id, start, "end", shape FROM (SELECT b.doc_id, start, coalesce(lead(start) OVER (PARTITION BY b.doc_id ORDER BY start, ord), total) AS "end", shape FROM bound b JOIN total t ON t.doc_id = b.doc_id
UNION ALL SELECT doc_id, 0, min(start), 0 FROM bound GROUP BY doc_id) WHERE start < "end" """)
def style_run_lead(spark: SparkSession, sf_dir: str) -> DataFrame:
    bounds = table(spark, sf_dir, "events").where("event_type = 'view'").selectExpr("user_id as doc_id", "event_id % 800 + 5 as start", "event_id % 7 + 1 as shape", "event_id as ord")
    return style_runs(bounds, bounds.select("doc_id").distinct().withColumn("total", F.lit(900).cast("long")))


@query("""WITH run AS (SELECT user_id AS doc_id, event_id % 50 AS start, event_id AS ord FROM events WHERE event_type = 'view'), marker AS (SELECT user_id AS doc_id, event_id % 50 AS pos, event_id AS ord, CASE WHEN event_type = 'click' THEN 'begin' WHEN event_type = 'error' THEN 'end' ELSE 'point' END AS kind FROM events WHERE event_type IN ('click', 'error', 'signup')),
both_ AS (SELECT doc_id, start, 3 AS rank, ord, 'run' AS kind FROM run UNION ALL SELECT doc_id, pos, CASE kind WHEN 'end' THEN 0 WHEN 'begin' THEN 1 ELSE 2 END, ord, kind FROM marker)
SELECT doc_id, start, rank, ord, kind, row_number() OVER (PARTITION BY doc_id ORDER BY start, rank, ord) AS place FROM both_""")
def field_marker_splice(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events")
    runs = e.where("event_type = 'view'").selectExpr("user_id as doc_id", "event_id % 50 as start", "event_id as run")
    markers = e.where("event_type in ('click', 'error', 'signup')").selectExpr("user_id as doc_id", "event_id % 50 as pos", "event_id as marker", "case when event_type = 'click' then 'begin' when event_type = 'error' then 'end' else 'point' end as kind")
    return splice_markers(runs, markers)


@query("SELECT l_orderkey AS doc_id, l_partkey AS ref FROM lineitem WHERE NOT EXISTS (SELECT 1 FROM part WHERE p_partkey = l_partkey AND p_size > 25)")
def idref_anti_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    refs = table(spark, sf_dir, "lineitem").selectExpr("l_orderkey as doc_id", "l_partkey as ref")
    return missing_references(refs, table(spark, sf_dir, "part").where("p_size > 25").selectExpr("p_partkey as ref")).select("doc_id", "ref")


@query("SELECT p_brand, p_size FROM (SELECT DISTINCT p_brand, p_size FROM part WHERE p_retailprice > 950 EXCEPT SELECT p_brand, p_size FROM part WHERE p_retailprice < 930) WHERE p_size <> 0")
def shapes_to_synthesise(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Shapes in use that the pool does not own, the default left out."""
    part = table(spark, sf_dir, "part")
    used, owned = part.where("p_retailprice > 950").select("p_brand", "p_size"), part.where("p_retailprice < 930").select("p_brand", "p_size")
    return used.subtract(owned).where("p_size <> 0")
