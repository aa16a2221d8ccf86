"""Document profiles: counts, titles, outlines and limits."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quire.functions import text as X
from quire.plans.registry import query
from quire.sources.adapters import PARAGRAPH, paragraphs, table

#: A heading's first characters; the test tables hold none of these, so queries give a pattern of their own.
SECTION_MARKERS = "^[□■]"
HEADINGS, HEADING_CHARS, TITLE_CHARS, EXCERPT = 20, 40, 60, 1200


def outline(paras: DataFrame, marker: str = SECTION_MARKERS) -> DataFrame:
    """(doc_id, section, block, level, title): short paragraphs that start with a marker, the first twenty of a document."""
    t = X.trim(F.col("text"))
    rows = paras.select("doc_id", "section", "block", t.alias("title")).where(F.rlike("title", F.lit(marker)) & (F.length("title") < HEADING_CHARS))
    order = Window.partitionBy("doc_id").orderBy("section", "block")
    return rows.withColumn("k", F.row_number().over(order)).where(F.col("k") <= HEADINGS).select("doc_id", "section", "block", F.lit(1).alias("level"), "title")


def numbered_bands(first_cells: DataFrame) -> DataFrame:
    """Tables whose first cell with text starts with a digit, holds a full stop and is short: level-two headings."""
    t = X.trim(F.col("text"))
    return first_cells.where(F.rlike(t, F.lit("^[0-9]")) & F.contains(t, F.lit(".")) & (F.length(t) < 80)).withColumn("level", F.lit(2))


def titles(paras: DataFrame, headings: DataFrame) -> DataFrame:
    """(doc_id, title): the first kept heading, else the first paragraph that is not blank; cut with an ellipsis."""
    at = F.struct("section", "block")
    first = headings.groupBy("doc_id").agg(F.min_by("title", at).alias("heading"))
    text = X.trim(F.col("text"))
    body = paras.where(text != "").groupBy("doc_id").agg(F.min_by(text, at).alias("body"))
    return body.join(first, "doc_id", "left").select("doc_id", X.truncate(F.coalesce("heading", "body"), TITLE_CHARS).alias("title"))


def counts(paras: DataFrame) -> DataFrame:
    blank = X.trim(F.col("text")) == ""
    return paras.groupBy("doc_id").agg(
        F.countDistinct("section").alias("sections"),
        F.count("*").alias("paragraphs"),
        F.count_if(blank).alias("blank"),
        F.count_if(~F.col("simple")).alias("structural"),
        F.sum(F.length("text")).alias("chars"),
    )


#: Resource caps and the first that a package exceeds.
LIMITS = (("raw_bytes", 64 << 20), ("inflated_bytes", 256 << 20), ("entries", 4096), ("nesting", 8), ("paragraphs", 200_000))


def first_violation(packages: DataFrame, limits=LIMITS) -> DataFrame:
    out = F.lit(None).cast("string")
    for name, most in reversed(limits):
        out = F.when(F.col(name) > most, F.lit(name)).otherwise(out)
    return packages.withColumn("violated", out)


_HEAD = f"WITH {PARAGRAPH}, head AS (SELECT doc_id, section, block, trim(text) AS title FROM paragraph WHERE regexp_matches(trim(text), '^[A-M]') AND length(trim(text)) < 40 QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY section, block) <= 20)"


@query(_HEAD + " SELECT doc_id, section, block, 1 AS level, title FROM head")
def outline_headings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return outline(paragraphs(spark, sf_dir), "^[A-M]")


@query(_HEAD + ", body AS (SELECT doc_id, arg_min(trim(text), block) AS body FROM paragraph WHERE trim(text) <> '' GROUP BY doc_id), first AS (SELECT doc_id, arg_min(title, block) AS heading FROM head GROUP BY doc_id), t AS (SELECT body.doc_id, coalesce(heading, body) AS t FROM body LEFT JOIN first ON first.doc_id = body.doc_id) SELECT doc_id, CASE WHEN length(t) > 60 THEN substr(t, 1, 60) || '…' ELSE t END AS title FROM t")
def doc_title(spark: SparkSession, sf_dir: str) -> DataFrame:
    paras = paragraphs(spark, sf_dir)
    return titles(paras, outline(paras, "^[A-M]"))


@query(f"WITH {PARAGRAPH} SELECT doc_id, count(DISTINCT section) AS sections, count(*) AS paragraphs, count(*) FILTER (trim(text) = '') AS blank, count(*) FILTER (NOT simple) AS structural, sum(length(text))::BIGINT AS chars FROM paragraph GROUP BY doc_id")
def doc_profile_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return counts(paragraphs(spark, sf_dir))


@query("SELECT doc_id, CASE WHEN length(text) > 1200 THEN substr(text, 1, 1200) || '…' ELSE text END AS excerpt, sha256(text) AS fingerprint FROM documents", name="doc_excerpt")
def doc_excerpt(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", X.truncate(F.col("text"), EXCERPT).alias("excerpt"), F.sha2("text", 256).alias("fingerprint"))


@query("SELECT page_id, sha256(html) AS sha FROM pages")
def fingerprint_sha(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "pages").select("page_id", F.sha2("html", 256).alias("sha"))


@query("SELECT p_partkey AS id, CASE WHEN p_partkey * 40000 > 67108864 THEN 'raw_bytes' WHEN p_size * 8000000 > 268435456 THEN 'inflated_bytes' WHEN p_size * 100 > 4096 THEN 'entries' WHEN p_size % 11 > 8 THEN 'nesting' WHEN p_partkey * 120 > 200000 THEN 'paragraphs' END AS violated FROM part")
def limits_check(spark: SparkSession, sf_dir: str) -> DataFrame:
    packages = table(spark, sf_dir, "part").selectExpr("p_partkey as id", "p_partkey * 40000 as raw_bytes", "cast(p_size as long) * 8000000 as inflated_bytes", "p_size * 100 as entries", "p_size % 11 as nesting", "p_partkey * 120 as paragraphs")
    return first_violation(packages).select("id", "violated")


@query(f"WITH {PARAGRAPH} SELECT doc_id, block, (length(text) - length(regexp_replace(text, '[\\x{{0000}}-\\x{{024F}}]', '', 'g')))::BIGINT AS latin, (length(regexp_replace(text, '[\\x{{0000}}-\\x{{024F}}]', '', 'g')))::BIGINT AS other FROM paragraph", name="script_counts")
def script_counts_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = X.script_counts(F.col("text"))
    rest = found["other"] + found["hangul"] + found["hanja"] + found["japanese"]
    return paragraphs(spark, sf_dir).select("doc_id", "block", found["latin"].cast("long").alias("latin"), rest.cast("long").alias("other"))


@query(f"WITH {PARAGRAPH} SELECT doc_id, block, (length(regexp_replace(text, '[^ \\t]', '', 'g')) * 300 + length(regexp_replace(text, '[ \\t]', '', 'g')) * 500)::DOUBLE AS width FROM paragraph")
def glyph_advance_sum(spark: SparkSession, sf_dir: str) -> DataFrame:
    return paragraphs(spark, sf_dir).select("doc_id", "block", X.flat_width(F.col("text")).cast("double").alias("width"))
