"""Context for assistants, addresses, summaries, drags and verification."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quire.plans.registry import query
from quire.sources.adapters import CELL, cells, table

CELL_CHARS, EMPTY_CELL = 60, "_빈칸_"


def cell_value(text: Column) -> Column:
    """A cell as context shows it: a mark for an empty one, line breaks as slashes, cut."""
    flat = F.replace(text, F.lit("\n"), F.lit(" / "))
    return F.when(F.btrim(text) == "", EMPTY_CELL).otherwise(F.when(F.length(flat) > CELL_CHARS, F.concat(F.substring(flat, 1, CELL_CHARS), F.lit("…"))).otherwise(flat))


def grid_lines(grid: DataFrame) -> DataFrame:
    """(doc_id, lines): a table's rows, cells between bars, for a context text."""
    joined = lambda c, o, by: F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(o, c.alias("t")))), lambda x: x["t"]), by)
    rows = grid.where("active").groupBy("doc_id", "row").agg(F.concat(F.lit("| "), joined(cell_value(F.col("text")), "col", " | "), F.lit(" |")).alias("line"))
    return rows.groupBy("doc_id").agg(joined(F.col("line"), "row", "\n").alias("lines"))


def anchors_with_grids(anchors: DataFrame, grids: DataFrame) -> DataFrame:
    """anchors with their table's lines; a table is shown at its first anchor alone. anchors: doc_id, anchor."""
    first = F.row_number().over(Window.partitionBy("doc_id").orderBy("anchor")) == 1
    return anchors.withColumn("_first", first).join(grids, "doc_id", "left").select("doc_id", "anchor", F.when(F.col("_first"), F.col("lines")).alias("lines"))


def frame_targets(tables: DataFrame) -> DataFrame:
    """(doc_id, table, target): a one-by-one table that wraps exactly one table of several rows, and no text, stands for it.

    tables: doc_id, table, parent, rows, cols, text (of its own cells).
    """
    inner = tables.where("parent is not null").groupBy("doc_id", F.col("parent").alias("table")).agg(F.count("*").alias("n"), F.min("table").alias("inner"), F.max("rows").alias("inner_rows"))
    wraps = (F.col("rows") == 1) & (F.col("cols") == 1) & (F.col("n") == 1) & (F.col("inner_rows") > 1) & (F.btrim("text") == "")
    return tables.where("parent is null").join(inner, ["doc_id", "table"], "left").select("doc_id", "table", F.when(wraps, F.col("inner")).otherwise(F.col("table")).alias("target"))


def stable_key(key: Column) -> dict[str, Column]:
    """Section, paragraph and character of section:i/para:j/char:k; null where a part is missing."""
    part = lambda name: F.regexp_extract(key, f"(?:^|/){name}:(\\d+)(?:/|$)", 1).try_cast("bigint")
    return {"section": part("section"), "para": part("para"), "char": part("char")}


def global_offset(text: Column, para: Column, offset: Column) -> Column:
    """A cell's paragraph and offset as one offset over its paragraphs joined by line breaks."""
    before = F.slice(F.split(text, "\n"), F.lit(1), para)
    return F.aggregate(before, F.lit(0), lambda a, p: a + F.length(p) + 1) + offset


def run_regroup(chars: DataFrame) -> DataFrame:
    """Neighbouring characters of one style as runs. chars: doc_id, at, ch, style."""
    order = Window.partitionBy("doc_id").orderBy("at")
    fresh = (~F.lag("style").over(order).eqNullSafe(F.col("style"))) | (F.row_number().over(order) == 1)
    island = chars.withColumn("run", F.sum(fresh.cast("long")).over(order))
    joined = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("at", "ch"))), lambda x: x["ch"]), "")
    return island.groupBy("doc_id", "run").agg(F.min("at").alias("start"), F.first("style").alias("style"), joined.alias("text"))


def fragment_heights(fragment: DataFrame, totals: DataFrame) -> DataFrame:
    """A page fragment's row heights as heights of the whole table: rows outside are 0. fragment: doc_id, row, height; totals: doc_id, rows."""
    rows = totals.select("doc_id", F.explode(F.sequence(F.lit(0).cast("long"), F.col("rows") - 1)).alias("row"))
    return rows.join(fragment, ["doc_id", "row"], "left").withColumn("height", F.coalesce("height", F.lit(0).cast("long")))


def drag_applied(before: Column, intended: Column, applied: Column, *, share: float = 0.5, least: float = 0.5) -> Column:
    """Whether, where a drag meant to move most, at least a share of the movement was made, in its direction.

    Arrays of boundaries: before and intended of one length; if applied has another, the layout changed.
    """
    moves = F.zip_with(intended, before, lambda a, b: a - b)
    most = F.aggregate(moves, F.lit(0.0), lambda a, m: F.when(F.abs(m) > F.abs(a), m).otherwise(a))
    at = F.array_position(moves, most).cast("int")
    made = F.get(applied, at - 1) - F.get(before, at - 1)
    return F.when(F.size(before) != F.size(intended), False).when(F.size(applied) != F.size(before), True).when(F.abs(most) < least, True).otherwise((F.signum(made) == F.signum(most)) & (F.abs(made) >= share * F.abs(most)))


def layout_score(pairs: DataFrame) -> DataFrame:
    """(doc_id, paragraphs, exact, near, ours, theirs): paragraphs' line counts against another layout's."""
    off = F.abs(F.col("ours") - F.col("theirs"))
    return pairs.groupBy("doc_id").agg(F.count("*").alias("paragraphs"), F.count_if(off == 0).alias("exact"), F.count_if(off <= 1).alias("near"), F.sum("ours").alias("ours"), F.sum("theirs").alias("theirs"))


def summary(op: Column, section: Column, block: Column, text: Column) -> Column:
    """One line that says what an operation does."""
    at = F.format_string("s%d/b%d", section, block)
    return F.when(op == "DeleteBlock", F.concat(F.lit("delete "), at)).when(op == "SetParagraphText", F.concat(F.lit("set "), at, F.lit(': "'), F.substring(text, 1, 20), F.lit('"'))).otherwise(F.concat(op, F.lit(" at "), at))


@query(f"WITH {CELL}, l AS (SELECT doc_id, row, '| ' || string_agg(CASE WHEN trim(text) = '' THEN '_빈칸_' ELSE text END, ' | ' ORDER BY col) || ' |' AS line FROM cell WHERE active GROUP BY doc_id, row), g AS (SELECT doc_id, string_agg(line, chr(10) ORDER BY row) AS lines FROM l GROUP BY doc_id), a AS (SELECT user_id AS doc_id, event_id AS anchor, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS k FROM events) SELECT a.doc_id, anchor, CASE WHEN k = 1 THEN lines END AS lines FROM a LEFT JOIN g ON g.doc_id = a.doc_id")
def doc_context(spark: SparkSession, sf_dir: str) -> DataFrame:
    return anchors_with_grids(table(spark, sf_dir, "events").selectExpr("user_id as doc_id", "event_id as anchor"), grid_lines(cells(spark, sf_dir)))


@query("WITH t AS (SELECT o_custkey AS doc_id, o_orderkey AS tbl, CASE WHEN o_orderkey % 3 = 0 THEN NULL ELSE o_orderkey - o_orderkey % 3 END AS parent, CASE WHEN o_orderkey % 3 = 0 THEN 1 ELSE 2 END AS rows, CASE WHEN o_orderstatus = 'O' THEN 'x' ELSE ' ' END AS text FROM (SELECT 1 AS o_custkey, o_orderkey, o_orderstatus FROM orders)), i AS (SELECT doc_id, parent, count(*) AS n, min(tbl) AS inner_, max(rows) AS r FROM t WHERE parent IS NOT NULL GROUP BY doc_id, parent) SELECT t.doc_id::BIGINT AS doc_id, tbl AS \"table\", CASE WHEN n = 1 AND r > 1 AND trim(text) = '' AND rows = 1 THEN inner_ ELSE tbl END AS target FROM t LEFT JOIN i ON i.doc_id = t.doc_id AND i.parent = t.tbl WHERE t.parent IS NULL")
def frame_edit_target(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = table(spark, sf_dir, "orders").selectExpr("1L as doc_id", "o_orderkey as table", "case when o_orderkey % 3 = 0 then null else o_orderkey - o_orderkey % 3 end as parent", "case when o_orderkey % 3 = 0 then 1 else 2 end as rows", "1 as cols", "case when o_orderstatus = 'O' then 'x' else ' ' end as text")
    return frame_targets(t)


@query("SELECT event_id, event_id % 7 AS section, CASE WHEN event_id % 4 = 0 THEN NULL ELSE user_id END AS para, event_id AS char FROM events")
def stable_key_parse(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events")
    key = F.when(F.col("event_id") % 4 == 0, F.format_string("section:%d/char:%d/cell:1.2.3", F.col("event_id") % 7, F.col("event_id"))).otherwise(F.format_string("section:%d/para:%d/char:%d", F.col("event_id") % 7, F.col("user_id"), F.col("event_id")))
    return e.select("event_id", *[c.alias(k) for k, c in stable_key(key).items()])


@query("SELECT doc_id, length(array_to_string(string_split(text, chr(10))[1:2], chr(10)))::BIGINT + CASE WHEN len(string_split(text, chr(10))) = 1 THEN 0 ELSE 0 END + 1 + 3 AS at FROM documents".replace(" AS at", ' AS "at"'))
def cell_offsets(spark: SparkSession, sf_dir: str) -> DataFrame:
    at = global_offset(F.col("text"), F.least(F.lit(2), F.size(F.split("text", "\n"))), F.lit(3))
    return table(spark, sf_dir, "documents").select("doc_id", at.cast("long").alias("at"))


@query("WITH c AS (SELECT user_id AS doc_id, event_id AS pos, substr(event_type, 1, 1) AS ch, event_type IN ('view', 'click') AS style FROM events), f AS (SELECT *, (lag(style) OVER w IS DISTINCT FROM style)::INT AS fresh FROM c WINDOW w AS (PARTITION BY doc_id ORDER BY pos)), r AS (SELECT *, (sum(fresh) OVER (PARTITION BY doc_id ORDER BY pos))::BIGINT AS run FROM f) SELECT doc_id, run, min(pos) AS start, any_value(style) AS style, string_agg(ch, '' ORDER BY pos) AS text FROM r GROUP BY doc_id, run")
def run_regrouping(spark: SparkSession, sf_dir: str) -> DataFrame:
    chars = table(spark, sf_dir, "events").selectExpr("user_id as doc_id", "event_id as at", "substr(event_type, 1, 1) as ch", "event_type in ('view', 'click') as style")
    return run_regroup(chars)


@query("WITH t AS (SELECT p_partkey AS doc_id, p_size::BIGINT AS rows FROM part WHERE p_size > 0), r AS (SELECT doc_id, unnest(range(rows)) AS row FROM t) SELECT doc_id, row, CASE WHEN row BETWEEN 2 AND 4 THEN row * 100 ELSE 0 END AS height FROM r")
def fragment_remap(spark: SparkSession, sf_dir: str) -> DataFrame:
    totals = table(spark, sf_dir, "part").where("p_size > 0").selectExpr("p_partkey as doc_id", "cast(p_size as long) as rows")
    fragment = totals.select("doc_id", F.explode(F.array(*[F.lit(k).cast("long") for k in (2, 3, 4)])).alias("row")).withColumn("height", F.col("row") * 100)
    return fragment_heights(fragment, totals)


@query("SELECT event_id, CASE WHEN value < 1 THEN true ELSE event_id % 2 = 0 END AS applied FROM events")
def drag_verify(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = F.greatest(F.col("value"), F.lit(1.0))
    before = F.array(F.lit(0.0), F.lit(10.0), F.lit(20.0))
    intended = F.array(F.lit(0.0), 10.0 + v, F.lit(20.0))
    applied = F.when(F.col("event_id") % 2 == 0, F.array(F.lit(0.0), 10.0 + v * 0.6, F.lit(26.0))).otherwise(F.array(F.lit(0.0), 10.0 + v * 0.4, F.lit(26.0)))
    small = F.when(F.col("value") < 1, before).otherwise(intended)
    return table(spark, sf_dir, "events").select("event_id", drag_applied(before, small, applied).alias("applied"))


@query("SELECT l_orderkey AS doc_id, count(*) AS paragraphs, count(*) FILTER (l_linenumber = l_quantity::INT % 7) AS exact, count(*) FILTER (abs(l_linenumber - l_quantity::INT % 7) <= 1) AS near, sum(l_linenumber)::BIGINT AS ours, sum(l_quantity::INT % 7)::BIGINT AS theirs FROM lineitem GROUP BY 1")
def layout_agreement(spark: SparkSession, sf_dir: str) -> DataFrame:
    return layout_score(table(spark, sf_dir, "lineitem").selectExpr("l_orderkey as doc_id", "l_linenumber as ours", "cast(l_quantity as int) % 7 as theirs"))


@query("SELECT event_id, CASE event_type WHEN 'view' THEN 'delete s0/b' || user_id WHEN 'click' THEN 'set s0/b' || user_id || ': \"' || substr(props, 1, 20) || '\"' ELSE event_type || ' at s0/b' || user_id END AS summary FROM events")
def op_summaries(spark: SparkSession, sf_dir: str) -> DataFrame:
    op = F.when(F.col("event_type") == "view", "DeleteBlock").when(F.col("event_type") == "click", "SetParagraphText").otherwise(F.col("event_type"))
    return table(spark, sf_dir, "events").select("event_id", summary(op, F.lit(0), F.col("user_id"), F.col("props")).alias("summary"))
