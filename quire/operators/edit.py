"""The edit algebra as functional rewrites: a batch of edits gives new tables, never an update in place.

Text edits address one paragraph by code-point offsets. An edit that cannot be made keeps the text and says why in
`status`; atomic_batches then undoes whole batches that hold such an edit.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quire.functions import text as X
from quire.plans.registry import query
from quire.sources.adapters import PARAGRAPH, paragraphs, table


def insert_text(text: Column, at: Column, new: Column) -> Column:
    """Sanitised text put in at an offset; null where the offset is out of range."""
    return F.when((at >= 0) & (at <= F.length(text)), F.concat(F.substring(text, F.lit(1), at), X.sanitize(new), F.substring(text, at + 1, F.length(text))))


def delete_range(text: Column, start: Column, end: Column) -> Column:
    """Text without [start, end); null where the range is reversed or out of range."""
    return F.when((start >= 0) & (start <= end) & (end <= F.length(text)), F.concat(F.substring(text, F.lit(1), start), F.substring(text, end + 1, F.length(text))))


def split_runs(runs: DataFrame, start: str, end: str) -> DataFrame:
    """Runs split at a range of their paragraph: (…, part, text, inside). Empty parts are dropped; the end is clamped.

    runs: doc_id, block, run, text and the range's columns.
    """
    order = Window.partitionBy("doc_id", "block").orderBy("run").rowsBetween(Window.unboundedPreceding, -1)
    base = runs.withColumn("at", F.coalesce(F.sum(F.length("text")).over(order), F.lit(0)))
    return base.select("doc_id", "block", "run", F.explode(_parts(F.col("text"), F.col("at"), start, end)).alias("p")).select("doc_id", "block", "run", "p.part", "p.text", "p.inside")


def split_lines(lines: DataFrame, start: str, end: str) -> DataFrame:
    """split_runs of paragraphs that have all their runs in one row: doc_id, block, runs (an array of texts) and the range's columns.

    Runs are not dealt out. Only places before the range's end count, so only as many runs with a text as it has characters are summed.
    """
    whole = lambda t, i: F.struct(i.cast("long").alias("run"), F.lit(2).alias("part"), t.alias("text"), F.lit(False).alias("inside"))
    told = F.filter(F.transform("runs", whole), lambda r: r["text"] != "")
    most = F.greatest(F.col(start), F.col(end), F.lit(0)).cast("int")
    none = F.struct(F.lit(0).alias("at"), F.array().cast("array<struct<run:bigint,text:string,at:int>>").alias("runs"))
    add = lambda got, r: F.struct((got["at"] + F.length(r["text"])).alias("at"), F.concat(got["runs"], F.array(F.struct(r["run"].alias("run"), r["text"].alias("text"), got["at"].alias("at")))).alias("runs"))
    ahead = F.aggregate(F.slice("_told", F.lit(1), F.col("_most")), none, add)["runs"]
    cut = F.flatten(F.transform(ahead, lambda r: F.transform(_parts(r["text"], r["at"], start, end), lambda p: F.struct(r["run"].alias("run"), p["part"].alias("part"), p["text"].alias("text"), p["inside"].alias("inside")))))
    rest = F.slice("_told", F.col("_most") + 1, F.greatest(F.size("_told"), F.lit(0)))
    each = lines.withColumns({"_told": told, "_most": most}).select("doc_id", "block", F.explode(F.concat(cut, rest)).alias("r"))
    return each.select("doc_id", "block", "r.*")


def _parts(text: Column, at: Column, start: str, end: str) -> Column:
    """The parts of a run that begins at `at` in its paragraph, without empty ones."""
    a = F.least(F.greatest(F.col(start) - at, F.lit(0)), F.length(text)).cast("int")
    b = F.greatest(a, F.least(F.greatest(F.col(end) - at, F.lit(0)), F.length(text))).cast("int")
    piece = lambda n, s, e, inside: F.struct(F.lit(n).alias("part"), F.substring(text, s + 1, e - s).alias("text"), F.lit(inside).alias("inside"))
    parts = F.array(piece(0, F.lit(0), a, False), piece(1, a, b, True), piece(2, b, F.length(text), False))
    return F.filter(parts, lambda p: p["text"] != "")


def reindex_delete(blocks: DataFrame, doomed: DataFrame) -> DataFrame:
    """Blocks without those of `doomed` (doc_id, block), numbered anew."""
    order = Window.partitionBy("doc_id").orderBy("old_block")
    left = blocks.join(doomed, ["doc_id", "block"], "left_anti").withColumnRenamed("block", "old_block")
    return left.withColumn("block", F.row_number().over(order).cast("long") - 1)


def reindex_move(block: Column, source: Column, target: Column) -> Column:
    """A block's place after one is moved to an insertion slot of the original list."""
    landed = F.when(target > source, target - 1).otherwise(target)
    return (
        F.when(block == source, landed)
        .when((source < landed) & (block > source) & (block <= landed), block - 1)
        .when((source > landed) & (block >= landed) & (block < source), block + 1)
        .otherwise(block)
    )


def reindex_insert(block: Column, at: Column, count: int = 1) -> Column:
    return F.when(block >= at, block + count).otherwise(block)


def drift(commands: DataFrame) -> DataFrame:
    """commands with `index`, the place that earlier inserts (at or before) and deletes (before) of the section leave.

    commands: doc_id, section, seq, point, delta (1, -1 or 0). The section's earlier commands are kept in one ordered
    array and folded, so no command meets all others in a join.
    """
    earlier = Window.partitionBy("doc_id", "section").orderBy("seq").rowsBetween(Window.unboundedPreceding, -1)
    seen = F.collect_list(F.when(F.col("delta") != 0, F.struct("point", "delta"))).over(earlier)
    moved = commands.withColumn("_seen", seen)
    shift = F.aggregate("_seen", F.lit(0).cast("long"), lambda a, c: a + F.when((c["delta"] > 0) & (c["point"] <= F.col("point")), 1).when((c["delta"] < 0) & (c["point"] < F.col("point")), -1).otherwise(0))
    return moved.withColumn("index", F.greatest(F.lit(0).cast("long"), F.col("point") + shift)).drop("_seen")


def atomic_batches(edits: DataFrame) -> DataFrame:
    """edits with `applied`: only where every edit of the batch is ok. edits: doc_id, batch, seq, status."""
    return edits.withColumn("applied", F.bool_and(F.col("status") == "ok").over(Window.partitionBy("doc_id", "batch")))


def retained_history(steps: DataFrame, *, limit: int = 50, budget: int = 128 << 20, floor: int = 4) -> DataFrame:
    """Undo steps that stay: the newest `limit`; of these those whose bytes, summed from the newest, fit the budget, but
    the newest `floor` at least. steps: doc_id, seq, bytes."""
    newest = Window.partitionBy("doc_id").orderBy(F.desc("seq"))
    running = steps.withColumn("age", F.row_number().over(newest).cast("long")).withColumn("held", F.sum("bytes").over(newest.rowsBetween(Window.unboundedPreceding, 0)))
    return running.where((F.col("age") <= limit) & ((F.col("held") <= budget) | (F.col("age") <= floor)))


def carry_breaks(blocks: DataFrame) -> DataFrame:
    """Tables of a document with the page break that elided anchors before them carry: of the anchors since the last table.

    blocks: doc_id, block, kind ('anchor', 'table' or other), break.
    """
    order = Window.partitionBy("doc_id").orderBy("block")
    island = F.count_if(F.col("kind") == "table").over(order.rowsBetween(Window.unboundedPreceding, -1))
    own = blocks.withColumn("island", F.coalesce(island, F.lit(0)))
    carried = F.bool_or((F.col("kind") == "anchor") & F.col("break")).over(Window.partitionBy("doc_id", "island"))
    return own.withColumn("carried", F.coalesce(carried, F.lit(False))).where("kind = 'table'").select("doc_id", "block", (F.col("carried") | F.col("break")).alias("break"))


_BASE = f"WITH {PARAGRAPH}, cmd AS (SELECT event_id AS doc_id, event_id % 7 AS block, event_id % 11 AS pos, floor(value)::BIGINT AS n FROM events)"


def _commands(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each event is a command on the document of its number, so that commands grow with the tables."""
    return table(spark, sf_dir, "events").select(F.col("event_id").alias("doc_id"), (F.col("event_id") % 7).alias("block"), (F.col("event_id") % 11).alias("at"), F.floor("value").cast("long").alias("n"))


@query(_BASE + " SELECT p.doc_id, p.block, CASE WHEN pos <= length(text) THEN substr(text, 1, pos::INT) || '«x»' || substr(text, pos::INT + 1) ELSE text END AS text, CASE WHEN pos <= length(text) THEN 'ok' ELSE 'out_of_range' END AS status FROM paragraph p JOIN cmd USING (doc_id, block)", name="insert_text")
def insert_text_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = paragraphs(spark, sf_dir).join(_commands(spark, sf_dir), ["doc_id", "block"])
    new = insert_text(F.col("text"), F.col("at").cast("int"), F.lit("«\x01x»"))
    return rows.select("doc_id", "block", F.coalesce(new, "text").alias("text"), F.when(new.isNull(), "out_of_range").otherwise("ok").alias("status"))


@query(_BASE + " SELECT p.doc_id, p.block, CASE WHEN pos + n <= length(text) THEN substr(text, 1, pos::INT) || substr(text, (pos + n)::INT + 1) ELSE text END AS text, CASE WHEN pos + n <= length(text) THEN 'ok' ELSE 'out_of_range' END AS status FROM paragraph p JOIN cmd USING (doc_id, block)", name="delete_range")
def delete_range_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = paragraphs(spark, sf_dir).join(_commands(spark, sf_dir), ["doc_id", "block"])
    new = delete_range(F.col("text"), F.col("at").cast("int"), (F.col("at") + F.col("n")).cast("int"))
    return rows.select("doc_id", "block", F.coalesce(new, "text").alias("text"), F.when(new.isNull(), "out_of_range").otherwise("ok").alias("status"))


@query(f"""WITH {PARAGRAPH}, run AS (SELECT doc_id, block, i - 1 AS run, w AS text FROM (SELECT doc_id, block, unnest(string_split(text, ' ')) AS w, generate_subscripts(string_split(text, ' '), 1) AS i FROM paragraph)),
r AS (SELECT *, coalesce(sum(length(text)) OVER (PARTITION BY doc_id, block ORDER BY run ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS pos FROM run),
c AS (SELECT *, least(greatest(10 - pos, 0), length(text)) AS a FROM r), d AS (SELECT *, greatest(a, least(greatest(25 - pos, 0), length(text))) AS b FROM c),
p AS (SELECT doc_id, block, run, 0 AS part, substr(text, 1, a::INT) AS text, false AS inside FROM d UNION ALL SELECT doc_id, block, run, 1, substr(text, a::INT + 1, (b - a)::INT), true FROM d UNION ALL SELECT doc_id, block, run, 2, substr(text, b::INT + 1), false FROM d)
SELECT * FROM p WHERE text <> ''""")
def run_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = paragraphs(spark, sf_dir).select("doc_id", "block", F.split("text", " ").alias("runs"), F.lit(10).alias("a"), F.lit(25).alias("b"))
    return split_lines(lines, "a", "b")


@query(f"WITH {PARAGRAPH} SELECT doc_id, block AS old_block, row_number() OVER (PARTITION BY doc_id ORDER BY block) - 1 AS block, text FROM paragraph WHERE NOT (block % 4 = doc_id % 4)")
def block_delete(spark: SparkSession, sf_dir: str) -> DataFrame:
    blocks = paragraphs(spark, sf_dir).select("doc_id", "block", "text")
    return reindex_delete(blocks, blocks.where("block % 4 = doc_id % 4").select("doc_id", "block"))


@query(f"WITH {PARAGRAPH}, m AS (SELECT doc_id, 1 AS s, doc_id % 5 AS t FROM documents), x AS (SELECT *, CASE WHEN t > s THEN t - 1 ELSE t END AS l FROM m) SELECT p.doc_id, block AS old_block, (CASE WHEN block = s THEN l WHEN s < l AND block > s AND block <= l THEN block - 1 WHEN s > l AND block >= l AND block < s THEN block + 1 ELSE block END)::BIGINT AS block FROM paragraph p JOIN x USING (doc_id)")
def block_move(spark: SparkSession, sf_dir: str) -> DataFrame:
    return paragraphs(spark, sf_dir).select("doc_id", F.col("block").alias("old_block"), reindex_move(F.col("block"), F.lit(1), F.col("doc_id") % 5).cast("long").alias("block"))


@query(f"WITH {PARAGRAPH} SELECT doc_id, CASE WHEN block >= 2 THEN block + 1 ELSE block END AS block, text FROM paragraph UNION ALL SELECT doc_id, least(2, count(*)), 'inserted' FROM paragraph GROUP BY doc_id")
def block_insert(spark: SparkSession, sf_dir: str) -> DataFrame:
    paras = paragraphs(spark, sf_dir)
    fresh = paras.groupBy("doc_id").agg(F.least(F.lit(2), F.count("*")).cast("long").alias("block"), F.lit("inserted").alias("text"))
    return paras.select("doc_id", reindex_insert(F.col("block"), F.lit(2)).alias("block"), "text").unionByName(fresh)


@query("""WITH c AS (SELECT user_id AS doc_id, event_id % 2 AS section, event_id AS seq, event_id % 30 AS point, CASE event_type WHEN 'click' THEN 1 WHEN 'error' THEN -1 ELSE 0 END AS delta FROM events)
SELECT a.doc_id, a.section, a.seq, a.point, greatest(0, a.point + coalesce(sum(CASE WHEN b.delta > 0 AND b.point <= a.point THEN 1 WHEN b.delta < 0 AND b.point < a.point THEN -1 ELSE 0 END), 0))::BIGINT AS index
FROM c a LEFT JOIN c b ON b.doc_id = a.doc_id AND b.section = a.section AND b.seq < a.seq GROUP BY a.doc_id, a.section, a.seq, a.point""")
def drift_adjust(spark: SparkSession, sf_dir: str) -> DataFrame:
    commands = table(spark, sf_dir, "events").selectExpr("user_id as doc_id", "event_id % 2 as section", "event_id as seq", "event_id % 30 as point", "case event_type when 'click' then 1 when 'error' then -1 else 0 end as delta")
    return drift(commands).select("doc_id", "section", "seq", "point", "index")


@query("""WITH s AS (SELECT user_id AS doc_id, event_id AS seq, (event_id % 13) * 1000000 AS bytes FROM events), r AS (SELECT *, row_number() OVER w AS age, sum(bytes) OVER w::BIGINT AS held FROM s WINDOW w AS (PARTITION BY doc_id ORDER BY seq DESC ROWS UNBOUNDED PRECEDING)) SELECT doc_id, seq, bytes, age, held FROM r WHERE age <= 50 AND (held <= 100000000 OR age <= 4)""".replace("sum(bytes) OVER w::BIGINT", "(sum(bytes) OVER w)::BIGINT"))
def undo_budget(spark: SparkSession, sf_dir: str) -> DataFrame:
    steps = table(spark, sf_dir, "events").selectExpr("user_id as doc_id", "event_id as seq", "(event_id % 13) * 1000000 as bytes")
    return retained_history(steps, budget=100_000_000)


@query("WITH e AS (SELECT conv_id AS doc_id, turn // 2 AS batch, turn AS seq, CASE WHEN length(text) < 30 THEN 'too_short' ELSE 'ok' END AS status FROM conversations) SELECT doc_id, batch, seq, status, bool_and(status = 'ok') OVER (PARTITION BY doc_id, batch) AS applied FROM e")
def batch_undo(spark: SparkSession, sf_dir: str) -> DataFrame:
    edits = table(spark, sf_dir, "conversations").selectExpr("conv_id as doc_id", "turn div 2 as batch", "turn as seq", "case when length(text) < 30 then 'too_short' else 'ok' end as status")
    return atomic_batches(edits)


@query("""WITH b AS (SELECT user_id AS doc_id, event_id AS block, CASE event_type WHEN 'click' THEN 'anchor' WHEN 'error' THEN 'table' ELSE 'text' END AS kind, value > 30 AS br FROM events),
i AS (SELECT *, coalesce(count(*) FILTER (kind = 'table') OVER (PARTITION BY doc_id ORDER BY block ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS island FROM b), c AS (SELECT *, bool_or(kind = 'anchor' AND br) OVER (PARTITION BY doc_id, island) AS carried FROM i) SELECT doc_id, block, carried OR br AS break FROM c WHERE kind = 'table'""")
def anchor_elision_carry(spark: SparkSession, sf_dir: str) -> DataFrame:
    blocks = table(spark, sf_dir, "events").selectExpr("user_id as doc_id", "event_id as block", "case event_type when 'click' then 'anchor' when 'error' then 'table' else 'text' end as kind", "value > 30 as break")
    return carry_breaks(blocks)
