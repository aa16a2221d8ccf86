"""Edit scripts: commands that name blocks as they stood at first, resolved and applied without replaying the text.

A command's index, when its turn comes, is its block's first index and what earlier commands put in at or before it,
less what they took out before it: a count of points below and to the left, over command times. It is counted by
merges: at each bit of the command's number, commands of one group whose bit is set count those whose bit is not, in
one order of points, so every pair of commands meets in exactly one of log n orders and none is compared.

A script that takes no block twice and touches none it has taken is applied by keys alone: a new block stands before
the block at its point, behind those put there earlier. Other scripts do what the indices say, whatever stands there
by then; their sections are replayed on block numbers, never on texts.

commands: doc_id, section, seq, op (insert, delete or set), block, position (before, after, start or end; of an insert), text.
blocks: doc_id, section, block, text.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from quire.plans.registry import query
from quire.sources.adapters import PARAGRAPH, paragraphs, table

KEY = ["doc_id", "section"]


def resolved(commands: DataFrame, blocks: DataFrame) -> DataFrame:
    """commands with n (blocks of the section at first), point (where they aim, in first indices) and index (when their turn comes)."""
    size = blocks.groupBy(*KEY).agg(F.count("*").alias("n"))
    c = commands.join(size, KEY, "left").withColumn("n", F.coalesce("n", F.lit(0).cast("long")))
    block = F.coalesce("block", F.lit(0).cast("long"))
    inserted = F.when(F.col("position") == "start", F.lit(0)).when(F.col("position") == "end", F.col("n")).when(F.col("position") == "before", F.least(block, F.col("n"))).otherwise(F.least(block + 1, F.col("n")))
    c = c.withColumn("point", F.when(F.col("op") == "insert", inserted).otherwise(block).cast("long")).withColumn("_k", F.row_number().over(W.partitionBy(*KEY).orderBy("seq")) - 1)
    bits = max(1, int(c.agg(F.max("_k")).first()[0] or 0).bit_length())
    rows = c.select(*KEY, "_k", "point", "op", F.explode(F.sequence(F.lit(0), F.lit(bits - 1))).alias("_bit")).withColumn("_group", F.expr("shiftright(_k, _bit + 1)")).withColumn("_late", F.expr("shiftright(_k, _bit) % 2 = 1"))
    rows = rows.where(F.col("_late") | F.col("op").isin("insert", "delete"))
    # of equal points: what was put in, then those that ask, then what was taken out
    rank = F.when(F.col("_late"), 1).when(F.col("op") == "insert", 0).otherwise(2)
    delta = F.when(F.col("_late"), 0).when(F.col("op") == "insert", 1).otherwise(-1)
    order = W.partitionBy(*KEY, "_bit", "_group").orderBy("point", rank).rowsBetween(W.unboundedPreceding, W.currentRow)
    moved = rows.withColumn("_d", F.sum(delta).over(order)).where("_late").groupBy(*KEY, "_k").agg(F.sum("_d").alias("_moved"))
    return c.join(moved, [*KEY, "_k"], "left").withColumn("index", F.greatest(F.col("point") + F.coalesce("_moved", F.lit(0)), F.lit(0)).cast("long")).drop("_k", "_moved")


def _disordered(found: DataFrame) -> DataFrame:
    """Sections whose script takes a block twice, touches one it has taken, or aims behind the last."""
    taken = found.where("op = 'delete'").groupBy(*KEY, "point").agg(F.min("seq").alias("first"), F.count("*").alias("times"))
    later = found.where("op <> 'insert'").join(taken, [*KEY, "point"], "left").where("point >= n or times > 1 or (op = 'set' and first < seq)")
    return later.select(*KEY).distinct()


def _replayed(found: DataFrame) -> DataFrame:
    """(doc_id, section, pos, block, made, changed): the section's blocks after all commands; made and changed are their seqs."""
    kinds = ", ".join(f"{c} {found.schema[c].dataType.simpleString()}" for c in KEY)

    def walk(key: tuple, rows: pa.Table) -> pa.Table:
        rows = rows.sort_by("seq")
        now: list[list] = [[k, None, None] for k in range(rows.column("n")[0].as_py())]
        for seq, op, at in zip(*(rows.column(c).to_pylist() for c in ("seq", "op", "index")), strict=True):
            if op == "insert" and at <= len(now):
                now.insert(at, [None, seq, None])
            elif op == "delete" and at < len(now):
                del now[at]
            elif op == "set" and at < len(now):
                now[at][2] = seq
        cols = list(zip(*now, strict=True)) or [(), (), ()]
        return pa.table({"doc_id": pa.array([key[0].as_py()] * len(now), rows.schema.field("doc_id").type), "section": pa.array([key[1].as_py()] * len(now), rows.schema.field("section").type), "pos": pa.array(range(len(now)), pa.int64()), **{c: pa.array(v, pa.int64()) for c, v in zip(("block", "made", "changed"), cols, strict=True)}})

    return found.select(*KEY, "seq", "op", "index", "n").groupBy(*KEY).applyInArrow(walk, f"{kinds}, pos long, block long, made long, changed long")


def applied(commands: DataFrame, blocks: DataFrame) -> DataFrame:
    """(doc_id, section, pos, block, made, text): all blocks after the script; block is the first index, made the seq of the insert."""
    found = resolved(commands, blocks)
    odd = _disordered(found)
    even = found.join(odd, KEY, "left_anti")
    gone = even.where("op = 'delete'").select(*KEY, F.col("point").alias("block"))
    sets = even.where("op = 'set'").groupBy(*KEY, F.col("point").alias("block")).agg(F.max("seq").alias("changed"))
    scripted = even.select(*KEY).distinct()
    none = F.lit(None).cast("long")
    old = blocks.join(scripted, KEY, "left_semi").select(*KEY, "block").join(gone, [*KEY, "block"], "left_anti").join(sets, [*KEY, "block"], "left").select(*KEY, F.col("block").alias("point"), F.lit(1).alias("side"), F.lit(0).cast("long").alias("made"), "block", "changed")
    new = even.where("op = 'insert'").select(*KEY, "point", F.lit(0).alias("side"), F.col("seq").cast("long").alias("made"), none.alias("block"), none.alias("changed"))
    placed = old.union(new).withColumn("pos", F.row_number().over(W.partitionBy(*KEY).orderBy("point", "side", "made")).cast("long") - 1)
    placed = placed.select(*KEY, "pos", "block", F.when(F.col("side") == 0, F.col("made")).alias("made"), F.col("changed").cast("long"))
    placed = placed.unionByName(_replayed(found.join(odd, KEY, "left_semi")))
    texts = commands.select(*KEY, F.col("seq").cast("long").alias("seq"), F.col("text").alias("new"))
    out = placed.withColumn("seq", F.coalesce("changed", "made")).join(texts, [*KEY, "seq"], "left").join(blocks.select(*KEY, "block", "text"), [*KEY, "block"], "left")
    untouched = blocks.join(commands.select(*KEY).distinct(), KEY, "left_anti").select(*KEY, F.col("block").alias("pos"), "block", none.alias("made"), "text")
    return out.select(*KEY, "pos", "block", "made", F.when(F.col("seq").isNotNull(), F.col("new")).otherwise(F.col("text")).alias("text")).unionByName(untouched)


def row_points(inserts: DataFrame) -> DataFrame:
    """inserts of rows (doc_id, section, block, seq, at, count, rows) with index: where they land after earlier ones into the same table.

    at is a row as the table stood at first (null: behind its last of `rows`); an earlier insert counts if it landed there or before.
    """
    item = F.struct("seq", "at", "count", "rows")
    step = lambda acc, x: F.array_append(acc, F.struct(x["seq"].alias("seq"), F.when(x["at"].isNull(), x["rows"] + F.aggregate(acc, F.lit(0).cast("long"), lambda a, e: a + e["count"])).otherwise(x["at"] + F.aggregate(acc, F.lit(0).cast("long"), lambda a, e: a + F.when(e["index"] <= x["at"], e["count"]).otherwise(0))).cast("long").alias("index"), x["count"].cast("long").alias("count")))
    start = F.array().cast("array<struct<seq:bigint,index:bigint,count:bigint>>")
    by = inserts.withColumn("seq", F.col("seq").cast("long")).groupBy(*KEY, "block").agg(F.array_sort(F.collect_list(item)).alias("all"))
    return by.select(*KEY, "block", F.explode(F.aggregate("all", start, step)).alias("x")).select(*KEY, "block", "x.seq", "x.index", "x.count")


def scripts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as commands, ten to a document; some take a block twice or aim behind the last."""
    e = table(spark, sf_dir, "events")
    k = F.col("user_id") % 5
    op = F.when(k < 2, "insert").when(k == 2, "delete").otherwise("set")
    position = F.get(F.array(*map(F.lit, ("after", "before", "start", "end"))), (F.col("event_id") % 7 % 4).cast("int"))
    block = F.when(F.col("event_id") % 3 == 0, F.col("user_id") % 3).otherwise((F.col("user_id") * 7 + F.col("event_id")) % 9)
    return e.select(F.expr("event_id div 10").alias("doc_id"), F.lit(0).cast("long").alias("section"), (F.col("event_id") % 10).alias("seq"), op.alias("op"), block.alias("block"), position.alias("position"), F.format_string("%s %d", "event_type", F.col("event_id")).alias("text"))


_SCRIPT = f"""{PARAGRAPH}, size AS (SELECT doc_id, count(*) AS n FROM paragraph GROUP BY doc_id),
c0 AS (SELECT event_id // 10 AS doc_id, event_id % 10 AS seq, CASE WHEN user_id % 5 < 2 THEN 'insert' WHEN user_id % 5 = 2 THEN 'delete' ELSE 'set' END AS op, CASE WHEN event_id % 3 = 0 THEN user_id % 3 ELSE (user_id * 7 + event_id) % 9 END AS block,
  ['after', 'before', 'start', 'end'][1 + event_id % 7 % 4] AS position, event_type || ' ' || event_id AS text FROM events),
c1 AS (SELECT c0.*, coalesce(n, 0) AS n FROM c0 LEFT JOIN size USING (doc_id)),
c AS (SELECT *, CASE WHEN op <> 'insert' THEN block WHEN position = 'start' THEN 0 WHEN position = 'end' THEN n WHEN position = 'before' THEN least(block, n) ELSE least(block + 1, n) END AS point FROM c1),
j AS (SELECT a.doc_id, a.seq, a.op, a.text, a.n, a.point, count(b.seq) FILTER (b.op = 'insert' AND b.point <= a.point) AS more, count(b.seq) FILTER (b.op = 'delete' AND b.point < a.point) AS less FROM c a LEFT JOIN c b ON b.doc_id = a.doc_id AND b.seq < a.seq GROUP BY a.doc_id, a.seq, a.op, a.text, a.n, a.point),
i AS (SELECT doc_id, seq, op, text, n, point, greatest(0, point + more - less) AS index FROM j)"""


@query(f"WITH {_SCRIPT} SELECT doc_id, seq, op, point, index FROM i")
def script_indices(spark: SparkSession, sf_dir: str) -> DataFrame:
    return resolved(scripts(spark, sf_dir), paragraphs(spark, sf_dir)).select("doc_id", "seq", "op", "point", "index")


@query(f"""WITH RECURSIVE {_SCRIPT}, o AS (SELECT doc_id, list({{'block': block, 'made': NULL::BIGINT, 'text': text}} ORDER BY block) AS now FROM paragraph GROUP BY doc_id),
r AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY seq) AS k FROM i),
walk AS (SELECT d.doc_id, 0::BIGINT AS k, coalesce(now, []) AS now FROM (SELECT doc_id FROM o UNION SELECT doc_id FROM c) d LEFT JOIN o USING (doc_id)
  UNION ALL SELECT w.doc_id, r.k, CASE WHEN op = 'insert' AND index <= len(now) THEN now[1 : index] || [{{'block': NULL::BIGINT, 'made': seq, 'text': r.text}}] || now[index + 1 :]
    WHEN op = 'delete' AND index < len(now) THEN now[1 : index] || now[index + 2 :] WHEN op = 'set' AND index < len(now) THEN now[1 : index] || [{{'block': now[index + 1].block, 'made': now[index + 1].made, 'text': r.text}}] || now[index + 2 :] ELSE now END FROM walk w JOIN r ON r.doc_id = w.doc_id AND r.k = w.k + 1),
e AS (SELECT doc_id, max_by(now, k) AS now FROM walk GROUP BY doc_id), f AS (SELECT doc_id, unnest(range(len(now))) AS pos, unnest(now) AS x FROM e)
SELECT doc_id, pos, x.block AS block, x.made AS made, x.text AS text FROM f""")
def script_applied(spark: SparkSession, sf_dir: str) -> DataFrame:
    return applied(scripts(spark, sf_dir), paragraphs(spark, sf_dir)).select("doc_id", "pos", "block", "made", "text")
