"""Where a caret stands, and which cell lies beside another."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quire.functions.asof import as_of
from quire.operators.spatial import cell_at, cell_at_sparse
from quire.plans.registry import query
from quire.sources.adapters import BOX, PARAGRAPH, boxes, paragraphs, table
from quire.sources.shared import dealt

#: How far past a cell's edge its neighbour is looked for, in pixels.
PAST = 3.0
#: Boxes of a page up to which points meet all of them; a page of more goes by tiles.
SPARSE = 1024
LINE = ["doc_id", "page", "section", "para"]
_RUN = ["char_start", "char_len", "x0", "x1", "top", "height"]
#: Offsets in a bucket of the look-up, and how many runs a request comes with, for the number of tasks.
WIDTH, RUNS = 1 << 16, 16


def caret_rects(requests: DataFrame, runs: DataFrame, *, width: int = WIDTH) -> DataFrame:
    """requests (req, doc_id, page, section, para, offset) with x, top and height of the caret; null where the paragraph is not on the page.

    In a run the caret stands in proportion to its characters. Between two runs it stands before the next one; before
    the first it stands at that one's beginning; behind the last, or in a gap, at the last one's end. Of runs that
    begin together the leftmost counts. The run is looked up by an as-of join, so no paragraph is one task's.
    """
    # runs and requests are dealt out once, by lines and buckets of offsets
    by = [*LINE, "bucket"]
    bucket = lambda c: F.floor(F.col(c) / width)
    asked = requests.withColumn("offset", F.col("offset").cast("long"))
    count = requests.count()
    there = dealt(runs.select(*LINE, F.col("char_start").cast("long").alias("char_start"), *_RUN[1:]).withColumn("bucket", bucket("char_start")), by, RUNS * count)
    single = there.groupBy(*by, "char_start").agg(F.min(F.struct("x0", "x1", "top", "height", "char_len")).alias("r")).select(*by, "char_start", *[F.col(f"r.{c}").alias(c) for c in _RUN[1:]])
    ends = single.groupBy(*LINE).agg(F.min(F.struct(*_RUN)).alias("first"), F.max(F.struct(*_RUN)).alias("last"))
    here = dealt(asked.where("offset is not null").withColumn("bucket", bucket("offset")), by, RUNS * count)
    at = as_of(here, single.withColumn("offset", F.col("char_start")), LINE, "offset", _RUN, width=width, bucket="bucket").join(ends, LINE, "left")
    inside = F.col("offset") < F.col("char_start") + F.greatest("char_len", F.lit(1))
    along = F.when(F.col("char_len") > 0, (F.col("offset") - F.col("char_start")) / F.col("char_len")).otherwise(0.0)
    x = F.when(F.col("char_start").isNull(), F.col("first.x0")).when(inside, F.col("x0") + (F.col("x1") - F.col("x0")) * along).otherwise(F.col("last.x1"))
    pick = lambda c: F.when(F.col("char_start").isNull(), F.col(f"first.{c}")).when(inside, F.col(c)).otherwise(F.col(f"last.{c}"))
    found = at.select(*asked.columns, x.alias("x"), pick("top").alias("top"), pick("height").alias("height"))
    nowhere = asked.where("offset is null").select("*", *[F.lit(None).cast("double").alias(c) for c in ("x", "top", "height")])
    return found.unionByName(nowhere)


def neighbours(placed: DataFrame) -> DataFrame:
    """(box, direction, neighbour): the smallest box just past the middle of each edge of each box of a page; null where there is none."""
    x, y, w, h = (F.col(c) for c in "xywh")
    point = lambda name, px, py: F.struct(F.lit(name).alias("direction"), px.alias("px"), py.alias("py"))
    four = F.array(point("left", x - PAST, y + h / 2), point("right", x + w + PAST, y + h / 2), point("up", x + w / 2, y - PAST), point("down", x + w / 2, y + h + PAST))
    probes = placed.select(F.col("box").alias("own"), "page", F.explode(four).alias("p")).select(F.struct("own", "p.direction").alias("probe"), "page", "p.px", "p.py")
    most = placed.groupBy("page").agg(F.count("*").alias("n")).agg(F.max("n")).first()[0] or 0
    found = cell_at_sparse(probes, placed) if most <= SPARSE else probes.select("probe").join(cell_at(probes, placed), "probe", "left")
    return found.select(F.col("probe.own").alias("box"), "probe.direction", F.col("box").alias("neighbour"))


def _runs(spark: SparkSession, sf_dir: str, lines: DataFrame) -> DataFrame:
    """Paragraphs' text in runs of eight characters with a gap of one after every second; twenty runs to a page. Of the pages that lines (doc_id, section, para, page) name, all runs."""
    p = paragraphs(spark, sf_dir).select("doc_id", "section", F.col("block").alias("para"), F.length("text").alias("n"))
    last = F.greatest(F.ceil(F.col("n") / 8) - 1, F.lit(0))
    on = p.join(lines.select(*LINE).distinct(), ["doc_id", "section", "para"]).where((F.col("page") >= 0) & (F.col("page") * 20 <= last))
    each = on.select("doc_id", "section", "para", "n", F.explode(F.sequence(F.col("page") * 20, F.least(F.col("page") * 20 + 19, last))).alias("k"))
    start = F.col("k") * 8
    length = F.greatest(F.least(F.when(F.col("k") % 2 == 1, 7).otherwise(8), F.col("n") - start), F.lit(0))
    x0 = (F.col("k") % 10 * 50).cast("double")
    return each.select("doc_id", F.floor(F.col("k") / 20).alias("page"), "section", "para", start.cast("long").alias("char_start"), length.cast("long").alias("char_len"), x0.alias("x0"), (x0 + length * 6.0).alias("x1"), (F.floor(F.col("k") / 10) * 16).cast("double").alias("top"), F.lit(12.0).alias("height"))


_RUNS = f"""{PARAGRAPH}, p AS (SELECT doc_id, block AS para, length(text) AS n FROM paragraph), k AS (SELECT *, unnest(range(greatest(ceil(n / 8.0), 1)::BIGINT)) AS k FROM p),
run AS (SELECT doc_id, para, k // 20 AS page, k * 8 AS s, greatest(least(CASE WHEN k % 2 = 1 THEN 7 ELSE 8 END, n - k * 8), 0) AS l, k % 10 * 50.0 AS x0, k // 10 * 16.0 AS top FROM k),
q AS (SELECT event_id, event_id // 10 AS doc_id, user_id % 6 AS para, event_id % 9 // 8 AS page, event_id % 3 * 70 + user_id % 60 - 2 AS at_ FROM events),
hit AS (SELECT q.event_id, min_by({{'x': x0 + CASE WHEN l > 0 THEN l * 6.0 * (at_ - s) / l ELSE 0 END, 'top': top}}, s) AS c FROM q JOIN run USING (doc_id, para, page) WHERE at_ >= s AND at_ < s + greatest(l, 1) GROUP BY q.event_id),
edge AS (SELECT doc_id, para, page, min(s) AS low, min_by({{'x': x0, 'top': top}}, s) AS first_, max_by({{'x': x0 + l * 6.0, 'top': top}}, s) AS last_ FROM run GROUP BY ALL)"""


@query(f"WITH {_RUNS} SELECT q.event_id, coalesce(c.x, CASE WHEN at_ < low THEN first_.x ELSE last_.x END)::DOUBLE AS x, coalesce(c.top, CASE WHEN at_ < low THEN first_.top ELSE last_.top END)::DOUBLE AS top FROM q LEFT JOIN hit USING (event_id) LEFT JOIN edge USING (doc_id, para, page)")
def caret_places(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events")
    offset = F.col("event_id") % 3 * 70 + F.col("user_id") % 60 - 2
    asked = e.select("event_id", F.expr("event_id div 10").alias("doc_id"), F.floor(F.col("event_id") % 9 / 8).alias("page"), F.lit(0).cast("long").alias("section"), (F.col("user_id") % 6).alias("para"), offset.alias("offset"))
    return caret_rects(asked.withColumnRenamed("event_id", "req"), _runs(spark, sf_dir, asked)).select(F.col("req").alias("event_id"), "x", "top")


@query(f"""WITH {BOX}, d AS (SELECT box, page, 'left' AS direction, x - 3 AS px, y + h / 2 AS py FROM box UNION ALL SELECT box, page, 'right', x + w + 3, y + h / 2 FROM box UNION ALL SELECT box, page, 'up', x + w / 2, y - 3 FROM box UNION ALL SELECT box, page, 'down', x + w / 2, y + h + 3 FROM box)
SELECT d.box, direction, arg_min(b.box, [b.w * b.h, b.box]) AS neighbour FROM d LEFT JOIN box b ON b.page = d.page AND px BETWEEN b.x AND b.x + b.w AND py BETWEEN b.y AND b.y + b.h GROUP BY d.box, direction""")
def neighbour_cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neighbours(boxes(spark, sf_dir))
