"""Tables, images and charts put into documents, and images resized: commands checked, placed and given names, all at once.

commands: doc_id, section, seq (unique in a document), op (insert_table, insert_image, insert_chart or resize_image), block
(as blocks stood at first; of an insert, the one it goes before, or their number for the end), rows (array of arrays of cells),
content (an image's bytes), width, height (units), chart (kind, categories, series of name and values, width and height in pixels).
blocks: doc_id, section, block, kind (paragraph or table), text. images: doc_id, section, block, pos, bin_ref, width, height.
bins: doc_id, bin_ref, a row for each stored file.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quire.functions.asof import as_of
from quire.operators.script import KEY, applied
from quire.plans.registry import query
from quire.sources.adapters import PARAGRAPH, paragraphs, table
from quire.sources.shared import materialised

#: Kinds of charts, a chart's size without one in pixels, units of a pixel.
CHARTS = ("bar", "pie", "line")
CHART_SIZE = (400.0, 260.0)
PIXEL = 75
CHART = "struct<kind:string,categories:array<string>,series:array<struct<name:string,values:array<double>>>,width:double,height:double>"


def checked(commands: DataFrame, blocks: DataFrame, images: DataFrame) -> DataFrame:
    """commands with status: ok, or why it changes nothing.

    What is wrong with the object comes first (empty_table, empty_bytes, chart_kind, no_categories, no_series, ragged,
    bad_size), then no_section, out_of_range, not_paragraph and no_image; bad_op is any other op. Nulls count as absent.
    """
    size = blocks.groupBy(*KEY).agg(F.count("*").alias("_n"))
    there = blocks.select(*KEY, "block", F.col("kind").alias("_kind"))
    pictured = images.select(*KEY, "block", F.lit(True).alias("_image")).distinct()
    op, chart = F.col("op"), F.col("chart")
    empty = lambda c: F.coalesce(F.size(c), F.lit(0)) <= 0
    series = F.coalesce(chart["series"], F.array().cast("array<struct<name:string,values:array<double>>>"))
    ragged = F.exists(series, lambda s: F.coalesce(F.size(s["values"]), F.lit(0)) != F.size(chart["categories"]))
    cells = F.aggregate(F.coalesce("rows", F.array().cast("array<array<string>>")), F.lit(0), lambda a, r: a + F.greatest(F.coalesce(F.size(r), F.lit(0)), F.lit(0)))
    wrong = (
        F.when((op == "insert_table") & (cells == 0), "empty_table")
        .when((op == "insert_image") & (F.coalesce(F.octet_length("content"), F.lit(0)) == 0), "empty_bytes")
        .when((op == "insert_chart") & ~F.coalesce(F.lower(F.trim(chart["kind"])).isin(*CHARTS), F.lit(False)), "chart_kind")
        .when((op == "insert_chart") & empty(chart["categories"]), "no_categories")
        .when((op == "insert_chart") & empty(series), "no_series")
        .when((op == "insert_chart") & ragged, "ragged")
        .when((op == "resize_image") & ~F.coalesce((F.col("width") > 0) & (F.col("height") > 0), F.lit(False)), "bad_size")
        .when(~F.coalesce(op.isin("insert_table", "insert_image", "insert_chart", "resize_image"), F.lit(False)), "bad_op")
    )
    resize = op == "resize_image"
    most = F.when(resize, F.col("_n") - 1).otherwise(F.col("_n"))
    where = (
        F.when(F.col("_n").isNull(), "no_section")
        .when(~F.coalesce(F.col("block").between(F.lit(0), most), F.lit(False)), "out_of_range")
        .when(resize & ~F.coalesce(F.col("_kind") == "paragraph", F.lit(False)), "not_paragraph")
        .when(resize & F.col("_image").isNull(), "no_image")
    )
    known = commands.join(size, KEY, "left").join(there, [*KEY, "block"], "left").join(pictured, [*KEY, "block"], "left")
    return known.select(*commands.columns, F.coalesce(wrong, where, F.lit("ok")).alias("status"))


def bin_refs(inserts: DataFrame, bins: DataFrame) -> DataFrame:
    """(doc_id, seq, bin_ref) of a document's new images by seq: `imgN`, N the next number behind the count of its files that no file has.

    The k-th new one takes the k-th free number above the count: k further, and one more for each number taken by
    then, which is looked up by an as-of join on how many free ones lie before each taken one.
    """
    number = F.when(F.rlike("bin_ref", F.lit("^img[1-9][0-9]{0,17}$")), F.substr("bin_ref", F.lit(4)).cast("long"))
    held = bins.groupBy("doc_id").agg(F.count("*").alias("held"))
    taken = bins.select("doc_id", number.alias("t")).distinct().join(held, "doc_id").where("t > held")
    taken = taken.withColumn("j", F.row_number().over(Window.partitionBy("doc_id").orderBy("t")))
    free = taken.groupBy("doc_id", (F.col("t") - F.col("j") - F.col("held")).alias("on")).agg(F.max("j").cast("long").alias("skipped"))
    k = F.row_number().over(Window.partitionBy("doc_id").orderBy("seq"))
    asked = inserts.select("doc_id", "seq", (k - 1).cast("long").alias("on")).join(held, "doc_id", "left")
    found = as_of(asked, free, ["doc_id"], "on", ["skipped"], width=1 << 16)
    return found.select("doc_id", "seq", F.concat(F.lit("img"), F.coalesce("held", F.lit(0)) + F.col("on") + 1 + F.coalesce("skipped", F.lit(0))).alias("bin_ref"))


def placed_objects(commands: DataFrame, blocks: DataFrame, images: DataFrame, bins: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(blocks, images) after the commands that are ok.

    Blocks are (doc_id, section, pos, block, made, kind, text): block is the first index, made the seq of the insert. An
    image or chart stands in a paragraph of its own. Images are (doc_id, section, pos, at, bin_ref, width, height), pos
    their block, at their place in it; a chart has no bin_ref. Of resizes of one block the last counts, for its first image.
    """
    good = materialised(checked(commands, blocks, images).where("status = 'ok'").drop("rows", "content"))
    inserts = good.where("op <> 'resize_image'")
    moves = applied(inserts.select(*KEY, "seq", F.lit("insert").alias("op"), "block", F.lit("before").alias("position"), F.lit(None).cast("string").alias("text")), blocks.select(*KEY, "block", "text"))
    kinds = inserts.select("doc_id", F.col("seq").cast("long").alias("made"), F.when(F.col("op") == "insert_table", "table").otherwise("paragraph").alias("new"))
    after = materialised(moves.join(kinds, ["doc_id", "made"], "left").join(blocks.select(*KEY, "block", "kind"), [*KEY, "block"], "left").select(*KEY, "pos", "block", "made", F.coalesce("new", "kind").alias("kind"), "text"))
    sizes = good.where("op = 'resize_image'").groupBy(*KEY, "block").agg(F.max_by(F.struct("width", "height"), "seq").alias("s"))
    first = images.groupBy(*KEY, "block").agg(F.min("pos").alias("_first"))
    old = images.join(first, [*KEY, "block"]).join(sizes, [*KEY, "block"], "left").withColumn("s", F.when(F.col("pos") == F.col("_first"), F.col("s")))
    old = old.select(*KEY, "block", F.col("pos").cast("long").alias("at"), "bin_ref", F.coalesce("s.width", "width").cast("long").alias("width"), F.coalesce("s.height", "height").cast("long").alias("height"))
    old = old.join(after.where("block is not null").select(*KEY, "block", "pos"), [*KEY, "block"])
    pixels = lambda c, k: F.round(F.when((c > 0) & (c < float("inf")) & ~F.isnan(c), c).otherwise(CHART_SIZE[k]) * PIXEL).cast("long")
    chart = F.col("op") == "insert_chart"
    new = inserts.where("op <> 'insert_table'").join(bin_refs(inserts.where("op = 'insert_image'"), bins), ["doc_id", "seq"], "left")
    new = new.select("doc_id", F.col("seq").cast("long").alias("made"), "bin_ref", F.when(chart, pixels(F.col("chart.width"), 0)).otherwise(F.col("width")).cast("long").alias("width"), F.when(chart, pixels(F.col("chart.height"), 1)).otherwise(F.col("height")).cast("long").alias("height"))
    new = new.join(after.where("made is not null").select(*KEY, "pos", "made"), ["doc_id", "made"])
    cols = [*KEY, "pos", "at", "bin_ref", "width", "height"]
    return after, old.select(*cols).unionByName(new.withColumn("at", F.lit(0).cast("long")).select(*cols))


def _given(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    """Ten commands a document from events; every third paragraph has images, every seventh stands for a table."""
    e = table(spark, sf_dir, "events")
    k = F.col("event_id")
    none = lambda t: F.lit(None).cast(t)
    chart = F.struct(F.when(k % 11 == 0, "radar").otherwise("Bar ").alias("kind"), F.array(F.lit("a"), F.lit("b")).alias("categories"), F.array(F.struct(F.lit("s").alias("name"), F.when(k % 13 == 0, F.array("value")).otherwise(F.array("value", "value")).alias("values"))).alias("series"), F.when(k % 2 == 0, F.lit(100.0)).alias("width"), F.lit(-1.0).alias("height")).cast(CHART)
    op = F.element_at(F.array(*[F.lit(x) for x in ("insert_table", "insert_image", "insert_chart", "resize_image")]), (k % 4 + 1).cast("int"))
    commands = e.select(
        F.expr("event_id div 10").alias("doc_id"), F.lit(0).cast("long").alias("section"), k.alias("seq"), op.alias("op"), (F.col("user_id") % 5).alias("block"),
        F.when(k % 4 == 0, F.array(F.array("event_type"))).otherwise(none("array<array<string>>")).alias("rows"), F.when(k % 5 > 0, F.col("event_type").cast("binary")).alias("content"),
        (k % 90 - 3).alias("width"), F.lit(50).cast("long").alias("height"), chart.alias("chart"),
    )
    p = paragraphs(spark, sf_dir)
    b = F.col("block")
    blocks = p.select(*KEY, b.cast("long").alias("block"), F.when(b % 7 == 4, "table").otherwise("paragraph").alias("kind"), "text")
    images = p.where("block % 3 = 0").select(*KEY, b.cast("long").alias("block"), F.explode(F.array(F.lit(2), F.lit(5))).alias("pos")).withColumn("bin_ref", F.concat(F.lit("img"), (F.col("block") + F.col("pos")).cast("string"))).withColumn("width", F.lit(7)).withColumn("height", F.lit(8))
    return commands, blocks, images, images.select("doc_id", "bin_ref")


_OBJECTS = f"""{PARAGRAPH}, b AS (SELECT doc_id, block, CASE WHEN block % 7 = 4 THEN 'table' ELSE 'paragraph' END AS kind FROM paragraph), n AS (SELECT doc_id, count(*) AS n FROM b GROUP BY doc_id),
e AS (SELECT event_id // 10 AS doc_id, event_id AS seq, event_id % 4 AS op, user_id % 5 AS block, event_id % 90 - 3 AS width FROM events),
c AS (SELECT e.*, n, CASE WHEN op = 1 AND seq % 5 = 0 THEN 'empty_bytes' WHEN op = 2 AND seq % 11 = 0 THEN 'chart_kind' WHEN op = 2 AND seq % 13 = 0 THEN 'ragged' WHEN op = 3 AND width <= 0 THEN 'bad_size' WHEN n IS NULL THEN 'no_section'
  WHEN e.block > n OR op = 3 AND e.block = n THEN 'out_of_range' WHEN op = 3 AND e.block % 7 = 4 THEN 'not_paragraph' WHEN op = 3 AND e.block % 3 > 0 THEN 'no_image' ELSE 'ok' END AS status FROM e LEFT JOIN n USING (doc_id)),
put AS (SELECT * FROM c WHERE status = 'ok' AND op < 3)"""


@query(f"WITH {_OBJECTS} SELECT doc_id, seq, status FROM c")
def object_checks(spark: SparkSession, sf_dir: str) -> DataFrame:
    commands, blocks, images, _ = _given(spark, sf_dir)
    return checked(commands, blocks, images).select("doc_id", "seq", "status")


@query(f"""WITH {_OBJECTS}, old AS (SELECT b.doc_id, b.block, b.block + (SELECT count(*) FROM put WHERE put.doc_id = b.doc_id AND put.block <= b.block) AS pos FROM b WHERE block % 3 = 0),
size AS (SELECT doc_id, block, max_by(width, seq) AS width FROM c WHERE status = 'ok' AND op = 3 GROUP BY ALL),
have AS (SELECT doc_id, block + unnest([2, 5]) AS num FROM b WHERE block % 3 = 0), held AS (SELECT doc_id, count(*) AS held, list(DISTINCT num) AS nums FROM have GROUP BY doc_id),
img AS (SELECT doc_id, seq, row_number() OVER (PARTITION BY doc_id ORDER BY seq) AS k FROM put WHERE op = 1),
new AS (SELECT p.*, block + (SELECT count(*) FROM put q WHERE q.doc_id = p.doc_id AND (q.block < p.block OR q.block = p.block AND q.seq < p.seq)) AS pos, img.k FROM put p LEFT JOIN img USING (doc_id, seq))
SELECT old.doc_id, pos::BIGINT AS pos, u.at_::BIGINT AS at, 'img' || (block + u.at_) AS bin_ref, CASE WHEN u.at_ = 2 THEN coalesce(width, 7) ELSE 7 END::BIGINT AS width, CASE WHEN u.at_ = 2 AND width IS NOT NULL THEN 50 ELSE 8 END::BIGINT AS height FROM old LEFT JOIN size USING (doc_id, block), (SELECT unnest([2, 5]) AS at_) u
UNION ALL SELECT doc_id, pos::BIGINT, 0, CASE WHEN op = 1 THEN 'img' || list_filter(range(held + 1, held + 100), lambda x: NOT list_contains(nums, x))[k] END, CASE WHEN op = 1 THEN width WHEN seq % 2 = 0 THEN 7500 ELSE 30000 END::BIGINT, CASE WHEN op = 1 THEN 50 ELSE 19500 END::BIGINT FROM new JOIN held USING (doc_id) WHERE op > 0""")
def object_images(spark: SparkSession, sf_dir: str) -> DataFrame:
    return placed_objects(*_given(spark, sf_dir))[1].drop("section")
