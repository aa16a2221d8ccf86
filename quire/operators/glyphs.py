"""Where the text of a page description stands.

The state of a page (line, place in the line, size, leading) is a chain of affine maps, one an operation, and so has
prefixes that can be worked out in pieces: within stretches of operations with what comes from before left open, over
the stretches (one row each) with it filled in, and back. No page is one task's.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quire.plans.registry import query
from quire.sources.adapters import PARAGRAPH, paragraphs
from quire.sources.packages import pdf_lines
from quire.sources.pdf import ems, read_pages, text_operations

#: Operations in a stretch.
WIDTH = 1 << 14
#: Fixed values of the format: size and leading before any is set.
SIZE, LEADING = 12.0, 0.0


def placed_shows(ops: DataFrame, by: list[str], *, width: int = WIDTH) -> DataFrame:
    """ops (by, seq, op, numbers, text, at, shift, advance) to (by, seq, x, y, size, text, at, shift, advance) of those that show text.

    BT, and Tm with six operands, set the line; Td and TD move it, TD also sets the leading; T*, ' and " move it down
    by the leading. Each of these puts the place at the line's beginning, and what is shown moves it on by its ems
    times the size. Operands that are missing count as 0; Tf needs two and TL one to count.
    """
    op, n = F.col("op"), F.size("numbers")
    number = lambda i: F.coalesce(F.get("numbers", F.lit(i)), F.lit(0.0))
    resets = (op == "BT") | ((op == "Tm") & (n == 6))
    shifts, downs = op.isin("Td", "TD"), op.isin("T*", "'", '"')
    moves = resets | shifts | downs
    local = Window.partitionBy(*by, "_stretch").orderBy("seq")
    rows = ops.withColumn("_stretch", F.floor(F.col("seq") / width)).select(
        *by, "_stretch", "seq", "text", "at", "shift", "advance",
        F.last(F.when((op == "Tf") & (n >= 2), number(1)), ignorenulls=True).over(local).alias("_size"),
        F.last(F.when((op == "TL") & (n >= 1), number(0)).when(op == "TD", -number(1)), ignorenulls=True).over(local).alias("_leading"),
        F.sum(resets.cast("long")).over(local).alias("_line"), F.sum(moves.cast("long")).over(local).alias("_move"), downs.alias("_down"),
        F.when(op == "Tm", F.when(n == 6, number(4)).otherwise(0.0)).when(shifts, number(0)).otherwise(0.0).alias("_dx"),
        F.when(op == "Tm", F.when(n == 6, number(5)).otherwise(0.0)).when(shifts, number(1)).otherwise(0.0).alias("_dy"),
    )
    # A sum and, beside it, how often an amount from before the stretch comes in.
    on_line, in_line = Window.partitionBy(*by, "_stretch", "_line").orderBy("seq"), Window.partitionBy(*by, "_stretch", "_move").orderBy("seq")
    down = lambda known: F.col("_down") & (F.col("_leading").isNotNull() if known else F.col("_leading").isNull())
    sized = lambda known: F.when(F.col("_size").isNotNull() if known else F.col("_size").isNull(), F.col("advance") * (F.col("_size") if known else F.lit(1.0))).otherwise(0.0)
    rows = rows.select(
        "*",
        F.sum("_dx").over(on_line).alias("_x"),
        F.sum(F.col("_dy") - F.when(down(True), F.col("_leading")).otherwise(0.0)).over(on_line).alias("_y"),
        F.sum(down(False).cast("double")).over(on_line).alias("_y_open"),
        F.sum(sized(True)).over(in_line).alias("_off"), F.sum(sized(False)).over(in_line).alias("_off_open"),
        F.coalesce(F.sum(sized(True)).over(in_line.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0)).alias("_before"),
        F.coalesce(F.sum(sized(False)).over(in_line.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0)).alias("_before_open"),
    )
    ends = ["_size", "_leading", "_line", "_move", "_x", "_y", "_y_open", "_off", "_off_open"]
    along = Window.partitionBy(*by).orderBy("_stretch")
    earlier = along.rowsBetween(Window.unboundedPreceding, -1)
    stretches = rows.groupBy(*by, "_stretch").agg(F.max_by(F.struct(*ends), "seq").alias("e")).select(*by, "_stretch", "e.*")
    stretches = stretches.select(
        *by, "_stretch", "_x",
        F.coalesce(F.last("_size", ignorenulls=True).over(earlier), F.lit(SIZE)).alias("size_in"), F.coalesce(F.last("_leading", ignorenulls=True).over(earlier), F.lit(LEADING)).alias("leading_in"),
        "_y", "_y_open", "_off", "_off_open",
        F.sum((F.col("_line") > 0).cast("long")).over(along).alias("line_group"), F.sum((F.col("_move") > 0).cast("long")).over(along).alias("move_group"),
    ).select(*by, "_stretch", "size_in", "leading_in", "line_group", "move_group", "_x", (F.col("_y") - F.col("_y_open") * F.col("leading_in")).alias("_y"), (F.col("_off") + F.col("_off_open") * F.col("size_in")).alias("_off"))
    # A stretch starts from the sums since the last one that has a reset, up to the one before it.
    since = lambda c, group: F.sum(c).over(Window.partitionBy(*by, group).orderBy("_stretch"))
    stretches = stretches.select(*by, "_stretch", "size_in", "leading_in", since("_x", "line_group").alias("_x"), since("_y", "line_group").alias("_y"), since("_off", "move_group").alias("_off"))
    start = lambda c: F.coalesce(F.lag(c).over(along), F.lit(0.0))
    stretches = stretches.select(*by, "_stretch", "size_in", "leading_in", start("_x").alias("x_in"), start("_y").alias("y_in"), start("_off").alias("off_in"))
    kept = rows.where("text <> ''").join(stretches, [*by, "_stretch"])
    fresh = F.col("_line") > 0
    x = F.col("_x") + F.when(fresh, 0.0).otherwise(F.col("x_in")) + F.col("_before") + F.col("_before_open") * F.col("size_in") + F.when(F.col("_move") > 0, 0.0).otherwise(F.col("off_in"))
    y = F.col("_y") - F.col("_y_open") * F.col("leading_in") + F.when(fresh, 0.0).otherwise(F.col("y_in"))
    return kept.select(*by, "seq", x.alias("x"), y.alias("y"), F.coalesce("_size", "size_in").alias("size"), "text", "at", "shift", "advance")


def glyphs(shows: DataFrame, by: list[str]) -> DataFrame:
    """(by, seq, k, x, y, size, ch) of each character shown, k from 0 within its operation."""

    @F.pandas_udf("array<double>")
    def behind(text: pd.Series, at: pd.Series, shift: pd.Series) -> pd.Series:
        return pd.Series([ems(t, a, s) for t, a, s in zip(text, at, shift, strict=True)])

    each = shows.select(*by, "seq", "x", "y", "size", F.posexplode(F.arrays_zip(F.split("text", "").alias("ch"), behind("text", "at", "shift").alias("em"))).alias("k", "g"))
    return each.select(*by, "seq", "k", (F.col("x") + F.col("g.em") * F.col("size")).alias("x"), "y", "size", F.col("g.ch").alias("ch"))


def painted(placed: DataFrame, pages: DataFrame, by: list[str]) -> DataFrame:
    """Glyphs in hundredths of a point from the top left corner of their page; pages: by, height."""
    return placed.join(pages.select(*by, "height"), by).withColumn("x", F.col("x") * 100).withColumn("y", (F.col("height") - F.col("y")) * 100).withColumn("size", F.col("size") * 100).drop("height")


def pdf_text(files: DataFrame) -> DataFrame:
    """files (path, content) to (path, page, base, text): lines of text by rounded baseline, the largest at the top."""
    by = ["path", "page"]
    placed = glyphs(placed_shows(text_operations(read_pages(files).where("error is null"), by), by), by)
    lines = pdf_lines(placed.select(F.struct(*by).alias("page"), "x", "y", "ch"))
    return lines.select("page.path", F.col("page.page").alias("page"), "base", "text")


def _streams(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A page description a document, an operation that shows text for each paragraph; every kind of move by turns."""
    d, b, text = F.col("doc_id"), F.col("block"), F.col("text")
    bare = F.regexp_replace(text, "[^\\x20-\\xFF]", "?")
    quoted = lambda c: F.concat(F.lit("("), F.regexp_replace(c, r"([\\()])", r"\\$1"), F.lit(")"))
    half = (F.length(bare) / 2).cast("int")
    whole = quoted(bare)
    kinds = [
        F.format_string("1 0 0 1 %d %d Tm %s Tj", 72 + b, 700 - b, whole),
        F.format_string("T* %s Tj", whole),
        F.format_string("%s '", whole),
        F.format_string("2 -%d TD %s Tj", 12 + b % 3, whole),
        F.format_string("[%s -250 %s] TJ", quoted(F.substr(bare, F.lit(1), half)), quoted(F.substr(bare, half + 1))),
        F.format_string('0 0 %s "', whole),
        F.format_string("/F1 %d Tf -3 -10 Td <%s> Tj", 9 + b % 5, F.hex(F.encode(bare, "ISO-8859-1"))),
        F.format_string("ET q BI /W 1 ID (Tj) EI Q BT 16 TL %s '", whole),
    ]
    line = F.concat(F.when(b == 0, F.format_string("BT /F1 %d Tf 14 TL ", 10 + d % 4)).otherwise(""), F.element_at(F.array(*kinds), (b % 8 + 1).cast("int")))
    lines = paragraphs(spark, sf_dir).select("doc_id", "block", line.alias("line"))
    ordered = F.transform(F.array_sort(F.collect_list(F.struct("block", "line"))), lambda r: r["line"])
    return lines.groupBy("doc_id").agg(F.encode(F.array_join(ordered, "\n"), "ISO-8859-1").alias("content"))


_WALK = f"""{PARAGRAPH}, t AS (SELECT doc_id, block AS b, regexp_replace(text, '[^\\x20-\\x{{FF}}]', '?', 'g') AS text, block % 8 AS k FROM paragraph),
u AS (SELECT *, length(text) AS n, length(text) * 0.5 - 0.2 * (length(text) - length(replace(text, ' ', ''))) + CASE WHEN k = 4 THEN 0.25 ELSE 0 END AS em FROM t),
walk AS (
  SELECT doc_id, b, text, n, k, 72.0::DOUBLE AS lx, 700.0::DOUBLE AS ly, 72.0::DOUBLE AS x, (10 + doc_id % 4)::DOUBLE AS size, 14.0::DOUBLE AS gap, em::DOUBLE AS em FROM u WHERE b = 0
  UNION ALL
  SELECT doc_id, b, text, n, k, lx, ly, CASE WHEN k = 4 THEN x ELSE lx END, size, gap, em FROM (
    SELECT u.doc_id, u.b, u.text, u.n, u.k, u.em::DOUBLE AS em,
           (CASE u.k WHEN 0 THEN 72 + u.b WHEN 3 THEN w.lx + 2 WHEN 6 THEN w.lx - 3 WHEN 7 THEN 0 ELSE w.lx END)::DOUBLE AS lx,
           (CASE u.k WHEN 0 THEN 700 - u.b WHEN 3 THEN w.ly - 12 - u.b % 3 WHEN 4 THEN w.ly WHEN 6 THEN w.ly - 10 WHEN 7 THEN -16 ELSE w.ly - w.gap END)::DOUBLE AS ly,
           w.x + w.em * w.size AS x, (CASE u.k WHEN 6 THEN 9 + u.b % 5 ELSE w.size END)::DOUBLE AS size,
           (CASE u.k WHEN 3 THEN 12 + u.b % 3 WHEN 7 THEN 16 ELSE w.gap END)::DOUBLE AS gap
    FROM walk w JOIN u ON u.doc_id = w.doc_id AND u.b = w.b + 1))"""


@query(f"WITH RECURSIVE {_WALK} SELECT doc_id, round(x, 4) AS x, round(ly, 4) AS y, size, round(x + em * size, 4) AS x_end, text FROM walk WHERE text <> ''")
def pdf_shows(spark: SparkSession, sf_dir: str) -> DataFrame:
    shows = placed_shows(text_operations(_streams(spark, sf_dir), ["doc_id"]), ["doc_id"])
    return shows.select("doc_id", F.round("x", 4).alias("x"), F.round("y", 4).alias("y"), "size", F.round(F.col("x") + F.col("advance") * F.col("size"), 4).alias("x_end"), "text")
