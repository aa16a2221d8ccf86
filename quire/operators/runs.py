"""Styled runs: formats of whole paragraphs, of character ranges and of cells, and what an editor reads of them.

A run row holds its start in the paragraph's text and its own attributes. Interning equal attributes to pool entries
is a step of its own (style.intern); an edit is a rewrite of rows, so any number of documents is edited at once.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quire.operators.grid import overlaps
from quire.plans.registry import query
from quire.sources.adapters import CELL, PARAGRAPH, cells, paragraphs, table

ATTRIBUTES = ("height", "bold", "italic", "color", "font")
#: The default attributes; a colour equal to the default counts as none.
DEFAULT = {"height": 1000, "bold": False, "italic": False, "color": "#000000", "font": None}
TYPES = {"height": "bigint", "bold": "boolean", "italic": "boolean", "color": "string", "font": "string"}
#: Alignments as an editor names them; all others are justified.
ALIGNMENTS = ("left", "right", "center")


def runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Paragraphs as runs of twenty characters; an empty paragraph has one empty run."""
    p = paragraphs(spark, sf_dir)
    k = F.explode(F.sequence(F.lit(0), F.greatest(F.lit(1), F.ceil(F.length("text") / 20)).cast("int") - 1)).alias("k")
    own = p.select("doc_id", "block", "node_id", "simple", F.col("text").alias("whole"), k).withColumn("k", F.col("k").cast("long"))
    return own.select(
        "doc_id",
        "block",
        "node_id",
        "simple",
        F.col("k").alias("run"),
        (F.col("k") * 20).alias("start"),
        F.substring("whole", F.col("k").cast("int") * 20 + 1, F.lit(20)).alias("text"),
        (F.lit(1000) + (F.col("doc_id") + F.col("block") + F.col("k")) % 3 * 200).cast("long").alias("height"),
        ((F.col("doc_id") + F.col("k")) % 2 == 0).alias("bold"),
        ((F.col("block") + F.col("k")) % 3 == 0).alias("italic"),
        F.when((F.col("doc_id") + F.col("block")) % 4 == 0, "#FF0000").otherwise("#000000").alias("color"),
        F.when(F.col("doc_id") % 3 == 0, "Batang").alias("font"),
    )


RUN = (
    PARAGRAPH
    + """, run AS (
  SELECT doc_id, block, node_id, simple, k AS run, k * 20 AS start, substring(whole, k * 20 + 1, 20) AS text, 1000 + (doc_id + block + k) % 3 * 200 AS height, (doc_id + k) % 2 = 0 AS bold, (block + k) % 3 = 0 AS italic,
         CASE WHEN (doc_id + block) % 4 = 0 THEN '#FF0000' ELSE '#000000' END AS color, CASE WHEN doc_id % 3 = 0 THEN 'Batang' END AS font
  FROM (SELECT doc_id, block, node_id, simple, text AS whole, unnest(range(greatest(1, (length(text) + 19) // 20))) AS k FROM paragraph))"""
)
#: The run's pieces before, in and behind the characters from 5 up to 30.
PIECE = (
    RUN
    + """, piece AS (SELECT * EXCLUDE (q), q.a AS a, q.b AS b, q.a >= 5 AND q.b <= 30 AND q.a < q.b AS hit FROM (
  SELECT *, unnest(CASE WHEN length(text) = 0 THEN [{'a': start, 'b': start}] ELSE list_filter([{'a': start, 'b': least(greatest(5, start), start + length(text))}, {'a': least(greatest(5, start), start + length(text)), 'b': least(greatest(30, start), start + length(text))},
    {'a': least(greatest(30, start), start + length(text)), 'b': start + length(text)}], lambda x: x.a < x.b) END) AS q FROM run))"""
)
_SHOWN = ["doc_id", "block", "start", "text", *ATTRIBUTES]


def patch(rows: DataFrame, hit: Column, **changes: object) -> DataFrame:
    """rows whose attributes are changed where hit holds. An empty font clears the family."""
    if not changes:
        raise ValueError("no attribute is given")
    if "height" in changes and not changes["height"] > 0:
        raise ValueError("a size must be positive")
    for name, value in changes.items():
        rows = rows.withColumn(name, F.when(hit, F.lit(None if name == "font" and value == "" else value).cast(TYPES.get(name, "string"))).otherwise(F.col(name)))
    return rows


def set_range_shape(rows: DataFrame, first: int, last: int, shape: dict) -> DataFrame:
    """All runs of the paragraphs with node ids from first to last take a whole shape; status says so for each document.

    One structural paragraph among them refuses a document's edit (structural), as does a range without any (no_paragraph).
    """
    inside = F.col("node_id").between(first, last)
    edits = rows.groupBy("doc_id").agg(F.when(F.count_if(inside) == 0, "no_paragraph").when(F.count_if(inside & ~F.col("simple")) > 0, "structural").otherwise("ok").alias("status"))
    return patch(rows.join(edits, "doc_id"), inside & (F.col("status") == "ok"), **(DEFAULT | shape))


def split_runs(rows: DataFrame, start: int, end: int) -> DataFrame:
    """Runs split at two character offsets, with hit for pieces between them; offsets past the text are its end."""
    if start > end:
        raise ValueError(f"start {start} lies behind end {end}")
    s, e = F.col("start"), F.col("start") + F.length("text")
    p, q = (F.least(F.greatest(F.lit(x).cast("long"), s), e) for x in (start, end))
    piece = lambda a, b: F.struct(a.cast("long").alias("a"), b.cast("long").alias("b"))
    pieces = F.when(s == e, F.array(piece(s, e))).otherwise(F.filter(F.array(piece(s, p), piece(p, q), piece(q, e)), lambda x: x["a"] < x["b"]))
    cut = rows.withColumn("_piece", F.explode(pieces))
    inside = (F.col("_piece.a") >= start) & (F.col("_piece.b") <= end) & (F.col("_piece.a") < F.col("_piece.b"))
    text = F.substring("text", (F.col("_piece.a") - F.col("start") + 1).cast("int"), (F.col("_piece.b") - F.col("_piece.a")).cast("int"))
    return cut.withColumn("text", text).withColumn("hit", inside).withColumn("start", F.col("_piece.a")).drop("_piece")


def set_range_runs(rows: DataFrame, block: int, specs: list[dict]) -> DataFrame:
    """The simple paragraphs at a block hold the given runs; an unstyled one keeps the first run's shape, its colour reset."""
    target = F.col("simple") & (F.col("block") == block)
    first = rows.where(target).groupBy("doc_id", "block", "node_id", "simple").agg(F.min_by(F.struct(*ATTRIBUTES), "run").alias("old"))
    out, start = rows.where(~target), 0
    for k, spec in enumerate(specs or [{"text": ""}]):
        plain = not (spec.keys() - {"text"})
        own = {a: (F.lit(DEFAULT["color"]) if a == "color" else F.col(f"old.{a}")) if plain else F.lit((DEFAULT | spec)[a]).cast(TYPES[a]) for a in ATTRIBUTES}
        out = out.unionByName(first.select("doc_id", "block", "node_id", "simple", F.lit(k).cast("long").alias("run"), F.lit(start).cast("long").alias("start"), F.lit(spec["text"]).alias("text"), *[c.alias(a) for a, c in own.items()]))
        start += len(spec["text"])
    return out


def append_rich(rows: DataFrame, specs: list[dict]) -> DataFrame:
    """A paragraph of given runs behind each document's last."""
    last = rows.groupBy("doc_id").agg((F.max("block") + 1).alias("block"), (F.max("node_id") + 1).alias("node_id"))
    start = 0
    out = rows
    for k, spec in enumerate(specs):
        shape = DEFAULT | spec
        out = out.unionByName(last.select("doc_id", "block", "node_id", F.lit(True).alias("simple"), F.lit(k).cast("long").alias("run"), F.lit(start).cast("long").alias("start"), F.lit(spec["text"]).alias("text"), *[F.lit(shape[a]).cast(TYPES[a]).alias(a) for a in ATTRIBUTES]))
        start += len(spec["text"])
    return out


def first_format(rows: DataFrame) -> DataFrame:
    """Each paragraph's format, its first run's: ten points where it has no size, no colour where it is the default."""
    own = rows.groupBy("doc_id", "block").agg(F.min_by(F.struct(*ATTRIBUTES), "run").alias("f"))
    size = F.when(F.col("f.height") > 0, F.col("f.height") / 100.0).otherwise(10.0)
    return own.select("doc_id", "block", "f.bold", "f.italic", size.alias("size_pt"), "f.font", F.when(F.col("f.color") != DEFAULT["color"], F.col("f.color")).alias("color"))


def joined_runs(rows: DataFrame) -> DataFrame:
    """All runs of a document as one cell's, with a run of a line break between paragraphs, numbered in order."""
    each = rows.select("doc_id", "block").distinct().withColumn("n", F.min("block").over(Window.partitionBy("doc_id"))).where("block > n")
    breaks = each.select("doc_id", "block", F.lit(-1).cast("long").alias("run"), F.lit("\n").alias("text"))
    both = rows.select("doc_id", "block", "run", "text").unionByName(breaks)
    return both.select("doc_id", F.row_number().over(Window.partitionBy("doc_id").orderBy("block", "run")).cast("long").alias("seq"), "text")


def paragraph_style(align: Column, left: Column, right: Column, indent: Column) -> dict[str, Column]:
    """What an editor shows: insets of 0 at least, the first line's indent no further left than the inset."""
    inset = F.greatest(left, F.lit(0))
    return {"align": F.when(align.isin(*ALIGNMENTS), align).otherwise("justify"), "indent_left": inset, "indent_right": F.greatest(right, F.lit(0)), "indent_first": F.greatest(indent, -inset)}


def formattable(simple: Column, kinds: Column) -> Column:
    """A paragraph can be formatted in place if it is simple and holds text alone."""
    return simple & F.forall(kinds, lambda k: k == "text")


def inherited_runs(text: Column, style: Column) -> Column:
    """Runs of a new text that take a style: one a line, with bare runs of a line break between."""
    lines = F.split(text, "\n")
    run = lambda t, s: F.struct(t.alias("text"), s.alias("style"))
    bare = F.lit(None).cast("boolean")
    return F.flatten(F.transform(lines, lambda t, i: F.when(i > 0, F.array(run(F.lit("\n"), bare), run(t, style))).otherwise(F.array(run(t, style)))))


def apply_style(rows: DataFrame, first: int, last: int, name: str) -> DataFrame:
    """Paragraphs with node ids from first to last, structural ones too, take a named style."""
    if not name.strip():
        raise ValueError("a style needs a name")
    return rows.withColumn("style_name", F.when(F.col("node_id").between(first, last), name.strip()).otherwise(F.col("style_name")))


def set_row_heights(rows: DataFrame, heights: list[int]) -> DataFrame:
    """Rows (doc_id, row, height) with new heights where their number fits and none is negative; status says so."""
    ok = (F.count("*").over(Window.partitionBy("doc_id")) == len(heights)) & F.lit(all(h >= 0 for h in heights))
    new = F.get(F.array(*[F.lit(int(h)).cast("long") for h in heights]), F.col("row").cast("int"))
    return rows.withColumn("status", F.when(ok, "ok").otherwise("bad_heights")).withColumn("height", F.when(F.col("status") == "ok", new).otherwise(F.col("height")))


@query(f"WITH {RUN}, s AS (SELECT doc_id, CASE max(CASE WHEN node_id BETWEEN 3 AND 6 THEN CASE WHEN simple THEN 1 ELSE 2 END ELSE 0 END) WHEN 0 THEN 'no_paragraph' WHEN 1 THEN 'ok' ELSE 'structural' END AS status FROM run GROUP BY doc_id), h AS (SELECT *, status = 'ok' AND node_id BETWEEN 3 AND 6 AS hit FROM run JOIN s USING (doc_id)) SELECT doc_id, status, block, start, text, CASE WHEN hit THEN 1400 ELSE height END AS height, hit OR bold AS bold, NOT hit AND italic AS italic, CASE WHEN hit THEN '#000000' ELSE color END AS color, CASE WHEN NOT hit THEN font END AS font FROM h")
def set_char_pr(spark: SparkSession, sf_dir: str) -> DataFrame:
    return set_range_shape(runs(spark, sf_dir), 3, 6, {"height": 1400, "bold": True}).select(*_SHOWN, "status")


@query(f"WITH {PIECE} SELECT doc_id, block, a AS start, substring(text, a - start + 1, b - a) AS text, CASE WHEN hit AND simple THEN 900 ELSE height END AS height, NOT (hit AND simple) AND bold AS bold, (hit AND simple) OR italic AS italic, CASE WHEN hit AND simple THEN '#0000FF' ELSE color END AS color, CASE WHEN NOT (hit AND simple) THEN font END AS font FROM piece")
def set_run_char_pr(spark: SparkSession, sf_dir: str) -> DataFrame:
    shape = DEFAULT | {"height": 900, "italic": True, "color": "#0000FF"}
    return patch(split_runs(runs(spark, sf_dir), 5, 30), F.col("hit") & F.col("simple"), **shape).select(*_SHOWN)


@query(f"WITH {PIECE} SELECT doc_id, block, a AS start, substring(text, a - start + 1, b - a) AS text, height, hit OR bold AS bold, italic, color, font FROM piece")
def set_run_char_fmt(spark: SparkSession, sf_dir: str) -> DataFrame:
    return patch(split_runs(runs(spark, sf_dir), 5, 30), F.col("hit"), bold=True).select(*_SHOWN)


@query(f"""WITH {RUN}, f AS (SELECT doc_id, block, arg_min({{'h': height, 'b': bold, 'i': italic, 'f': font}}, run) AS o FROM run WHERE simple AND block = 1 GROUP BY doc_id, block)
SELECT doc_id, block, start, text, height, bold, italic, color, font FROM run WHERE NOT (simple AND block = 1) UNION ALL
SELECT doc_id, block, 0, 'plain ', o.h, o.b, o.i, '#000000', o.f FROM f UNION ALL SELECT doc_id, block, 6, 'loud', 1000, true, false, '#00FF00', NULL FROM f""")
def set_paragraph_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return set_range_runs(runs(spark, sf_dir), 1, [{"text": "plain "}, {"text": "loud", "bold": True, "color": "#00FF00"}]).select(*_SHOWN)


@query(f"WITH {RUN}, l AS (SELECT doc_id, max(block) + 1 AS block FROM run GROUP BY doc_id) SELECT doc_id, block, start, text, height, bold, italic, color, font FROM run UNION ALL SELECT doc_id, block, 0, 'Title', 2000, true, false, '#000000', NULL FROM l UNION ALL SELECT doc_id, block, 5, ': end', 1000, false, false, '#000000', NULL FROM l")
def append_rich_paragraph(spark: SparkSession, sf_dir: str) -> DataFrame:
    return append_rich(runs(spark, sf_dir), [{"text": "Title", "height": 2000, "bold": True}, {"text": ": end"}]).select(*_SHOWN)


@query(f"WITH {RUN} SELECT doc_id, block, bold, italic, height / 100.0 AS size_pt, font, CASE WHEN color <> '#000000' THEN color END AS color FROM run WHERE run = 0")
def char_fmt(spark: SparkSession, sf_dir: str) -> DataFrame:
    return first_format(runs(spark, sf_dir))


@query(f"WITH {RUN}, b AS (SELECT doc_id, block, run, text FROM run UNION ALL SELECT DISTINCT doc_id, block, -1, chr(10) FROM run WHERE block > 0) SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY block, run) AS seq, text FROM b")
def block_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return joined_runs(runs(spark, sf_dir))


@query(f"WITH {PARAGRAPH}, p AS (SELECT *, (doc_id % 5 - 1) * 100 AS l, (block % 4 - 1) * 50 AS r, (block % 7 - 3) * 150 AS i, ['left', 'distribute', 'center', 'right', 'justify'][1 + block % 5] AS al FROM paragraph) SELECT doc_id, block, CASE WHEN al IN ('left', 'right', 'center') THEN al ELSE 'justify' END AS align, greatest(l, 0) AS indent_left, greatest(r, 0) AS indent_right, greatest(i, -greatest(l, 0)) AS indent_first FROM p")
def block_style(spark: SparkSession, sf_dir: str) -> DataFrame:
    align = F.get(F.array(*[F.lit(x) for x in ("left", "distribute", "center", "right", "justify")]), (F.col("block") % 5).cast("int"))
    found = paragraph_style(align, (F.col("doc_id") % 5 - 1) * 100, (F.col("block") % 4 - 1) * 50, (F.col("block") % 7 - 3) * 150)
    return paragraphs(spark, sf_dir).select("doc_id", "block", *[c.alias(k) for k, c in found.items()])


@query(f"WITH {PARAGRAPH} SELECT doc_id, block, simple AND NOT contains(text, '@') AS formattable FROM paragraph")
def formattable_paragraphs(spark: SparkSession, sf_dir: str) -> DataFrame:
    kinds = F.when(F.contains("text", F.lit("@")), F.array(F.lit("text"), F.lit("field"))).otherwise(F.array(F.lit("text")))
    return paragraphs(spark, sf_dir).select("doc_id", "block", formattable(F.col("simple"), kinds).alias("formattable"))


@query(f"WITH {PARAGRAPH} SELECT doc_id, node_id, CASE WHEN node_id BETWEEN 2 AND 4 THEN 'center' ELSE 'justify' END AS align, CASE WHEN node_id BETWEEN 3 AND 5 THEN 'Outline 1' END AS style_name FROM paragraph")
def set_para_pr_and_style(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = paragraphs(spark, sf_dir).select("doc_id", "node_id", F.lit("justify").alias("align"), F.lit(None).cast("string").alias("style_name"))
    return apply_style(patch(rows, F.col("node_id").between(2, 4), align="center"), 3, 5, " Outline 1 ")


@query(f"""WITH {CELL}, h AS (SELECT *, active AND row <= 3 AND row + row_span > 1 AND col <= 3 AND col + col_span > 2 AS hit FROM cell)
SELECT doc_id, row, col, CASE WHEN hit THEN 1200 ELSE 1000 END AS height, hit OR row = 0 AS bold, CASE WHEN hit THEN NULL ELSE 'Batang' END AS font, CASE WHEN hit THEN '#112233' ELSE '#000000' END AS color, CASE WHEN hit THEN 'right' ELSE 'justify' END AS align FROM h""")
def set_cell_range_fmt(spark: SparkSession, sf_dir: str) -> DataFrame:
    grid = cells(spark, sf_dir).select("*", F.lit(1000).cast("long").alias("height"), (F.col("row") == 0).alias("bold"), F.lit("Batang").alias("font"), F.lit("#000000").alias("color"), F.lit("justify").alias("align"))
    return patch(grid, F.col("active") & overlaps(1, 2, 3, 3), height=1200, bold=True, font="", color="#112233", align="right").select("doc_id", "row", "col", "height", "bold", "font", "color", "align")


@query(f"WITH {CELL}, r AS (SELECT DISTINCT doc_id, row FROM cell), c AS (SELECT *, count(*) OVER (PARTITION BY doc_id) = 3 AS ok FROM r) SELECT doc_id, row, CASE WHEN ok THEN [400, 0, 700][1 + row] ELSE 0 END AS height, CASE WHEN ok THEN 'ok' ELSE 'bad_heights' END AS status FROM c")
def set_table_row_heights(spark: SparkSession, sf_dir: str) -> DataFrame:
    return set_row_heights(cells(spark, sf_dir).select("doc_id", "row").distinct().withColumn("height", F.lit(0).cast("long")), [400, 0, 700])


@query("WITH t AS (SELECT p_partkey, p_size % 2 = 0 AS bold, [p_name, p_type, p_brand] AS l FROM part), u AS (SELECT p_partkey, bold, l, unnest(range(5)) AS i FROM t) SELECT p_partkey, i, CASE WHEN i % 2 = 1 THEN chr(10) ELSE l[i // 2 + 1] END AS text, CASE WHEN i % 2 = 0 THEN bold END AS bold FROM u")
def inherit_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = table(spark, sf_dir, "part").select("p_partkey", F.posexplode(inherited_runs(F.concat_ws("\n", "p_name", "p_type", "p_brand"), F.col("p_size") % 2 == 0)).alias("i", "run"))
    return found.select("p_partkey", F.col("i").cast("long").alias("i"), "run.text", F.col("run.style").alias("bold"))
