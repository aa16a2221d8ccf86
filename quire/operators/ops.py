"""Edit operations over normalised tables, and replay of an operation log with atomic batches, undo and redo.

Set-shaped operations (shades, widths, formats, new blocks and rows) are rewrites of whole tables. A log whose
operations depend on each other's results is replayed document by document.
"""

from __future__ import annotations

import json

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quire.functions import text as X
from quire.operators.grid import overlaps
from quire.plans.registry import query
from quire.sources.adapters import CELL, PARAGRAPH, cells, paragraphs, table

#: Operations that are declared but that the model does not apply.
NOT_IMPLEMENTED = ("InsertSectionBreak", "InsertTable", "InsertImage", "TableInsertRow", "TableInsertCol", "MergeCells")
#: A4 in 1/7200 inch.
A4 = (59528, 84188)


def set_shade(grid: DataFrame, colour: str | None, *, row: int | None = None, col: int | None = None, rect: tuple[int, int, int, int] | None = None) -> DataFrame:
    """Cells that a row, a column, a cell or a rectangle (first row, first column, last row, last column) meets take a shade."""
    high = 1 << 30
    a, b, c, d = rect or (0 if row is None else row, 0 if col is None else col, high if row is None else row, high if col is None else col)
    return grid.withColumn("shade", F.when(F.col("active") & overlaps(a, b, c, d), F.lit(colour)).otherwise(F.col("shade")))


def set_cell(grid: DataFrame, row: int, col: int, text: str) -> DataFrame:
    return grid.withColumn("text", F.when((F.col("row") == row) & (F.col("col") == col) & F.col("active"), X.sanitize(F.lit(text))).otherwise(F.col("text")))


def append_row(grid: DataFrame) -> DataFrame:
    """An empty row below the last, shaped as the last row's active cells, with single cells where spans leave columns open."""
    last = Window.partitionBy("doc_id")
    own = grid.withColumn("_last", F.max("row").over(last)).withColumn("_cols", F.max(F.col("col") + F.col("col_span")).over(last))
    template = own.where("active and row = _last")
    covered = template.groupBy("doc_id", "_last", "_cols").agg(F.flatten(F.collect_list(F.sequence(F.col("col"), F.col("col") + F.col("col_span") - 1))).alias("c"))
    open_ = covered.select("doc_id", "_last", F.explode(F.array_except(F.sequence(F.lit(0).cast("long"), F.col("_cols") - 1), "c")).alias("col"), F.lit(1).cast("long").alias("col_span"))
    fresh = template.select("doc_id", "_last", "col", "col_span").unionByName(open_)
    fresh = fresh.select("doc_id", (F.col("_last") + 1).alias("row"), "col", F.lit(1).cast("long").alias("row_span"), "col_span", F.lit(True).alias("active"), F.lit(None).cast("string").alias("shade"), F.lit("").alias("text"))
    return grid.unionByName(fresh)


def set_widths(columns: DataFrame, widths: list[float]) -> DataFrame:
    """Columns with new widths where their number fits and all are positive; status says so."""
    n = F.count("*").over(Window.partitionBy("doc_id"))
    ok = (n == len(widths)) & F.lit(all(w > 0 for w in widths))
    new = F.get(F.array(*[F.lit(float(w)) for w in widths]), F.col("col").cast("int"))
    return columns.withColumn("status", F.when(ok, "ok").otherwise("bad_widths")).withColumn("width", F.when(F.col("status") == "ok", new).otherwise(F.col("width")))


def pad_rows(rows: DataFrame) -> DataFrame:
    """Ragged rows of texts (doc_id, row, texts) as cells: missing texts are empty; the first row is bold."""
    cols = F.max(F.size("texts")).over(Window.partitionBy("doc_id"))
    wide = rows.withColumn("_cols", cols).select("doc_id", "row", "texts", F.explode(F.sequence(F.lit(0), F.col("_cols") - 1)).alias("col"))
    return wide.select("doc_id", "row", F.col("col").cast("long").alias("col"), F.coalesce(F.get("texts", F.col("col")), F.lit("")).alias("text"), (F.col("row") == 0).alias("bold"))


def page_layout(landscape: Column, margins_mm: Column) -> dict[str, Column]:
    """Width, height and margins of an A4 page in units."""
    w, h = F.lit(A4[0]), F.lit(A4[1])
    return {"width": F.when(landscape, h).otherwise(w), "height": F.when(landscape, w).otherwise(h), "margin": X.mm_to_units(margins_mm)}


def patch_format(shapes: DataFrame, **changes: object) -> DataFrame:
    """Each distinct shape patched once: given attributes replace the shape's; a size must be positive.

    An empty font clears the family and the per-script fonts.
    """
    if "height" in changes and not (isinstance(changes["height"], (int, float)) and changes["height"] > 0):
        raise ValueError("a size must be positive")
    out = shapes
    for name, value in changes.items():
        if name == "font" and value == "":
            out = out.withColumn("font", F.lit(None).cast("string"))
            out = out.withColumn("script_fonts", F.lit(None).cast(shapes.schema["script_fonts"].dataType)) if "script_fonts" in shapes.columns else out
        else:
            out = out.withColumn(name, F.lit(value).cast(shapes.schema[name].dataType))
    return out


def _apply(blocks: list[str], op: str, args: dict) -> list[str]:
    """The blocks after one operation; an error says why it cannot be made."""
    if op in NOT_IMPLEMENTED:
        raise ValueError("not_implemented")
    at = int(args.get("index", len(blocks)) if args.get("index") is not None else len(blocks))
    room = len(blocks) if op in ("InsertParagraphAt", "AppendParagraph") else len(blocks) - 1
    if not 0 <= at <= room and op != "MoveBlock":
        raise ValueError("out_of_range")
    if op in ("InsertParagraphAt", "AppendParagraph"):
        return [*blocks[:at], args.get("text", ""), *blocks[at:]]
    if op == "DeleteBlock":
        return blocks[:at] + blocks[at + 1 :]
    if op == "SetParagraphText":
        return [*blocks[:at], args.get("text", ""), *blocks[at + 1 :]]
    if op == "InsertText":
        k, t = int(args["offset"]), blocks[at]
        if not 0 <= k <= len(t):
            raise ValueError("out_of_range")
        return [*blocks[:at], t[:k] + args.get("text", "") + t[k:], *blocks[at + 1 :]]
    if op == "DeleteRange":
        a, b, t = int(args["start"]), int(args["end"]), blocks[at]
        if not 0 <= a <= b <= len(t):
            raise ValueError("out_of_range")
        return [*blocks[:at], t[:a] + t[b:], *blocks[at + 1 :]]
    if op == "MoveBlock":
        a, b = int(args["from"]), int(args["to"])
        if not (0 <= a < len(blocks) and 0 <= b <= len(blocks)):
            raise ValueError("out_of_range")
        rest = blocks[:a] + blocks[a + 1 :]
        b -= b > a
        return [*rest[:b], blocks[a], *rest[b:]]
    raise ValueError("unknown_op")


def replay(paras: DataFrame, log: DataFrame, *, limit: int = 50) -> DataFrame:
    """(doc_id, block, text, revision) after a log of (doc_id, seq, batch, op, args as JSON).

    A batch is made as a whole or not at all; Undo and Redo move by batches. One document is replayed in one task.
    """

    def run(key: tuple, own: pa.Table, ops: pa.Table) -> pa.Table:
        blocks, undo, redo, revision = own.sort_by("block").column("text").to_pylist(), [], [], 0
        batches: dict = {}
        for batch, op, args in zip(*(ops.sort_by("seq").column(c).to_pylist() for c in ("batch", "op", "args")), strict=True):
            if batch is not None:
                batches.setdefault(batch, []).append((op, args))
        for ops_ in batches.values():
            kinds = [op for op, _ in ops_]
            if kinds in (["Undo"], ["Redo"]):
                source, target = (undo, redo) if kinds == ["Undo"] else (redo, undo)
                if source:
                    target.append(blocks)
                    blocks, revision = source.pop(), revision + 1
                continue
            before = blocks
            try:
                for op, args in ops_:
                    blocks = _apply(blocks, op, json.loads(args or "{}"))
            except (ValueError, KeyError):
                blocks = before
                continue
            undo, redo, revision = [*undo, before][-limit:], [], revision + 1
        n = len(blocks)
        # types are named, for a document may be left without a block
        return pa.table({"doc_id": pa.array([key[0].as_py()] * n, pa.int64()), "block": pa.array(range(n), pa.int64()), "text": pa.array(blocks, pa.string()), "revision": pa.array([revision] * n, pa.int64())})

    return paras.select("doc_id", "block", "text").groupBy("doc_id").cogroup(log.groupBy("doc_id")).applyInArrow(run, "doc_id long, block long, text string, revision long")


@query(f"WITH {CELL} SELECT doc_id, row, col, CASE WHEN active AND row <= 3 AND row + row_span > 2 AND col <= 4 AND col + col_span > 4 THEN '#FFFF00' ELSE shade END AS shade FROM cell")
def set_cell_shade(spark: SparkSession, sf_dir: str) -> DataFrame:
    return set_shade(cells(spark, sf_dir), "#FFFF00", rect=(2, 4, 3, 4)).select("doc_id", "row", "col", "shade")


@query(f"WITH {CELL} SELECT doc_id, row, col, CASE WHEN row = 1 AND col = 3 AND active THEN 'set' ELSE text END AS text FROM cell")
def set_table_cell(spark: SparkSession, sf_dir: str) -> DataFrame:
    return set_cell(cells(spark, sf_dir), 1, 3, "s\x02et").select("doc_id", "row", "col", "text")


@query(f"WITH {CELL}, l AS (SELECT *, max(row) OVER (PARTITION BY doc_id) AS last FROM cell) SELECT doc_id, row, col, col_span, text FROM cell UNION ALL SELECT doc_id, last + 1, col, col_span, '' FROM l WHERE active AND row = last")
def table_append_row(spark: SparkSession, sf_dir: str) -> DataFrame:
    return append_row(cells(spark, sf_dir)).select("doc_id", "row", "col", "col_span", "text")


@query("WITH r AS (SELECT user_id AS doc_id, event_id AS row, [event_type, props][1:(event_id % 3)::INT] AS t FROM events), c AS (SELECT doc_id, max(len(t)) AS cols FROM r GROUP BY doc_id) SELECT doc_id, row, k AS col, coalesce(t[k + 1], '') AS text, row = 0 AS bold FROM (SELECT r.doc_id, row, t, unnest(range(cols)) AS k FROM r JOIN c USING (doc_id))")
def append_table_padding(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "events").select(F.col("user_id").alias("doc_id"), F.col("event_id").alias("row"), F.slice(F.array("event_type", "props"), F.lit(1), (F.col("event_id") % 3).cast("int")).alias("texts"))
    return pad_rows(rows)


@query("SELECT p_partkey, CASE WHEN p_size % 2 = 0 THEN 84188 ELSE 59528 END AS width, CASE WHEN p_size % 2 = 0 THEN 59528 ELSE 84188 END AS height, round(p_size * 7200 / 25.4)::BIGINT AS margin FROM part")
def page_layouts(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = page_layout(F.col("p_size") % 2 == 0, F.col("p_size").cast("double"))
    return table(spark, sf_dir, "part").select("p_partkey", *[c.alias(k) for k, c in found.items()])


@query("SELECT DISTINCT p_brand, p_type, p_size::BIGINT AS old_size, 12::BIGINT AS height, NULL::VARCHAR AS font FROM part")
def set_char_fmt(spark: SparkSession, sf_dir: str) -> DataFrame:
    shapes = table(spark, sf_dir, "part").selectExpr("p_brand", "p_type", "cast(p_size as long) as old_size", "cast(p_size as long) as height", "p_name as font").dropDuplicates(["p_brand", "p_type", "old_size"])
    return patch_format(shapes, height=12, font="")


@query()
def op_log_replay(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events")
    op = F.when(F.col("event_type") == "view", "InsertParagraphAt").when(F.col("event_type") == "click", "DeleteBlock").when(F.col("event_type") == "error", "MoveBlock").when(F.col("event_type") == "signup", "Undo").otherwise("SetParagraphText")
    args = F.format_string('{"index":%d,"from":%d,"to":%d,"text":"t%d"}', F.col("event_id") % 9, F.col("event_id") % 5, F.col("event_id") % 7, F.col("event_id"))
    batch = F.when(op == "Undo", F.col("event_id") * 2 + 1).otherwise(F.floor(F.col("event_id") / 300) * 600)
    return replay(paragraphs(spark, sf_dir), e.select(F.col("user_id").alias("doc_id"), F.col("event_id").alias("seq"), batch.alias("batch"), op.alias("op"), args.alias("args")))


@query(f"WITH {PARAGRAPH} SELECT doc_id, block, row_number() OVER (PARTITION BY doc_id ORDER BY block) || '. ' || text AS item FROM paragraph WHERE simple AND text <> ''")
def ordered_list_numbers(spark: SparkSession, sf_dir: str) -> DataFrame:
    order = Window.partitionBy("doc_id").orderBy("block")
    return paragraphs(spark, sf_dir).where("simple and text <> ''").select("doc_id", "block", F.concat(F.row_number().over(order).cast("string"), F.lit(". "), "text").alias("item"))
