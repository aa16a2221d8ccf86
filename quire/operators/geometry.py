"""Geometry of lines, columns and matches, and lookups of placed and referenced things."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quire.plans.registry import query
from quire.sources.adapters import PARAGRAPH, paragraphs, table

#: The line advance where a paragraph names none, and pixels in a millimetre.
LINE_SPACING, PX_PER_MM = 1.6, 96 / 25.4


def spacing_ratio(kind: Column, value: Column) -> Column:
    """A line's advance as a multiple of its glyphs' size: from a percentage over 0 alone."""
    return F.when((kind == "percent") & (value > 0), value / 100.0).otherwise(LINE_SPACING)


def indents(left: Column, right: Column, indent: Column, width: Column) -> dict[str, Column]:
    """Insets of 0 at least; the first line starts no further left than the block; at least 1 is left to wrap in."""
    inset = F.greatest(left, F.lit(0))
    return {"left": inset, "first_extra": F.greatest(indent, -inset), "wrap": F.greatest(width - inset - F.greatest(right, F.lit(0)), F.lit(1))}


def line_origin(margin: Column, inset: dict[str, Column], line: Column, line_width: Column, align: Column) -> Column:
    """Where a line starts: half or all of the slack before it if it is centred or flush right."""
    first = line == 0
    slack = F.greatest(inset["wrap"] - F.when(first, F.greatest(inset["first_extra"], F.lit(0))).otherwise(0) - line_width, F.lit(0.0))
    return margin + inset["left"] + F.when(first, inset["first_extra"]).otherwise(0) + F.when(align == "right", slack).when(align == "center", slack / 2).otherwise(0.0)


def paragraph_heights(lines: DataFrame, by: list[str], ratio: Column) -> DataFrame:
    """Heights of paragraphs of lines (…, line, size): the last line's leading is left out."""
    own = lines.groupBy(*by).agg(F.sum("size").alias("_sum"), F.max_by("size", "line").alias("_last"))
    return own.select(*by, (F.col("_sum") * ratio - F.greatest(F.col("_last") * (ratio - 1), F.lit(0.0))).alias("height"))


def clamped(x: Column, low: Column, high: Column) -> Column:
    return F.greatest(low, F.least(high, x))


def moved_boundary(edges: Column, i: Column, x: Column, least: float = 8.0) -> Column:
    """Column edges with the inner edge i at x, both columns beside it at least so wide; an outer edge stays."""
    place = clamped(x, F.get(edges, i - 1) + least, F.get(edges, i + 1) - least)
    return F.when((i <= 0) | (i >= F.size(edges) - 1), edges).otherwise(F.transform(edges, lambda e, k: F.when(k == i, place).otherwise(e)))


def column_of_width(edges: Column, col: Column, mm: Column, least: float = 8.0) -> Column:
    """Edges with a column's width set, taken from its right neighbour, or from the left one for the last column."""
    n, wide = F.size(edges) - 1, F.greatest(F.lit(least), F.greatest(mm, F.lit(0.0)) * PX_PER_MM)
    moved = F.when(col < n - 1, moved_boundary(edges, col + 1, F.get(edges, col) + wide, least)).otherwise(moved_boundary(edges, col, F.get(edges, col + 1) - wide, least))
    return F.when((n < 2) | (col < 0) | (col >= n), edges).otherwise(moved)


def equal_columns(edges: Column, first: Column, last: Column) -> Column:
    """Edges with the columns from first to last of equal widths."""
    low, high = F.get(edges, first), F.get(edges, last + 1)
    even = F.transform(edges, lambda e, k: F.when((k > first) & (k <= last), low + (high - low) * (k - first) / (last - first + 1)).otherwise(e))
    return F.when((first < 0) | (last >= F.size(edges) - 1) | (last <= first), edges).otherwise(even)


def text_anchor(node: Column, offset: Column, length: Column) -> Column:
    """The caret's offset in a hit paragraph, within it; null where the hit has no editable text."""
    inside = F.when(F.isnan(offset) | (offset <= 0), 0).when(offset >= length, length).otherwise(F.floor(offset))
    return F.when(node.isNotNull(), inside.cast("long"))


def caret_gap(hit: Column, node: Column) -> Column:
    """Whether something was hit that has no editable text; nothing hit is no gap."""
    return hit & node.isNull()


def clicked(cell: Column, table_: Column, block: Column) -> dict[str, Column]:
    """What a click selects: a cell before its table before any block. Each is an id, or null where nothing was hit."""
    return {"kind": F.when(cell.isNotNull(), "cell").when(table_.isNotNull(), "table").when(block.isNotNull(), "block"), "picked": F.coalesce(cell, table_, block)}


def marquee(hits: DataFrame) -> DataFrame:
    """Blocks (section, block, kind, page) that a rectangle meets, once each on their first page; images cannot be picked."""
    return hits.where("kind <> 'image'").groupBy("section", "block").agg(F.min("page").alias("page"), F.min_by("kind", "page").alias("kind"))


def bound(refs: DataFrame, manifest: DataFrame, parts: DataFrame) -> DataFrame:
    """(doc_id, ref, part): distinct references, through the manifest (ref, part_id), to parts (part_id, part); unresolved ones are skipped."""
    return refs.select("doc_id", "ref").distinct().join(manifest, "ref").join(parts, "part_id").select("doc_id", "ref", "part")


def match_pages(matches: DataFrame, placed: DataFrame) -> DataFrame:
    """matches (doc_id, seq, node) with the page of each and what else placed has of the node there.

    placed: doc_id, node, page and, if wanted, a box; a node may stand on several pages. A match is on its node's first
    page that is not before the page of the last match that has one. Where no page is left it has none, and those that
    follow go on from where they were. The walk holds one page number; its rows stream through a task in order.
    """
    kinds = {c: matches.schema[c].dataType.simpleString() for c in ("doc_id", "seq", "node")}

    def walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        doc, at = None, -1
        for b in batches:
            found = []
            for d, pages in zip(b.column(0).to_pylist(), b.column(3).to_pylist(), strict=True):
                if d != doc:
                    doc, at = d, -1
                page = next((p for p in pages or () if p >= at), None)
                at = at if page is None else page
                found.append(page)
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), b.column(2), pa.array(found, pa.int64())], names=["doc_id", "seq", "node", "page"])

    pages = placed.groupBy("doc_id", "node").agg(F.sort_array(F.collect_set(F.col("page").cast("long"))).alias("pages"))  # of one paragraph
    asked = matches.select("doc_id", "seq", "node").join(pages, ["doc_id", "node"], "left").select("doc_id", "seq", "node", "pages")
    walked = asked.repartition("doc_id").sortWithinPartitions("doc_id", "seq").mapInArrow(walk, ", ".join(f"{c} {t}" for c, t in kinds.items()) + ", page long")
    box = [c for c in placed.columns if c not in ("doc_id", "node", "page")]
    return walked.join(placed.withColumn("page", F.col("page").cast("long")).dropDuplicates(["doc_id", "node", "page"]), ["doc_id", "node", "page"], "left").select("doc_id", "seq", "node", "page", *box)


def first_pages(placed: DataFrame, by: list[str]) -> DataFrame:
    return placed.groupBy(*by).agg(F.min("page").alias("page"))


def document_digest(paras: DataFrame) -> DataFrame:
    """(doc_id, digest): equal for documents of equal paragraphs in equal order, however they are split over rows' order."""
    parts = F.transform(F.array_sort(F.collect_list(F.struct("block", "text"))), lambda p: F.concat(F.length(p["text"]).cast("string"), F.lit(":"), p["text"]))
    return paras.groupBy("doc_id").agg(F.sha2(F.concat_ws("", parts).cast("binary"), 256).alias("digest"))


def document_sizes(paras: DataFrame) -> DataFrame:
    """Bytes of text and paragraphs of each document."""
    return paras.groupBy("doc_id").agg(F.sum(F.octet_length("text")).cast("long").alias("bytes"), F.count("*").alias("paragraphs"))


_SHAPE = "(p_size % 7 - 2) * 100 AS l, (p_size % 5 - 1) * 60 AS r, (p_size % 11 - 5) * 150 AS i, p_partkey % 3 AS line, ['left', 'right', 'center', 'justify'][1 + p_partkey % 4] AS al, floor(p_retailprice) AS lw"


@query(f"""WITH s AS (SELECT p_partkey, {_SHAPE} FROM part), t AS (SELECT *, greatest(l, 0) AS inset, greatest(i, -greatest(l, 0)) AS extra, greatest(2000 - greatest(l, 0) - greatest(r, 0), 1) AS wrap FROM s),
u AS (SELECT *, greatest(wrap - CASE WHEN line = 0 THEN greatest(extra, 0) ELSE 0 END - lw, 0) AS slack FROM t)
SELECT p_partkey, inset::BIGINT AS inset, extra::BIGINT AS first_extra, wrap::BIGINT AS wrap, (500 + inset + CASE WHEN line = 0 THEN extra ELSE 0 END + CASE al WHEN 'right' THEN slack WHEN 'center' THEN slack / 2 ELSE 0 END)::DOUBLE AS x FROM u""")
def line_origins(spark: SparkSession, sf_dir: str) -> DataFrame:
    size, key = F.col("p_size").cast("long"), F.col("p_partkey").cast("long")
    inset = indents((size % 7 - 2) * 100, (size % 5 - 1) * 60, (size % 11 - 5) * 150, F.lit(2000).cast("long"))
    align = F.get(F.array(*map(F.lit, ("left", "right", "center", "justify"))), (key % 4).cast("int"))
    x = line_origin(F.lit(500), inset, key % 3, F.floor("p_retailprice"), align)
    return table(spark, sf_dir, "part").select("p_partkey", inset["left"].alias("inset"), inset["first_extra"].alias("first_extra"), inset["wrap"].alias("wrap"), x.cast("double").alias("x"))


@query("SELECT l_orderkey, sum(l_quantity)::DOUBLE * 1.5 - arg_max(l_quantity, l_shipdate::VARCHAR || lpad(l_quantity::BIGINT::VARCHAR, 9, '0'))::DOUBLE * 0.5 AS height FROM lineitem GROUP BY l_orderkey")
def cell_paragraph_heights(spark: SparkSession, sf_dir: str) -> DataFrame:
    line = F.concat(F.col("l_shipdate").cast("string"), F.lpad(F.col("l_quantity").cast("long").cast("string"), 9, "0"))
    rows = table(spark, sf_dir, "lineitem").select("l_orderkey", line.alias("line"), F.col("l_quantity").cast("double").alias("size"))
    return paragraph_heights(rows, ["l_orderkey"], spacing_ratio(F.lit("percent"), F.lit(150)))


@query("SELECT p_partkey, CASE WHEN p_size % 3 = 0 AND p_size > 20 THEN (p_size - 20) / 100.0 ELSE 1.6 END::DOUBLE AS ratio FROM part")
def line_spacing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "part").select("p_partkey", spacing_ratio(F.when(F.col("p_size") % 3 == 0, "percent").otherwise("fixed"), F.col("p_size") - 20).alias("ratio"))


_EDGES = "[0.0, 4.0 * p_size, 4.0 * p_size + 60, 4.0 * p_size + 100, 4.0 * p_size + 140]"


@query(f"""WITH e AS (SELECT p_partkey, p_size, {_EDGES} AS e, p_partkey % 6 AS i FROM part)
SELECT p_partkey, k, CASE WHEN i BETWEEN 1 AND 3 AND k = i THEN greatest(e[i] + 8, least(e[i + 2] - 8, 90)) ELSE e[k + 1] END::DOUBLE AS moved, CASE WHEN k IN (2, 3) THEN e[2] + (e[5] - e[2]) * (k - 1) / 3 ELSE e[k + 1] END::DOUBLE AS even
FROM (SELECT *, unnest(range(5)) AS k FROM e)""")
def column_edits(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = F.col("p_size").cast("double") * 4
    edges = F.array(F.lit(0.0), s, s + 60, s + 100, s + 140)
    rows = table(spark, sf_dir, "part").select("p_partkey", moved_boundary(edges, (F.col("p_partkey") % 6).cast("int"), F.lit(90.0)).alias("m"), equal_columns(edges, F.lit(1), F.lit(3)).alias("e"))
    return rows.select("p_partkey", F.posexplode(F.arrays_zip("m", "e")).alias("k", "x")).select("p_partkey", F.col("k").cast("long").alias("k"), F.col("x.m").alias("moved"), F.col("x.e").alias("even"))


@query("SELECT event_id, CASE WHEN event_id % 5 > 0 AND event_id % 7 > 0 THEN CASE WHEN event_id % 40 - 4.5 <= 0 THEN 0 WHEN event_id % 40 - 4.5 >= 20 THEN 20 ELSE floor(event_id % 40 - 4.5) END END::BIGINT AS caret, event_id % 5 = 0 AND event_id % 7 > 0 AS gap FROM events")
def caret_anchors(spark: SparkSession, sf_dir: str) -> DataFrame:
    hit = F.col("event_id") % 7 > 0
    node = F.when(hit & (F.col("event_id") % 5 > 0), F.col("event_id"))
    return table(spark, sf_dir, "events").select("event_id", text_anchor(node, (F.col("event_id") % 40 - 4.5).cast("double"), F.lit(20)).alias("caret"), caret_gap(hit, node).alias("gap"))


@query("SELECT event_id, CASE WHEN event_id % 2 = 0 THEN 'cell' WHEN event_id % 3 = 0 THEN 'table' WHEN event_id % 5 = 0 THEN 'block' END AS kind, CASE WHEN event_id % 2 = 0 THEN user_id WHEN event_id % 3 = 0 OR event_id % 5 = 0 THEN event_id END AS picked FROM events")
def click_selection(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = F.col("event_id")
    found = clicked(F.when(e % 2 == 0, F.col("user_id")), F.when(e % 3 == 0, e), F.when(e % 5 == 0, e))
    return table(spark, sf_dir, "events").select("event_id", *[c.alias(k) for k, c in found.items()])


@query("WITH h AS (SELECT l_suppkey AS section, l_partkey AS block, CASE WHEN l_partkey % 4 = 0 THEN 'image' WHEN l_partkey % 4 = 1 THEN 'table' ELSE 'paragraph' END AS kind, l_orderkey AS page FROM lineitem) SELECT section, block, min(page) AS page, any_value(kind) AS kind FROM h WHERE kind <> 'image' GROUP BY section, block")
def marquee_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    kind = F.when(F.col("l_partkey") % 4 == 0, "image").when(F.col("l_partkey") % 4 == 1, "table").otherwise("paragraph")
    return marquee(table(spark, sf_dir, "lineitem").select(F.col("l_suppkey").alias("section"), F.col("l_partkey").alias("block"), kind.alias("kind"), F.col("l_orderkey").alias("page")))


@query("SELECT DISTINCT o_orderkey // 4 AS doc_id, o_custkey AS ref, n_name AS part FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey WHERE c_acctbal > 0")
def bound_images(spark: SparkSession, sf_dir: str) -> DataFrame:
    refs = table(spark, sf_dir, "orders").select(F.expr("o_orderkey div 4").alias("doc_id"), F.col("o_custkey").alias("ref"))
    manifest = table(spark, sf_dir, "customer").where("c_acctbal > 0").select(F.col("c_custkey").alias("ref"), F.col("c_nationkey").alias("part_id"))
    return bound(refs, manifest, table(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("part_id"), F.col("n_name").alias("part")))


@query(f"""WITH RECURSIVE {PARAGRAPH}, m AS (SELECT doc_id, block AS seq, CASE WHEN block % 10 < 9 THEN list_distinct([block * 7 % 13 + block // 9, block * 7 % 13 + block // 9 + 4]) ELSE [] END AS pages FROM paragraph),
walk AS (SELECT doc_id, -1::BIGINT AS seq, NULL::BIGINT AS page, 0::BIGINT AS at_ FROM (SELECT DISTINCT doc_id FROM m)
  UNION ALL SELECT w.doc_id, m.seq, list_min(list_filter(pages, lambda p: p >= at_)), coalesce(list_min(list_filter(pages, lambda p: p >= at_)), at_) FROM walk w JOIN m ON m.doc_id = w.doc_id AND m.seq = w.seq + 1)
SELECT doc_id, seq, page, page * 100 + seq % 100 AS y FROM walk WHERE seq >= 0""")
def located_matches(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = paragraphs(spark, sf_dir)
    page = F.col("block") * 7 % 13 + F.floor(F.col("block") / 9)
    placed = p.where("block % 10 < 9").select("doc_id", F.col("node_id").alias("node"), "block", F.explode(F.array(page, page + 4)).alias("page"))
    placed = placed.select("doc_id", "node", "page", (F.col("page") * 100 + F.col("block") % 100).alias("y"))
    return match_pages(p.select("doc_id", F.col("block").alias("seq"), F.col("node_id").alias("node")), placed).select("doc_id", "seq", "page", "y")


@query("SELECT l_suppkey AS section, l_partkey AS block, min(l_orderkey) AS page FROM lineitem GROUP BY ALL")
def table_first_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return first_pages(table(spark, sf_dir, "lineitem").select(F.col("l_suppkey").alias("section"), F.col("l_partkey").alias("block"), F.col("l_orderkey").alias("page")), ["section", "block"])


@query(f"WITH {PARAGRAPH} SELECT doc_id, sha256(string_agg(length(text) || ':' || text, '' ORDER BY block)) AS digest FROM paragraph GROUP BY doc_id")
def document_digests(spark: SparkSession, sf_dir: str) -> DataFrame:
    return document_digest(paragraphs(spark, sf_dir))


@query(f"WITH {PARAGRAPH} SELECT doc_id, sum(strlen(text))::BIGINT AS bytes, count(*) AS paragraphs FROM paragraph GROUP BY doc_id")
def document_bytes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return document_sizes(paragraphs(spark, sf_dir))
