"""Queries over sources and sinks."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quire.plans.registry import query
from quire.sources import packages, sinks
from quire.sources.adapters import CELL, PARAGRAPH, cells, paragraphs, table
from quire.sources.detect import detect, image_kind


@query()
def hwpx_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents written as packages and read back."""
    made = sinks.write_packages(paragraphs(spark, sf_dir))
    return packages.read_blocks(made.select(F.col("doc_id").cast("string").alias("path"), "content"), "hwpx").select("path", "section", "block", "text", "error")


def _docx(text: str) -> bytes:
    import io
    import zipfile
    from xml.sax.saxutils import escape

    out = io.BytesIO()
    lines = text.split("\n")
    cells_ = "".join(f"<w:tc><w:p><w:r><w:t>{escape(w)}</w:t></w:r></w:p></w:tc>" for w in lines[0].split()[:3])
    body = "".join(f"<w:p><w:r><w:t>{escape(x)}</w:t></w:r></w:p>" for x in lines)
    with zipfile.ZipFile(out, "w") as z:
        z.writestr("word/document.xml", f'<w:document xmlns:w="http://schemas.openxmlformats.org/wordprocessingml/2006/main"><w:body>{body}<w:tbl><w:tr>{cells_}</w:tr></w:tbl></w:body></w:document>')
    return out.getvalue()


@query()
def docx_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    @F.pandas_udf("binary")
    def make(texts: pd.Series) -> pd.Series:
        return texts.map(_docx)

    clean = F.regexp_replace("text", "[\\x00-\\x08\\x0B\\x0C\\x0E-\\x1F]", "")
    files = table(spark, sf_dir, "benchmark").select(F.col("item_id").cast("string").alias("path"), make(clean).alias("content"))
    return packages.read_blocks(files, "docx").select("path", "block", "table_path", "row", "col", "text", "error")


@query("SELECT event_id, CASE event_id % 5 WHEN 0 THEN 'hwp5' WHEN 1 THEN 'hwpx' WHEN 2 THEN 'docx' WHEN 3 THEN 'pdf' ELSE 'unknown' END AS format, CASE WHEN event_id % 4 = 0 THEN 'png' WHEN event_id % 4 = 1 THEN 'jpeg' WHEN event_id % 4 = 2 THEN 'empty' ELSE 'bmp' END AS image FROM events")
def format_detect(spark: SparkSession, sf_dir: str) -> DataFrame:
    k, j = F.col("event_id") % 5, F.col("event_id") % 4
    text = lambda s: F.lit(s).cast("binary")
    zip_ = F.unhex(F.lit("504B0304"))
    content = F.when(k == 0, F.unhex(F.lit("D0CF11E0A1B11AE1FF"))).when(k == 1, F.concat(zip_, text("...mimetypeapplication/hwp+zip"))).when(k == 2, F.concat(zip_, text("xxword/document.xml"))).when(k == 3, text("junk %PDF-1.7")).otherwise(text("plain"))
    image = F.when(j == 0, F.unhex(F.lit("89504E470D0A1A0A00"))).when(j == 1, F.unhex(F.lit("FFD8FFE0"))).when(j == 2, text("")).otherwise(text("BM123"))
    return table(spark, sf_dir, "events").select("event_id", detect(content).alias("format"), image_kind(image).alias("image"))


@query(f"WITH {PARAGRAPH} SELECT doc_id, string_agg(replace(replace(replace(text, '&amp;', '&'), '&lt;', '<'), '&gt;', '>'), chr(10) ORDER BY block) || chr(10) AS text FROM paragraph WHERE NOT contains(text, '&') AND NOT contains(text, '<') GROUP BY doc_id")
def section_fast_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    from quire.functions.text import escape_xml

    plain = paragraphs(spark, sf_dir).where(~F.contains("text", F.lit("&")) & ~F.contains("text", F.lit("<")))
    lines = F.transform(F.array_sort(F.collect_list(F.struct("block", "text"))), lambda x: F.concat(F.lit('<hp:p id="1"><hp:run><hp:t>'), escape_xml(x["text"]), F.lit("</hp:t></hp:run></hp:p>")))
    return plain.groupBy("doc_id").agg(packages.section_text(F.array_join(lines, "")).alias("text"))


@query("SELECT l_orderkey AS page, round(l_suppkey / 3.0)::BIGINT AS base, string_agg(substr(l_returnflag, 1, 1), '' ORDER BY l_partkey, l_returnflag) AS text FROM lineitem GROUP BY 1, 2")
def pdf_line_group(spark: SparkSession, sf_dir: str) -> DataFrame:
    glyphs = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("page"), F.col("l_partkey").alias("x"), (F.col("l_suppkey") / 3.0).alias("y"), F.col("l_returnflag").alias("ch"))
    return packages.pdf_lines(glyphs)


@query(f"WITH {CELL}, tr AS (SELECT doc_id, row, '<tr>' || string_agg('<td' || CASE WHEN col_span > 1 THEN ' colspan=\"' || col_span || '\"' ELSE '' END || CASE WHEN shade IS NOT NULL THEN ' style=\"background:' || shade || '\"' ELSE '' END || '>' || text || '</td>', '' ORDER BY col) || '</tr>' AS tr FROM cell WHERE active GROUP BY doc_id, row) SELECT doc_id, '<table>' || string_agg(tr, '' ORDER BY row) || '</table>' AS html FROM tr GROUP BY doc_id")
def html_emit_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sinks.html_table(cells(spark, sf_dir))


@query(f"WITH {PARAGRAPH} SELECT doc_id, '<!doctype html><meta charset=\"utf-8\"><body>' || string_agg('<p>' || replace(replace(replace(replace(text, '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '\"', '&quot;') || '</p>', '' ORDER BY block) || '</body>' AS html FROM paragraph GROUP BY doc_id")
def html_emit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sinks.html_document(paragraphs(spark, sf_dir))


@query("SELECT doc_id, string_agg(selector || ' { ' || body || ' }', chr(10) ORDER BY rank, selector) AS css FROM (SELECT p_size AS doc_id, p_partkey % 3 AS rank, p_brand AS selector, string_agg(p_type || ': ' || p_name || ';', ' ' ORDER BY p_type, p_name) AS body FROM part GROUP BY ALL) GROUP BY doc_id")
def css_emit(spark: SparkSession, sf_dir: str) -> DataFrame:
    rules = table(spark, sf_dir, "part").selectExpr("p_size as doc_id", "p_partkey % 3 as rank", "p_brand as selector", "p_type as prop", "p_name as value")
    return sinks.css_text(rules)


@query("SELECT doc_id, CASE WHEN doc_id % 3 = 0 THEN 'mimetype_not_first' ELSE '' END || CASE WHEN doc_id % 5 = 0 THEN (CASE WHEN doc_id % 3 = 0 THEN ',' ELSE '' END) || 'no_section' ELSE '' END AS problems FROM documents")
def open_safety_check(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents")
    first = F.when(F.col("doc_id") % 3 == 0, "Contents/header.xml").otherwise("mimetype")
    names = F.array(F.lit("Contents/header.xml"), F.when(F.col("doc_id") % 5 == 0, "other.xml").otherwise("Contents/section0.xml"))
    return d.select("doc_id", F.array_join(packages.open_safety(names, first), ",").alias("problems"))
