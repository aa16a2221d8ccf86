"""Sinks: HTML, HWPX packages, CSS text and reports."""

from __future__ import annotations

import io
import zipfile
from collections.abc import Iterator
from itertools import groupby
from xml.sax.saxutils import escape

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quire.functions.text import escape_xml


def html_table(grid: DataFrame, key: str = "doc_id") -> DataFrame:
    """(key, html) of active cells: rows and cells in order, spans and shades as attributes."""
    attributes = F.concat(
        F.when(F.col("row_span") > 1, F.concat(F.lit(' rowspan="'), F.col("row_span").cast("string"), F.lit('"'))).otherwise(""),
        F.when(F.col("col_span") > 1, F.concat(F.lit(' colspan="'), F.col("col_span").cast("string"), F.lit('"'))).otherwise(""),
        F.when(F.col("shade").isNotNull(), F.concat(F.lit(' style="background:'), "shade", F.lit('"'))).otherwise(""),
    )
    cell = F.concat(F.lit("<td"), attributes, F.lit(">"), escape_xml(F.col("text")), F.lit("</td>"))
    joined = lambda c, o: F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(o, c.alias("t")))), lambda x: x["t"]), "")
    rows = grid.where("active").groupBy(key, "row").agg(F.concat(F.lit("<tr>"), joined(cell, "col"), F.lit("</tr>")).alias("tr"))
    return rows.groupBy(key).agg(F.concat(F.lit("<table>"), joined(F.col("tr"), "row"), F.lit("</table>")).alias("html"))


def html_document(paras: DataFrame) -> DataFrame:
    """(doc_id, html): a self-contained page of paragraphs in order."""
    lines = F.transform(F.array_sort(F.collect_list(F.struct("section", "block", "text"))), lambda x: F.concat(F.lit("<p>"), escape_xml(x["text"]), F.lit("</p>")))
    return paras.groupBy("doc_id").agg(F.concat(F.lit('<!doctype html><meta charset="utf-8"><body>'), F.array_join(lines, ""), F.lit("</body>")).alias("html"))


def css_text(rules: DataFrame) -> DataFrame:
    """(doc_id, css): rules by kind (tag, class, id), then name; declarations by property."""
    decls = rules.groupBy("doc_id", "rank", "selector").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("prop", "value"))), lambda d: F.concat(d["prop"], F.lit(": "), d["value"], F.lit(";"))), " ").alias("body"))
    ordered = F.transform(F.array_sort(F.collect_list(F.struct("rank", "selector", "body"))), lambda r: F.concat(r["selector"], F.lit(" { "), r["body"], F.lit(" }")))
    return decls.groupBy("doc_id").agg(F.array_join(ordered, "\n").alias("css"))


def package(paragraphs_of: list[list[str]]) -> bytes:
    """A minimal HWPX package: a list of paragraphs for each section."""
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as z:
        z.writestr(zipfile.ZipInfo("mimetype"), "application/hwp+zip", zipfile.ZIP_STORED)
        z.writestr("Contents/header.xml", '<?xml version="1.0" encoding="UTF-8" standalone="yes"?><hh:head xmlns:hh="http://www.hancom.co.kr/hwpml/2011/head"/>')
        for k, paras in enumerate(paragraphs_of):
            body = "".join(f'<hp:p id="{i}" paraPrIDRef="0"><hp:run charPrIDRef="0"><hp:t>{escape(t)}</hp:t></hp:run></hp:p>' for i, t in enumerate(paras))
            z.writestr(f"Contents/section{k}.xml", f'<?xml version="1.0" encoding="UTF-8" standalone="yes"?><hs:sec xmlns:hs="http://www.hancom.co.kr/hwpml/2011/section" xmlns:hp="http://www.hancom.co.kr/hwpml/2011/paragraph">{body}</hs:sec>')
    return out.getvalue()


def write_packages(paras: DataFrame) -> DataFrame:
    """(doc_id, content): an HWPX package for each document. One document is one package, so its paragraphs meet in one task."""

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            content = []
            for lines in b.column(1):
                section, text = (lines.values.field(k).to_pylist() for k in (0, 2))
                content.append(package([[text[k] for k in which] for _, which in groupby(range(len(text)), section.__getitem__)]))
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(content, pa.binary())], names=["doc_id", "content"])

    lines = F.array_sort(F.collect_list(F.struct("section", "block", "text"))).alias("lines")
    return paras.groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(lines).mapInArrow(build, "doc_id long, content binary")


def report_json(report: DataFrame) -> DataFrame:
    """Totals of a fill report as one JSON text, with the counts of each reason."""
    reasons = report.select(F.explode_outer("reasons").alias("reason")).where("reason is not null").groupBy("reason").count()
    totals = report.agg(F.count_if("created").alias("created"), F.count_if(~F.col("created")).alias("skipped"), F.count_if("needs_review").alias("needs_review"))
    counts = reasons.agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("reason", "count")))).alias("reasons"))
    return totals.join(counts).select(F.to_json(F.struct("created", "skipped", "needs_review", "reasons")).alias("json"))


def data_uri(content: Column, mime: str) -> Column:
    return F.concat(F.lit(f"data:{mime};base64,"), F.base64(content))
