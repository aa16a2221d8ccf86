"""Readers of zipped documents: packages under size limits, HWPX and DOCX paragraphs and tables, roster texts.

Each reads a (path, content) table with mapInArrow, one file at a time, streaming XML; a file that breaks a limit or
cannot be read becomes one row with an error, so that one bad file fails no job.
"""

from __future__ import annotations

import io
import re
import zipfile
import zlib
from collections.abc import Iterator
from xml.etree import ElementTree

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

LIMITS = {"raw_bytes": 64 << 20, "inflated_bytes": 256 << 20, "entries": 4096, "nesting": 8, "paragraphs": 200_000}

BLOCKS = "path string, section int, block int, table_path string, row int, col int, row_span int, col_span int, para_ref string, char_ref string, page_break boolean, text string, error string"

#: Rows of blocks that go on together.
FULL = 4096


class LimitError(ValueError):
    pass


class Package:
    """A zip archive whose parts are inflated under one budget."""

    def __init__(self, content: bytes):
        if len(content) > LIMITS["raw_bytes"]:
            raise LimitError("raw_bytes")
        self.zip = zipfile.ZipFile(io.BytesIO(content))
        if len(self.zip.infolist()) > LIMITS["entries"]:
            raise LimitError("entries")
        self.left = LIMITS["inflated_bytes"]

    def names(self) -> list[str]:
        return self.zip.namelist()

    def read(self, name: str) -> bytes:
        with self.zip.open(name) as part:
            data = part.read(self.left + 1)
        self.left -= len(data)
        if self.left < 0:
            raise LimitError("inflated_bytes")
        return data

    def sections(self) -> list[str]:
        """Section parts in lexicographic order: section10 comes before section2."""
        return sorted(n for n in self.names() if re.fullmatch(r"Contents/section\d+\.xml", n))


def _local(tag: str) -> str:
    return tag.rpartition("}")[2]


def _get(element: ElementTree.Element, name: str) -> str | None:
    return next((v for k, v in element.attrib.items() if _local(k) == name), None)


#: Inline elements that stand for characters.
INLINE = {"fwSpace": "　", "nbSpace": " ", "tab": "\t", "lineBreak": "\n"}


def _own_text(paragraph: ElementTree.Element) -> str:
    """The text of a paragraph's runs, without that of tables in it."""
    out = []

    def walk(e: ElementTree.Element) -> None:
        for child in e:
            tag = _local(child.tag)
            if tag == "t":
                out.append(child.text or "")
                for inner in child:
                    out.append(INLINE.get(_local(inner.tag), ""))
                    out.append(inner.tail or "")
            elif tag not in ("tbl", "p", "subList"):
                walk(child)

    walk(paragraph)
    return "".join(out)


def hwpx_rows(content: bytes) -> Iterator[dict]:
    package, count = Package(content), 0
    for section, name in enumerate(package.sections()):
        block = 0

        def emit(paragraph: ElementTree.Element, at: str, cell: dict) -> Iterator[dict]:
            nonlocal count
            count += 1
            if count > LIMITS["paragraphs"]:
                raise LimitError("paragraphs")
            run = next((r for r in paragraph if _local(r.tag) == "run"), None)
            yield {"section": section, "block": block, "table_path": at, **cell, "para_ref": _get(paragraph, "paraPrIDRef"), "char_ref": _get(run, "charPrIDRef") if run is not None else None, "page_break": _get(paragraph, "pageBreak") == "1", "text": _own_text(paragraph)}
            for k, table in enumerate(t for r in paragraph for t in r if _local(t.tag) == "tbl"):
                deeper = f"{at}/{k}"
                if deeper.count("/") > LIMITS["nesting"]:
                    raise LimitError("nesting")
                for tc in (e for tr in table if _local(tr.tag) == "tr" for e in tr if _local(e.tag) == "tc"):
                    part = {_local(e.tag): e for e in tc}
                    number = lambda e, n, d: int(_get(part[e], n) or d) if e in part else d  # noqa: E731, B023
                    own = {"row": number("cellAddr", "rowAddr", 0), "col": number("cellAddr", "colAddr", 0), "row_span": number("cellSpan", "rowSpan", 1), "col_span": number("cellSpan", "colSpan", 1)}
                    for inner in part.get("subList", ()):
                        if _local(inner.tag) == "p":
                            yield from emit(inner, deeper, own)

        root = ElementTree.fromstring(package.read(name))
        for paragraph in root:
            if _local(paragraph.tag) == "p":
                yield from emit(paragraph, "", {})
                block += 1


def docx_rows(content: bytes) -> Iterator[dict]:
    body = next(e for e in ElementTree.fromstring(Package(content).read("word/document.xml")) if _local(e.tag) == "body")

    def text(p: ElementTree.Element) -> str:
        names = {"tab": "\t", "br": "\n", "cr": "\n"}
        return "".join((e.text or "") if _local(e.tag) == "t" else names.get(_local(e.tag), "") for e in p.iter())

    def emit(container: ElementTree.Element, block: int | None, at: str, cell: dict) -> Iterator[dict]:
        tables = 0
        for k, e in enumerate(x for x in container if _local(x.tag) in ("p", "tbl")):
            here = k if block is None else block
            if _local(e.tag) == "p":
                yield {"section": 0, "block": here, "table_path": at, **cell, "text": text(e)}
                continue
            deeper = f"{at}/{tables}"
            tables += 1
            if deeper.count("/") > LIMITS["nesting"]:
                raise LimitError("nesting")
            for r, tr in enumerate(x for x in e if _local(x.tag) == "tr"):
                col = 0
                for tc in (x for x in tr if _local(x.tag) == "tc"):
                    span = next((_get(x, "val") for x in tc.iter() if _local(x.tag) == "gridSpan"), None)
                    span = int(span or 1)
                    yield from emit(tc, here, deeper, {"row": r, "col": col, "row_span": 1, "col_span": span})
                    col += span

    yield from emit(body, None, "", {})


def read_blocks(files: DataFrame, kind: str) -> DataFrame:
    """Paragraph rows of (path, content) files; kind is hwpx or docx. Cells' paragraphs carry their table's path and address."""
    rows_of = {"hwpx": hwpx_rows, "docx": docx_rows}[kind]
    schema = T._parse_datatype_string(BLOCKS)
    arrow = to_arrow_schema(schema)

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = []
        for batch in batches:
            for path, content in zip(batch.column(0), batch.column(1), strict=True):
                path, content = path.as_py(), content.as_py()
                try:
                    held += [{"path": path, **r} for r in rows_of(content)]
                except (LimitError, zipfile.BadZipFile, ElementTree.ParseError, KeyError, StopIteration, ValueError, zlib.error) as e:
                    held.append({"path": path, "error": str(e) or type(e).__name__})
                if len(held) >= FULL:
                    yield pa.RecordBatch.from_pylist(held, arrow)
                    held = []
        if held:
            yield pa.RecordBatch.from_pylist(held, arrow)

    return files.select("path", "content").mapInArrow(scan, schema)


def section_text(xml: Column) -> Column:
    """A section's text without building the model: what t elements hold, a line feed at each paragraph's end."""
    parts = F.regexp_extract_all(xml, F.lit(r"(?s)<(?:\w+:)?t(?:\s[^>]*)?>([^<]*)</(?:\w+:)?t>|</(?:\w+:)?p>"), F.lit(0))
    plain = F.transform(parts, lambda x: F.when(F.rlike(x, F.lit("^</")), F.lit("\n")).otherwise(F.regexp_replace(x, "<[^>]*>", "")))
    joined = F.array_join(plain, "")
    for name, ch in (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&apos;", "'"), ("&amp;", "&")):
        joined = F.replace(joined, F.lit(name), F.lit(ch))
    return joined


def pdf_lines(glyphs: DataFrame) -> DataFrame:
    """Text lines of positioned glyphs: one for each rounded baseline of a page, characters from left to right; blank ones are dropped.

    glyphs: page, x, y, ch. line numbers run from the top.
    """
    order = F.array_sort(F.collect_list(F.struct("x", "ch")))
    lines = glyphs.groupBy("page", F.round("y").cast("long").alias("base")).agg(F.array_join(F.transform(order, lambda g: g["ch"]), "").alias("text"))
    return lines.where(F.btrim("text") != "")


def decode_text(content: Column) -> Column:
    """Bytes as UTF-8, or as EUC-KR where they are not valid UTF-8."""

    @F.pandas_udf("string")
    def korean(raw: pd.Series) -> pd.Series:
        return raw.map(lambda b: None if b is None else bytes(b).decode("euc_kr", "replace"))

    return F.coalesce(F.try_validate_utf8(content.cast("string")), korean(content))


def open_safety(part_names: Column, first_name: Column) -> Column:
    """Reasons why a package should not be opened: mimetype not first, no section, no header."""
    has = lambda pattern: F.exists(part_names, lambda n: F.rlike(n, F.lit(pattern)))
    return F.array_compact(
        F.array(
            F.when(first_name != "mimetype", "mimetype_not_first"),
            F.when(~has(r"^Contents/section\d+\.xml$"), "no_section"),
            F.when(~has(r"^Contents/header\.xml$"), "no_header"),
        )
    )
