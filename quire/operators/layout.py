"""Ordered operators: numbering, line breaking and pagination."""

from __future__ import annotations

import bisect
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quire.functions import text as X
from quire.functions.text import FULL_WIDTH
from quire.operators.placement import place, start_pages
from quire.plans.registry import query
from quire.sources.adapters import paragraphs


def assign_node_ids(paras: DataFrame) -> DataFrame:
    """node_id from 1 over each document's paragraphs, on through its sections."""
    return paras.withColumn("node_id", F.row_number().over(Window.partitionBy("doc_id").orderBy("section", "block")))


#: Characters that may not begin or end a line.
NO_START = set(")]},.!?;:'\"、。…·―ー》」』】）｝〕〉＞≫］﹞〞’”，．！？；：%‰℃°％")
NO_END = set("([{'\"《「『【（｛〔〈＜≪［〝‘“$₩£€¥＄￥")
HANG = 8


#: Widths in tenths of the size, by code point: full-width characters ten, space and tab three, all others five.
_TENTHS = np.full(0x110000, 5, np.int64)
for _a, _b in FULL_WIDTH:
    _TENTHS[_a : _b + 1] = 10
_TENTHS[[ord(" "), ord("\t")]] = 3


def _settle(text: str, start: int, end: int) -> int:
    """A break moved so that no forbidden character begins the next line or, failing that, ends this one."""
    if not start < end < len(text):
        return end
    hung = end
    while hung < min(len(text), end + HANG) and text[hung] in NO_START:
        hung += 1
    if hung > end:
        return hung
    while end > start + 1 and text[end - 1] in NO_END:
        end -= 1
    return end


def break_lines(text: str, width: float, size: float = 1000.0, sums: np.ndarray | None = None) -> list[tuple[int, int]]:
    """(start, end) of each line under flat advances.

    Prefix widths are bisected for what fits. Full-width characters break anywhere; other text at its last space, or,
    if a word alone is wider than the line, between characters. A line feed ends its line and belongs to none.
    sums are the prefix widths, in tenths, from any base; they are worked out if not given.
    """
    n = len(text)
    if not n:
        return [(0, 0)]
    if sums is None:
        sums = prefix_widths(text)
    room = int((width + 1e-9) * 10 / size)
    if sums[n] - sums[0] <= room and "\n" not in text:
        return [(0, n)]
    at, out, start = sums.tolist(), [], 0
    while start < n:
        feed = text.find("\n", start)
        stop = n if feed < 0 else feed
        # a character has three tenths at least, so that no more than a third of the room can fit
        fit = min(stop, max(start + 1, bisect.bisect_right(at, at[start] + room, start, min(n, start + room // 3 + 1) + 1) - 1)) if stop > start else start
        if fit == stop and feed >= 0:
            out.append((start, feed))
            start = feed + 1
            continue
        end = fit
        if end < n and at[end + 1] - at[end] != 10:
            space = max(text.rfind(" ", start, end), text.rfind("　", start, end)) + 1
            if space > start:  # without one the word is wider than the line, for what fits ends in it
                end = space
        end = _settle(text, start, end)
        out.append((start, end))
        start = end
    return out


def prefix_widths(text: str) -> np.ndarray:
    """Running widths of a text's characters in tenths, from 0."""
    codes = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
    return np.concatenate([[0], np.cumsum(_TENTHS[codes])])


def line_breaks(paras: DataFrame, width: float = 42000.0) -> DataFrame:
    """(doc_id, section, block, lines): half-open ranges of each paragraph's lines. Widths of a whole batch are summed at once."""
    kinds = ", ".join(f"{c} {paras.schema[c].dataType.simpleString()}" for c in ("doc_id", "section", "block"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = [t or "" for t in b.column(3).to_pylist()]
            sums, ends = prefix_widths("".join(texts)), np.cumsum([0, *map(len, texts)]).tolist()
            found = [break_lines(t, width, sums=sums[a : z + 1]) for t, a, z in zip(texts, ends, ends[1:])]  # noqa: B905
            flat = np.array([x for lines in found for x in lines], np.int32).reshape(-1, 2)
            pairs = pa.StructArray.from_arrays([pa.array(flat[:, 0]), pa.array(flat[:, 1])], ["start", "end"])
            offsets = np.cumsum([0, *map(len, found)]).astype(np.int32)
            yield pa.RecordBatch.from_arrays([*(b.column(k) for k in range(3)), pa.ListArray.from_arrays(pa.array(offsets), pairs)], names=["doc_id", "section", "block", "lines"])

    return paras.select("doc_id", "section", "block", "text").mapInArrow(run, f"{kinds}, lines array<struct<start:int,end:int>>")


def paginate(heights: DataFrame, body: float) -> DataFrame:
    """(doc_id, section, block, page): on which page, from 1, each block starts.

    heights: doc_id, section, block, breaks (boolean), parts (array<double>: a paragraph's lines or a table's rows, in
    thousandths exact). A part goes to a new page if it does not fit, unless the page is empty or no page could hold it.
    Sections begin new pages.
    """
    thousandths = lambda h: F.coalesce(F.round(h * 1000).cast("long"), F.lit(0))
    parts = heights.select("doc_id", "section", "block", "breaks", F.size("parts").alias("n"), F.posexplode_outer("parts").alias("part", "h"))
    none = F.lit(0).cast("long")
    part = F.coalesce(F.col("part"), F.lit(0)).cast("long")
    measured = [F.lit(True).alias("row"), (part == 0).alias("first"), (part >= F.col("n") - 1).alias("last"), thousandths(F.col("h")).alias("fit"), thousandths(F.col("h")).alias("adv"), none.alias("before"), none.alias("after"), "breaks", thousandths(F.lit(body)).alias("body")]
    return start_pages(place(parts.select("doc_id", "section", "block", part.alias("part"), *measured))).withColumn("page", F.col("page") + 1)


def _heights(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = F.greatest(F.ceil(X.flat_width(F.col("text")) / 42000.0), F.lit(1)).cast("int")
    return paragraphs(spark, sf_dir).select("doc_id", F.floor(F.col("block") / 40).cast("long").alias("section"), "block", (F.col("block") % 17 == 16).alias("breaks"), F.array_repeat(F.lit(1600.0), lines).alias("parts"))


@query()
def line_break(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_breaks(paragraphs(spark, sf_dir)).select("doc_id", "block", F.size("lines").alias("n_lines"), F.element_at("lines", -1)["start"].alias("last_start"))


@query()
def block_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return paginate(_heights(spark, sf_dir), 69788.0)


@query(name="paginate")
def paginate_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return paginate(_heights(spark, sf_dir), 69788.0).groupBy("doc_id").agg(F.max("page").alias("pages"))
