"""Placement: pages, fragments and boxes of all blocks, without a document in one task.

A part is a line of a paragraph or a row of a table. From any part that begins a page, the next page's first part
follows from running heights alone, so each part has a link to it; the pages of a section are what its first part
reaches by these links. Links are walked within stretches of consecutive parts, and from stretch to stretch by
pointer jumping, which doubles its reach each round. A section of one stretch takes no round.

Rules: a section begins a page. A block that breaks begins one, unless the page is empty. A line goes to the next page
if it does not fit, unless the page is empty; a row likewise, but never a row that no page could hold, which runs over.
Space before a block counts unless the page is empty; space after it always. A part of no height stays where it is.

All measures are integers, so sums are exact in any order. Windows hold the parts of CHUNK blocks, or STRETCH parts.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quire.functions.asof import as_of
from quire.plans.registry import query
from quire.sources.adapters import PARAGRAPH, paragraphs
from quire.sources.shared import dealt, materialised

CHUNK, STRETCH = 256, 4096
KEY = ["doc_id", "section"]
BEFORE = (Window.unboundedPreceding, -1)


def links(parts: DataFrame, *, chunk: int = CHUNK, rows: int | None = None) -> DataFrame:
    """parts with ord (from 0 in a section), top, base (the top of what fills a page that begins here) and nxt, the ord that begins the page after it.

    parts: doc_id, section, block, part, row (boolean), first, last (of their block), fit (what must fit), adv (how far
    it moves on), before, after, breaks (of the block), body (height of the section's pages). top counts from the
    section's beginning as if it were one page. rows is how many parts there are.
    """
    rows = parts.count() if rows is None else rows
    own = [*KEY, "chunk"]
    down = Window.partitionBy(*own).orderBy("block", "part")
    up = Window.partitionBy(*own).orderBy(F.desc("block"), F.desc("part"))
    gap, rest = F.when(F.col("first"), F.col("before")).otherwise(0), F.col("adv") + F.when(F.col("last"), F.col("after")).otherwise(0)
    d = dealt(parts.withColumn("chunk", F.floor(F.col("block") / chunk)), own, rows).withColumns({"rest": rest, "step": gap + rest})
    d = d.withColumns({"top": F.sum("step").over(down) - F.col("rest"), "ord": F.row_number().over(down).cast("long") - 1})
    d = d.withColumn("end", F.when((F.col("fit") > 0) & (~F.col("row") | (F.col("fit") <= F.col("body"))), F.col("top") + F.least("fit", "body")))
    d = d.withColumn("forced", F.when(F.col("breaks") & F.col("first"), F.col("ord")))
    # what stands before a chunk and after it, from one row for each chunk
    along, back = Window.partitionBy(*KEY).orderBy("chunk"), Window.partitionBy(*KEY).orderBy(F.desc("chunk"))
    s = d.groupBy(*own).agg(F.sum("step").alias("sum"), F.count("*").alias("n"), F.max("end").alias("most"), F.min("forced").alias("first_forced"))
    s = s.withColumns({"top0": F.coalesce(F.sum("sum").over(along.rowsBetween(*BEFORE)), F.lit(0)), "ord0": F.coalesce(F.sum("n").over(along.rowsBetween(*BEFORE)), F.lit(0))})
    s = s.withColumns({"most0": F.max(F.col("most") + F.col("top0")).over(along.rowsBetween(*BEFORE)), "forced0": F.min(F.col("first_forced") + F.col("ord0")).over(back.rowsBetween(*BEFORE))})
    d = d.withColumns({"high": F.max("end").over(down.rowsBetween(*BEFORE)), "next_forced": F.min("forced").over(up.rowsBetween(*BEFORE))}).join(s.select(*own, "top0", "ord0", "most0", "forced0"), own)
    d = d.withColumns({c: F.col(c) + F.col("top0") for c in ("top", "end", "high")}).withColumns({"ord": F.col("ord") + F.col("ord0"), "next_forced": F.coalesce(F.col("next_forced") + F.col("ord0"), F.col("forced0"))})
    # the first part that fills anything of a page, from here on: before it, gaps do not count and nothing breaks
    filling = F.when(F.col("rest") > 0, F.struct("ord", "top", "next_forced"))
    carried = d.groupBy(*own).agg(F.min(filling).alias("f")).withColumn("f0", F.min("f").over(back.rowsBetween(*BEFORE))).select(*own, "f0")
    d = d.withColumn("f", F.min(filling).over(up.rowsBetween(Window.unboundedPreceding, 0))).join(carried, own).withColumn("f", F.coalesce("f", "f0"))
    d = d.withColumns({"base": F.coalesce("f.top", "top"), "after_break": F.col("f.next_forced")})
    rising = d.where("end > greatest(coalesce(high, -1), coalesce(most0, -1))").select(*KEY, F.col("end").alias("limit"), F.col("ord").alias("over"))
    d = d.select(*parts.columns, "ord", "top", "base", "after_break", (F.col("base") + F.col("body")).alias("limit"))
    return as_of(d, rising, KEY, "limit", ["over"], width=1 << 22, above=True, rows=2 * rows).withColumn("nxt", F.least("over", "after_break")).drop("limit", "over", "after_break")


def _whole(batches: Iterator[pa.RecordBatch], stretch: int) -> Iterator[pa.Table]:
    """Batches, cut so that no stretch is parted. Rows come by stretches; a stretch begins where ord divides."""
    held: list[pa.RecordBatch] = []
    for b in batches:
        begins = np.flatnonzero(b.column("ord").to_numpy() % stretch == 0)
        if len(begins):
            if held or begins[-1]:
                yield pa.Table.from_batches([*held, b.slice(0, begins[-1])])
            held = [b.slice(begins[-1])]
        else:
            held.append(b)
    if held:
        yield pa.Table.from_batches(held)


def _local(t: pa.Table, stretch: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """ord, nxt (-1 for none), and where in the table nxt stands if it is in the same stretch (else -1)."""
    at, nxt = t.column("ord").to_numpy(), t.column("nxt").fill_null(-1).to_numpy()
    same = nxt // stretch == at // stretch
    return at, nxt, np.where(same, np.arange(len(at)) + nxt - at, -1)


def _exits(batches: Iterator[pa.RecordBatch], stretch: int) -> Iterator[pa.RecordBatch]:
    """(doc_id, section, ord, nxt, pages): from each entry, where the walk leaves its stretch, and how many pages begin on the way."""
    for t in _whole(batches, stretch):
        at, nxt, to = _local(t, stretch)
        last, pages = np.arange(len(at)), np.ones(len(at), np.int64)
        while (there := np.flatnonzero(to >= 0)).size:
            via = to[there]
            last[there], pages[there], to[there] = last[via], pages[there] + pages[via], to[via]
        entry = np.flatnonzero(t.column("entry").to_numpy(zero_copy_only=False))
        out = nxt[last[entry]]
        own = t.take(pa.array(entry))
        yield from pa.table({"doc_id": own.column("doc_id"), "section": own.column("section"), "ord": at[entry], "nxt": pa.array(out, mask=out < 0), "pages": pages[entry]}).to_batches()


def _starts(batches: Iterator[pa.RecordBatch], stretch: int) -> Iterator[pa.RecordBatch]:
    """(doc_id, section, ord, base, page): all parts that begin a page, from the entries with a page."""
    for t in _whole(batches, stretch):
        at, _, to = _local(t, stretch)
        page, step = t.column("page").fill_null(-1).to_numpy().copy(), 1
        while (to >= 0).any():
            found = np.flatnonzero((page >= 0) & (to >= 0))
            page[to[found]] = page[found] + step
            to, step = np.where(to >= 0, to[to], -1), step * 2
        own = np.flatnonzero(page >= 0)
        rows = t.take(pa.array(own))
        yield from pa.table({"doc_id": rows.column("doc_id"), "section": rows.column("section"), "ord": at[own], "base": rows.column("base"), "page": page[own]}).to_batches()


def _reached(laid: DataFrame, key: str, order: list[str], stretch: int) -> DataFrame:
    """(doc_id, section, ord, page): the entries of stretches that a section's first part leads to."""
    jump = materialised(laid.mapInArrow(lambda batches: _exits(batches, stretch), f"{key}, nxt long, pages long"))
    reached = jump.where("ord = 0").select(*order, F.lit(0).cast("long").alias("page"))
    while jump.where("nxt is not null").limit(1).count():
        ahead = reached.join(jump.where("nxt is not null"), order).select(*KEY, F.col("nxt").alias("ord"), (F.col("page") + F.col("pages")).alias("page"))
        reached = materialised(reached.union(ahead))
        over = jump.select(*KEY, F.col("ord").alias("nxt"), F.col("nxt").alias("nxt2"), F.col("pages").alias("more"))
        jump = materialised(jump.where("nxt is not null").join(over, [*KEY, "nxt"]).select(*order, F.col("nxt2").alias("nxt"), (F.col("pages") + F.col("more")).alias("pages")))
    return reached


def page_starts(linked: DataFrame, *, stretch: int = STRETCH, count: int | None = None) -> DataFrame:
    """(doc_id, section, ord, base, page): the parts that begin the pages of each section, pages from 0 in it. linked: links(), count rows."""
    count = linked.count() if count is None else count
    kind = {c: linked.schema[c].dataType.simpleString() for c in KEY}
    key = f"doc_id {kind['doc_id']}, section {kind['section']}, ord long"
    rows = linked.select(*KEY, "ord", "base", "nxt")
    entries = materialised(rows.where(F.floor(F.col("nxt") / stretch) != F.floor(F.col("ord") / stretch)).select(*KEY, F.col("nxt").alias("ord"), F.lit(True).alias("entry")).distinct())
    order = [*KEY, "ord"]
    rows = rows.withColumn("s", F.floor(F.col("ord") / stretch))
    laid = dealt(rows, order, count).join(entries, order, "left").withColumn("entry", F.coalesce("entry", F.lit(False)) | (F.col("ord") == 0))
    deal = lambda df: dealt(df, [*KEY, "s"], count).sortWithinPartitions(*order)
    first = rows.where("ord = 0").select(*order, F.lit(0).cast("long").alias("page"))
    reached = _reached(deal(laid), key, order, stretch) if entries.limit(1).count() else first
    return deal(dealt(rows, order, count).join(reached, order, "left")).mapInArrow(lambda batches: _starts(batches, stretch), f"{key}, base long, page long")


def place(parts: DataFrame, *, chunk: int = CHUNK, stretch: int = STRETCH) -> DataFrame:
    """parts with page (from 0 in the document), y (from the top of the page's body) and turned: whether the part did not fit on the page before."""
    rows = parts.count()
    linked = materialised(links(parts, chunk=chunk, rows=rows))
    starts = materialised(page_starts(linked, stretch=stretch, count=rows))
    pages = starts.groupBy(*KEY).agg((F.max("page") + 1).alias("n"))
    pages = pages.select(*KEY, F.coalesce(F.sum("n").over(Window.partitionBy("doc_id").orderBy("section").rowsBetween(*BEFORE)), F.lit(0)).alias("page0"))
    begun = starts.join(pages, KEY).withColumn("start", F.col("ord"))  # each section's first part is among them
    placed = as_of(linked.drop("base"), begun, KEY, "ord", ["start", "base", "page", "page0"], width=stretch, rows=2 * rows)
    return placed.select(
        *parts.columns,
        (F.col("page") + F.col("page0")).alias("page"),
        F.greatest(F.col("top") - F.col("base"), F.lit(0)).alias("y"),
        ((F.col("ord") == F.col("start")) & (F.col("ord") > 0) & ~(F.col("breaks") & F.col("first"))).alias("turned"),
        "top",
        "page0",
    )


def start_pages(placed: DataFrame) -> DataFrame:
    """(doc_id, section, block, page): the page of each block's first part."""
    return placed.where("first").select(*KEY, "block", "page")


def boxes_by_page(placed: DataFrame) -> DataFrame:
    """(doc_id, section, block, page, kind, y, h, first_row, last_row): a box for each page that a block touches.

    A table's box has the rows of its fragment, [first_row, last_row). A paragraph's begins where the text before it
    ended, even if its first line then turned the page; in between it takes whole pages.
    """
    seen = placed.where("fit > 0")
    tables = seen.where("row").groupBy(*KEY, "block", "page").agg(F.min("y").alias("y"), F.sum("adv").alias("h"), F.min("part").alias("first_row"), (F.max("part") + 1).alias("last_row"))
    tables = tables.select(*KEY, "block", "page", F.lit("table").alias("kind"), "y", "h", "first_row", "last_row")
    by_page = Window.partitionBy("doc_id", "section", "block").orderBy("page")
    lines = seen.where("not row").groupBy(*KEY, "block", "body", "page").agg(F.min("y").alias("y"), F.max(F.col("y") + F.col("adv")).alias("end"), F.bool_or(F.col("turned") & F.col("first")).alias("turned"), F.min(F.when(F.col("first"), F.col("top"))).alias("top"))
    lines = lines.withColumn("over", F.lead("page").over(by_page).isNotNull()).withColumn("h", F.when(F.col("over"), F.greatest(F.col("body") - F.col("y"), F.lit(0))).otherwise(F.col("end") - F.col("y")))
    # a turned first line leaves a box at the foot of the page before, whose base is that of the page's first part
    bases = placed.groupBy(*KEY, "page").agg(F.max(F.when(F.col("y") > 0, F.col("top") - F.col("y"))).alias("base"), F.max("top").alias("only"))
    foot = lines.where("turned").select(*KEY, "block", "body", (F.col("page") - 1).alias("page"), "top").join(bases, [*KEY, "page"])
    foot = foot.withColumn("y", F.col("top") - F.coalesce("base", "only")).select(*KEY, "block", "page", F.lit("paragraph").alias("kind"), "y", F.greatest(F.col("body") - F.col("y"), F.lit(0)).alias("h"))
    none = [F.lit(None).cast(placed.schema["part"].dataType).alias(c) for c in ("first_row", "last_row")]
    return tables.union(lines.select(*KEY, "block", "page", F.lit("paragraph"), "y", "h", *none)).union(foot.select("*", *none))


def row_edges(placed: DataFrame) -> DataFrame:
    """(doc_id, section, block, page, row, y, next_y): where each row of a table begins and ends on its fragment's page."""
    return placed.where("row and fit > 0").select(*KEY, "block", "page", F.col("part").alias("row"), "y", (F.col("y") + F.col("adv")).alias("next_y"))


def cell_boxes(placed: DataFrame, cells: DataFrame) -> DataFrame:
    """(doc_id, section, block, page, row, col, y, h) of active cells (…, row, col, row_span, active): one box for each fragment that a cell's rows meet."""
    rows = row_edges(placed).withColumnRenamed("row", "at")
    spans = cells.where("active").select(*KEY, "block", "row", "col", F.explode(F.sequence("row", F.col("row") + F.greatest("row_span", F.lit(1)) - 1)).alias("at"))
    met = spans.join(rows, [*KEY, "block", "at"])
    return met.groupBy(*KEY, "block", "page", "row", "col").agg(F.min("y").alias("y"), F.greatest(F.max("next_y") - F.min("y"), F.lit(1)).alias("h"))


def document_parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as sections of 40 blocks. A paragraph has lines of 1000 that move on by 1600; one with a "|" is a table, a row for each piece."""
    p = paragraphs(spark, sf_dir)
    wide = (F.floor(F.length("text") / 84) + 1).cast("int")
    pieces = F.transform(F.split("text", r"\|"), lambda t: (F.length(t) * 400 + 600).cast("long"))
    heights = F.when(F.col("simple"), F.array_repeat(F.lit(1000).cast("long"), wide)).otherwise(pieces)
    k = F.col("block")
    d = p.select("doc_id", F.floor(k / 40).cast("long").alias("section"), "block", (~F.col("simple")).alias("row"), heights.alias("h"))
    d = d.select("*", F.size("h").alias("n"), F.posexplode("h").alias("part", "fit"))
    return d.select(
        *KEY,
        "block",
        F.col("part").cast("long").alias("part"),
        "row",
        (F.col("part") == 0).alias("first"),
        (F.col("part") == F.col("n") - 1).alias("last"),
        "fit",
        F.when(F.col("row"), F.col("fit")).otherwise(F.expr("fit * 8 div 5")).alias("adv"),
        (k % 3 * 400).alias("before"),
        (k % 4 * 300).alias("after"),
        (k % 17 == 16).alias("breaks"),
        F.lit(BODY).cast("long").alias("body"),
    )


BODY = 20000

#: The parts as above, and a walk over all documents at once, a part of each a step, by the rules of the module.
PLACED = f"""{PARAGRAPH},
p0 AS (SELECT doc_id, block // 40 AS section, block, NOT simple AS is_row, CASE WHEN simple THEN list_transform(range(1 + length(text) // 84), lambda i: 1000::BIGINT) ELSE list_transform(string_split(text, '|'), lambda t: (length(t) * 400 + 600)::BIGINT) END AS h FROM paragraph),
p1 AS (SELECT doc_id, section, block, is_row, len(h) AS n, unnest(h) AS fit, unnest(range(len(h))) AS part FROM p0),
part_ AS (SELECT *, part = 0 AS is_first, part = n - 1 AS is_last, CASE WHEN is_row THEN fit ELSE fit * 8 // 5 END AS adv, block % 3 * 400 AS before, block % 4 * 300 AS after, block % 17 = 16 AS breaks, {BODY}::BIGINT AS body, row_number() OVER (PARTITION BY doc_id ORDER BY block, part) AS k FROM p1),
walk AS (SELECT doc_id, 0::BIGINT AS k, 0::BIGINT AS page, 0::BIGINT AS y, 0::BIGINT AS vert, -1::BIGINT AS section FROM (SELECT DISTINCT doc_id FROM part_)
  UNION ALL SELECT doc_id, k, CASE WHEN turn THEN page + 1 ELSE page END, CASE WHEN turn THEN 0 ELSE v1 END, CASE WHEN turn THEN 0 ELSE v1 END + adv + CASE WHEN is_last THEN after ELSE 0 END, section
  FROM (SELECT *, v1 > 0 AND v1 + fit > body AND (NOT is_row OR fit <= body) AS turn FROM
    (SELECT doc_id, k, section, fit, adv, after, is_last, is_row, body, CASE WHEN fresh THEN page0 + 1 ELSE page0 END AS page, CASE WHEN fresh THEN 0 WHEN v0 > 0 AND is_first THEN v0 + before ELSE v0 END AS v1 FROM
      (SELECT t.*, w.page AS page0, w.vert AS v0, CASE WHEN w.section < 0 THEN false WHEN t.section <> w.section THEN true ELSE t.breaks AND t.is_first AND w.vert > 0 END AS fresh FROM walk w JOIN part_ t ON t.doc_id = w.doc_id AND t.k = w.k + 1)))),
placed AS (SELECT t.*, w.page, w.y FROM part_ t JOIN walk w USING (doc_id, k))"""


@query(f"WITH RECURSIVE {PLACED} SELECT doc_id, section, block, part, page, y FROM placed")
def placed_parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return place(document_parts(spark, sf_dir)).select(*KEY, "block", "part", "page", "y")


@query(f"WITH RECURSIVE {PLACED} SELECT doc_id, section, block, page, min(y)::BIGINT AS y, sum(adv)::BIGINT AS h, min(part) AS first_row, max(part) + 1 AS last_row FROM placed WHERE is_row GROUP BY ALL")
def table_fragments(spark: SparkSession, sf_dir: str) -> DataFrame:
    return boxes_by_page(place(document_parts(spark, sf_dir))).where("kind = 'table'").drop("kind")


@query(f"WITH RECURSIVE {PLACED} SELECT doc_id, section, block, page, part AS edge, y FROM placed WHERE is_row UNION ALL SELECT doc_id, section, block, page, max(part) + 1, max(y + adv) FROM placed WHERE is_row GROUP BY ALL")
def fragment_row_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The edges at which rows can be dragged: one more than each fragment has rows."""
    rows = row_edges(place(document_parts(spark, sf_dir)))
    foot = rows.groupBy(*KEY, "block", "page").agg((F.max("row") + 1).alias("edge"), F.max("next_y").alias("y"))
    return rows.select(*KEY, "block", "page", F.col("row").alias("edge"), "y").union(foot)


@query(f"""WITH RECURSIVE {PLACED}, b AS (SELECT *, lag(page) OVER w AS page0, lag(y + adv + CASE WHEN is_last THEN after ELSE 0 END) OVER w AS v0, lag(section) OVER w AS s0 FROM placed WINDOW w AS (PARTITION BY doc_id ORDER BY k)),
edge AS (SELECT doc_id, section, block, any_value(body) AS body, min(page) FILTER (is_first) AS p1, max(page) AS p2,
  bool_or(is_first AND section = s0 AND NOT breaks AND page > page0) AS turned, max(v0 + before) FILTER (is_first) AS foot, max(y) FILTER (is_first) AS y1, max_by(y + adv, k) AS y2 FROM b WHERE NOT is_row GROUP BY ALL),
span AS (SELECT *, CASE WHEN turned THEN p1 - 1 ELSE p1 END AS pa, CASE WHEN turned THEN foot ELSE y1 END AS ya FROM edge),
flat AS (SELECT *, unnest(range(pa, p2 + 1)) AS page FROM span)
SELECT doc_id, section, block, page, CASE WHEN page = pa THEN ya ELSE 0 END AS y, (CASE WHEN page = p2 THEN y2 ELSE greatest(body, CASE WHEN page = pa THEN ya ELSE 0 END) END - CASE WHEN page = pa THEN ya ELSE 0 END)::BIGINT AS h FROM flat""")
def paragraph_bands(spark: SparkSession, sf_dir: str) -> DataFrame:
    return boxes_by_page(place(document_parts(spark, sf_dir))).where("kind = 'paragraph'").select(*KEY, "block", "page", "y", "h")
