"""Placement against a walk over each document, on random parts with all that rules speak of."""

import random

import pytest
from pyspark.sql import functions as F

from quire.functions.asof import as_of
from quire.operators import placement as P
from quire.sources import shared

SCHEMA = "doc_id string, section long, block long, part long, row boolean, first boolean, last boolean, fit long, adv long, before long, after long, breaks boolean, body long"


def walk(parts):
    """{(doc, section, block, part): (page, y)} and boxes, by one walk over the parts in order."""
    out, bands, state = {}, [], {}
    for d, s, b, k, row, first, last, fit, adv, before, after, breaks, body in sorted(parts):
        page, vert, at_section, begun = state.get(d, (0, 0, None, None))
        if at_section is not None and s != at_section:
            page, vert = page + 1, 0
        if breaks and first and vert > 0:
            page, vert = page + 1, 0
        if first and vert > 0:
            vert += before
        if first:
            begun = (page, vert)
        if fit > 0 and vert > 0 and vert + fit > body and (not row or fit <= body):
            page, vert = page + 1, 0
        out[d, s, b, k] = (page, vert)
        end = vert + adv
        if last and not row and fit > 0:
            p0, y0 = begun
            for p in range(p0, page + 1):
                y = y0 if p == p0 else 0
                bands.append((d, s, b, p, y, end - y if p == page else max(0, body - y)))
        vert = end + (after if last else 0)
        state[d] = (page, vert, s, begun)
    return out, bands


def made(seed, docs, blocks, body=1000):
    rng, rows = random.Random(seed), []
    for d in range(docs):
        for b in range(rng.randint(1, blocks)):
            row, n = rng.random() < 0.4, rng.choice([1, 1, 2, 5, 30])
            none = rng.random() < 0.15  # an anchor: no height
            before, after = (0, 0) if none else (rng.choice([0, 0, 90]), rng.choice([0, 40]))
            for k in range(1 if none else n):
                fit = 0 if none else rng.choice([10, 100, 333, 999, 1000, 1001, 2500] if row else [50, 120, 1200])
                adv = fit if row else fit * rng.choice([8, 16]) // 10
                rows.append((f"d{d}", b // 23, b, k, row, k == 0, none or k == n - 1, fit, adv, before, after, rng.random() < 0.1 if k == 0 else False, body))
    broken = {r[:3] for r in rows if r[11]}
    return [(*r[:11], r[:3] in broken, body) for r in rows]


def check(spark, rows, **cut):
    placed = P.place(spark.createDataFrame(rows, SCHEMA).repartition(4), **cut).cache()
    want, bands = walk(rows)
    got = {(r["doc_id"], r["section"], r["block"], r["part"]): (r["page"], r["y"]) for r in placed.collect()}
    assert got == want
    boxes = P.boxes_by_page(placed).where("kind = 'paragraph'").collect()
    assert sorted((r["doc_id"], r["section"], r["block"], r["page"], r["y"], r["h"]) for r in boxes) == sorted(bands)
    frags = {(r["doc_id"], r["section"], r["block"], r["page"]): (r["y"], r["h"], r["first_row"], r["last_row"]) for r in P.boxes_by_page(placed).where("kind = 'table'").collect()}
    own = {}
    for r in rows:
        if r[4] and r[7] > 0:
            page, y = want[r[:4]]
            a, h, i, j = own.get((*r[:3], page), (y, 0, r[3], r[3]))
            own[(*r[:3], page)] = (min(a, y), h + r[8], min(i, r[3]), max(j, r[3] + 1))
    assert frags == own


@pytest.mark.parametrize("chunk, stretch", [(P.CHUNK, P.STRETCH), (3, 8), (1, 2)])
def test_random_documents_in_any_cut(spark, chunk, stretch):
    check(spark, made(chunk, 12, 60), chunk=chunk, stretch=stretch)


def test_small_cases(spark):
    line = lambda b, k, n, fit, **x: ("d", x.get("s", 0), b, k, x.get("row", False), k == 0, k == n - 1, fit, x.get("adv", fit), x.get("before", 0), x.get("after", 0), x.get("breaks", False), 100)
    check(spark, [line(0, 0, 1, 250), line(1, 0, 1, 10)])  # taller than the body
    check(spark, [line(0, 0, 1, 30), line(1, 0, 1, 30, breaks=True), line(2, 0, 1, 30, s=1)])
    check(spark, [line(0, 0, 1, 40), *[line(1, k, 9, 30, row=True) for k in range(9)], line(2, 0, 1, 10)])  # a table over three pages
    check(spark, [line(0, 0, 1, 40), line(1, 0, 3, 30, row=True), line(1, 1, 3, 300, row=True), line(1, 2, 3, 30, row=True)])  # an over-tall row stays
    check(spark, [line(0, 0, 1, 90), line(1, 0, 1, 0), line(2, 0, 1, 50, row=True, before=30), line(3, 0, 1, 0), line(4, 0, 1, 60, before=30)])
    assert P.place(spark.createDataFrame([], SCHEMA)).count() == 0


def test_a_long_document_takes_many_stretches(spark):
    """One section of 60,000 blocks: 15 stretches, 4 rounds; no array grows with it."""
    n = 60_000
    d = spark.range(n).select(F.lit("d").alias("doc_id"), F.lit(0).cast("long").alias("section"), F.col("id").alias("block"), F.lit(0).cast("long").alias("part"), F.lit(False).alias("row"), F.lit(True).alias("first"), F.lit(True).alias("last"), (F.col("id") * 7919 % 300 + 1).alias("fit"))
    d = d.select("*", F.col("fit").alias("adv"), F.lit(5).cast("long").alias("before"), F.lit(0).cast("long").alias("after"), (F.col("block") % 1000 == 999).alias("breaks"), F.lit(1000).cast("long").alias("body"))
    got = {r["block"]: (r["page"], r["y"]) for r in P.place(d).select("block", "page", "y").collect()}
    want, _ = walk([tuple(r) for r in d.collect()])
    assert got == {k[2]: v for k, v in want.items()}


def test_cells_over_fragments(spark):
    rows = [("d", 0, 0, k, True, k == 0, k == 4, 40, 40, 0, 0, False, 100) for k in range(5)]
    cells = spark.createDataFrame([("d", 0, 0, 1, 0, 3, True), ("d", 0, 0, 0, 1, 1, True), ("d", 0, 0, 4, 1, 1, False)], "doc_id string, section long, block long, row long, col long, row_span long, active boolean")
    got = P.cell_boxes(P.place(spark.createDataFrame(rows, SCHEMA)), cells)
    assert sorted((r["row"], r["col"], r["page"], r["y"], r["h"]) for r in got.collect()) == [(0, 1, 0, 0, 40), (1, 0, 0, 40, 40), (1, 0, 1, 0, 80)]


@pytest.mark.parametrize("width", [1, 7, 1000])
def test_as_of(spark, width):
    rng = random.Random(width)
    right = [(k, v, v * 10) for k in "ab" for v in rng.sample(range(-50, 400), 20)]
    left = [(k, rng.randint(-60, 420), i) for i, k in enumerate("abc" * 40)]
    ldf, rdf = spark.createDataFrame(left, "k string, t long, i long"), spark.createDataFrame(right, "k string, t long, v long")
    for above in (False, True):
        got = {r["i"]: r["v"] for r in as_of(ldf, rdf, ["k"], "t", ["v"], width=width, above=above).collect()}
        for k, t, i in left:
            near = [x for q, x, _ in right if q == k and (x > t if above else x <= t)]
            assert got[i] == ((min(near) if above else max(near)) * 10 if near else None)


def test_tasks_stay_small_however_many_parts(spark, monkeypatch):
    """Parts are dealt out by their number, not merged by the bytes that were shuffled."""
    monkeypatch.setattr(shared, "ROWS", 100)
    parts = P.document_parts(spark, "/root/testdata/sf0.001")
    count = parts.count()
    linked = P.links(parts, rows=count)
    assert linked.rdd.getNumPartitions() == -(-2 * count // 100) > 8
