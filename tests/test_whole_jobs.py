"""Queries over all rows of their tables, against their SQL."""

import duckdb
from pyspark.sql import functions as F
from test_oracles import rows

import quire.plans.catalog  # noqa: F401
from quire.operators import spatial
from quire.operators.fill import file_name
from quire.plans import registry
from quire.sources.adapters import PAGES, dense_boxes


def whole(sf_dir, name, tables):
    con = duckdb.connect()
    for t in tables:
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    return rows(con.sql(registry.ORACLES[name]).df())


def test_file_names_of_all_customers(spark):
    sf_dir = "/root/testdata/sf0.01"  # more than 1,000 customers
    got = registry.QUERIES["fill_file_names"](spark, sf_dir).toPandas()
    assert got.c_custkey.max() >= 1000 and got.file.is_unique
    assert rows(got) == whole(sf_dir, "fill_file_names", ["customer"])


def test_file_names_do_not_cut_numbers(spark):
    got = spark.range(998, 1012).select(file_name("form_{index:03d}_{index}", F.col("id")).alias("f")).collect()
    assert [r["f"] for r in got] == [f"form_{i:03d}_{i}" for i in range(998, 1012)]


def test_rectangles_of_all_probes(spark, sf_dir):
    got = registry.QUERIES["blocks_in_rect"](spark, sf_dir).toPandas()
    assert (got.rect % 5 != 0).any()
    assert rows(got) == whole(sf_dir, "blocks_in_rect", ["events", "orders", "lineitem", "documents", "customer"])


def test_runs_of_all_paragraphs(spark, sf_dir):
    got = registry.QUERIES["run_split"](spark, sf_dir).toPandas()
    assert (got.block >= 3).any()
    assert rows(got) == whole(sf_dir, "run_split", ["documents"])


def test_hit_tests_on_pages_that_grow_denser(spark, sf_dir):
    """Pages are as many at any size, so that points meet more boxes as the tables grow; SQL and query alike."""
    got = dense_boxes(spark, sf_dir).groupBy("page").count().toPandas()
    assert got.page.max() == PAGES - 1
    for name in ("block_at_nearest", "cell_at_smallest", "blocks_in_rect", "caret_offset", "boxes_at_point"):
        assert "l_orderkey % 997 AS page" in registry.ORACLES[name] and "event_id % 997 AS page" in registry.ORACLES[name]
    assert "l_orderkey // 16 AS page" in registry.ORACLES["neighbour_cells"]


def test_hit_tests_sort_no_pairs(spark):
    """The best of a point's boxes is the least of their ranks: pairs go into hash aggregates."""
    boxes = spark.range(400).selectExpr("id % 3 as page", "id as box", "cast(id * 7 % 90 as double) x", "cast(id * 5 % 80 as double) y", "cast(id % 40 as double) w", "cast(id % 30 as double) h")
    points = spark.range(50).selectExpr("id as probe", "id % 3 as page", "cast(id * 11 % 95 as double) px", "cast(id * 13 % 85 as double) py")
    found = spatial.cell_at(points, boxes)
    assert "SortAggregate" not in found._jdf.queryExecution().executedPlan().toString()
    b, p = boxes.collect(), points.collect()
    want = {}
    for q in p:
        held = [(r.w * r.h, r.box) for r in b if r.page == q.page and r.x <= q.px <= r.x + r.w and r.y <= q.py <= r.y + r.h]
        if held:
            want[q.probe] = min(held)[1]
    assert {r["probe"]: r["box"] for r in found.collect()} == want and want


def test_rectangles_and_boxes_of_several_rows(spark):
    boxes = spark.range(300).selectExpr("id % 2 as page", "id % 120 as box", "cast(id * 7 % 200 as double) x", "cast(id * 5 % 180 as double) y", "cast(id % 90 as double) w", "cast(id % 70 as double) h")
    rects = spark.range(40).selectExpr("id % 2 as page", "id % 30 as rect", "cast(id * 9 % 150 as double) x0", "cast(id * 4 % 210 as double) x1", "cast(id * 3 % 140 as double) y0", "cast(id * 11 % 190 as double) y1")
    got = [tuple(r) for r in spatial.boxes_in_rect(rects, boxes).collect()]
    want = {(r.rect, b.box) for r in rects.collect() for b in boxes.collect() if r.page == b.page and b.x <= max(r.x0, r.x1) and b.x + b.w >= min(r.x0, r.x1) and b.y <= max(r.y0, r.y1) and b.y + b.h >= min(r.y0, r.y1)}
    assert len(got) == len(set(got)) and set(got) == want


def dense(spark):
    boxes = spark.range(600).selectExpr("id % 2 as page", "id as box", "0.0D as x", "cast(id % 7 * 9 as double) y", "1.0D as w", "cast(id % 5 as double) h")
    points = spark.range(200).selectExpr("id as probe", "id % 3 as page", "0.0D as px", "cast(id % 11 * 7 - 4 as double) py")
    return boxes, points


def test_equal_bands_and_places_meet_once(spark, monkeypatch):
    """Pairs grow with the different places on a page: 70 bands and 22 places at most, not 600 boxes and 200 points."""
    boxes, points = dense(spark)
    ranked, real = [], spatial._ranked

    def spy(placed, *order):
        ranked.append(placed.count())
        return real(placed, *order)

    monkeypatch.setattr(spatial, "_ranked", spy)
    got = {r["probe"]: r["box"] for r in spatial.block_at(points, boxes).collect()}
    assert ranked == [70]
    b, want = boxes.collect(), {}
    for q in points.collect():
        rank = [((near := max(r.y - q.py, q.py - (r.y + r.h), 0.0)) > 0, near or r.h, r.box) for r in b if r.page == q.page]
        if rank:
            want[q.probe] = min(rank)[2]
    assert got == want and len(want) == 134
