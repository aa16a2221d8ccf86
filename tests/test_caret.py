"""Carets against a search through all runs, and neighbours of a grid's cells."""

import random

import pytest

from quire.operators import caret as C

RUNS = "doc_id long, page long, section long, para long, char_start long, char_len long, x0 double, x1 double, top double, height double"
ASKED = "req long, doc_id long, page long, section long, para long, offset long"


def rect(runs, offset):
    """runs of one paragraph on one page: (char_start, char_len, x0, x1, top, height)."""
    runs = sorted(runs, key=lambda r: (r[0], r[2]))
    if not runs or offset is None:
        return None, None, None
    for s, n, x0, x1, top, h in runs:
        if s <= offset < s + max(n, 1):
            return x0 + ((x1 - x0) * (offset - s) / n if n else 0), top, h
    return (runs[0][2], *runs[0][4:]) if offset < runs[0][0] else (runs[-1][3], *runs[-1][4:])


@pytest.mark.parametrize("width", [1, 5, C.WIDTH])
def test_carets(spark, width):
    rng, runs, want, asked = random.Random(width), {}, {}, []
    for key in [(d, p, 0, k) for d in range(3) for p in range(2) for k in range(4)]:
        at, own = rng.randint(0, 4), []
        for _ in range(rng.randint(0, 6)):
            n = rng.choice([0, 1, 4, 9])
            own.append((at, n, float(rng.randint(0, 50)), float(rng.randint(51, 99)), float(rng.randint(0, 9)), 12.0))
            at += n + rng.choice([0, 0, 3]) + (n == 0)
        runs[key] = own
        for offset in [-1, None, *range(0, at + 3)]:
            want[len(asked)] = rect(own, offset)
            asked.append((len(asked), *key, offset))
    rows = [(*k, *r) for k, own in runs.items() for r in own]
    got = C.caret_rects(spark.createDataFrame(asked, ASKED).repartition(3), spark.createDataFrame(rows, RUNS), width=width).collect()
    assert len(got) == len(asked)
    for r in got:
        x, top, h = want[r["req"]]
        assert (r["x"], r["top"], r["height"]) == (pytest.approx(x) if x is not None else None, top, h), asked[r["req"]]


def test_boundaries_prefer_the_next_run(spark):
    rows = [(1, 0, 0, 0, 0, 4, 0.0, 40.0, 0.0, 12.0), (1, 0, 0, 0, 4, 4, 5.0, 45.0, 20.0, 12.0)]
    got = C.caret_rects(spark.createDataFrame([(k, 1, 0, 0, 0, o) for k, o in enumerate((0, 2, 4, 8, 99))], ASKED), spark.createDataFrame(rows, RUNS)).orderBy("req").collect()
    assert [(r["x"], r["top"]) for r in got] == [(0.0, 0.0), (20.0, 0.0), (5.0, 20.0), (45.0, 20.0), (45.0, 20.0)]


def test_neighbours_of_a_grid(spark):
    cells = [(0, r * 10 + c, c * 50.0, r * 20.0, 49.0, 19.0) for r in range(3) for c in range(4)]
    got = {(r["box"], r["direction"]): r["neighbour"] for r in C.neighbours(spark.createDataFrame(cells, "page long, box long, x double, y double, w double, h double")).collect()}
    for r in range(3):
        for c in range(4):
            want = {"left": r * 10 + c - 1 if c else None, "right": r * 10 + c + 1 if c < 3 else None, "up": r * 10 + c - 10 if r else None, "down": r * 10 + c + 10 if r < 2 else None}
            assert {d: got[r * 10 + c, d] for d in want} == want


def test_only_runs_of_lines_asked_for_are_made(spark, sf_dir):
    lines = spark.createDataFrame([(1, 0, 0, 0), (1, 1, 0, 0), (3, 0, 0, 1), (1, 0, 0, 99)], "doc_id long, page long, section long, para long")
    lines = lines.select("doc_id", "page", "section", "para").union(lines.where("page = 0"))
    got = C._runs(spark, sf_dir, lines).toPandas()
    assert len(got) and not got.duplicated().any()
    assert set(zip(got.doc_id, got.para, got.page, strict=True)) <= {(1, 0, 0), (1, 0, 1), (3, 1, 0)}


def test_neighbours_on_sparse_and_dense_pages(spark, monkeypatch):
    """Pages of few boxes need no tiles, and lines are dealt out by page alone; either way gives the same."""
    from quire.operators import caret
    from quire.sources.adapters import boxes

    placed = boxes(spark, "/root/testdata/sf0.001")
    sparse = caret.neighbours(placed)
    plan = sparse._jdf.queryExecution().executedPlan().toString()
    dealt = [line for line in plan.split("\n") if " Exchange " in line]
    assert dealt and all("hashpartitioning(page" in line and "REPARTITION_BY_NUM" in line for line in dealt)
    monkeypatch.setattr(caret, "SPARSE", 0)
    tiled = caret.neighbours(placed)
    assert sorted(map(str, sparse.collect())) == sorted(map(str, tiled.collect()))
