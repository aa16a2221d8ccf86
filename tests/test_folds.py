"""Folds over many tables or documents in one task, against plain ones."""

import random

import pytest
from pyspark.sql import functions as F

from quire.operators import grid, headers, ops


def test_replay_may_leave_no_block(spark):
    paras = spark.createDataFrame([(1, 0, "a"), (2, 0, "b"), (2, 1, "c")], "doc_id long, block long, text string")
    log = spark.createDataFrame([(1, 1, 1, "DeleteBlock", '{"index":0}'), (2, 1, 1, "DeleteBlock", '{"index":0}'), (3, 1, 1, "Undo", None)], "doc_id long, seq long, batch long, op string, args string")
    assert [tuple(r) for r in ops.replay(paras, log).collect()] == [(2, 0, "c", 1)]


@pytest.fixture
def batch_rows(spark):
    key, was = "spark.sql.execution.arrow.maxRecordsPerBatch", spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    yield lambda n: spark.conf.set(key, str(n))
    spark.conf.set(key, was)


@pytest.mark.parametrize("n", [1, 7, 10000])
def test_spans_take_open_slots(spark, batch_rows, n):
    rng, rows, want = random.Random(3), [], {}
    for d in range(40):
        taken = set()
        for r in range(rng.randint(1, 5)):
            for k in range(rng.randint(0, 5)):
                h, w = rng.randint(0, 3), rng.randint(0, 3)
                c = next(c for c in range(99) if (r, c) not in taken)
                taken.update((r + i, c + j) for i in range(h) for j in range(w))
                rows.append((d, r, k, h, w))
                want[d, r, k] = c
    batch_rows(n)
    placed = grid.place_spans(spark.createDataFrame(rows, "doc_id long, row long, ord long, row_span long, col_span long").repartition(5))
    assert {(r["doc_id"], r["row"], r["ord"]): r["col"] for r in placed.collect()} == want
    plan = placed._jdf.queryExecution().toString()
    assert "MapInArrow" in plan and "FlatMapGroups" not in plan


def test_widths_of_many_tables_in_a_batch(spark):
    rng, rows, want = random.Random(4), [], {}
    for d in range(60):
        cells = [(rng.randint(0, 3), s, rng.choice([None, 0.0, 100.0, 250.0, 700.0])) for s in (rng.randint(1, 3) for _ in range(rng.randint(1, 7)))]
        rows += [(d, *x) for x in cells]
        width = [0.0] * max(c + s for c, s, _ in cells)
        for c, s, w in cells:
            if s == 1:
                width[c] = max(width[c], w or 0.0)
        changed = True
        while changed:
            changed = False
            for s, c, w in sorted({(s, c, w) for c, s, w in cells if s > 1 and w is not None}):
                open_ = [k for k in range(c, c + s) if width[k] <= 0]
                left = w - sum(width[c : c + s])
                if len(open_) == 1 and left > 0:
                    width[open_[0]], changed = left, True
        want |= {(d, k): w if w > 0 else 1800.0 for k, w in enumerate(width)}
    found = grid.derive_widths(spark.createDataFrame(rows, "doc_id long, col long, col_span long, width double").repartition(5))
    assert {(r["doc_id"], r["col"]): r["width"] for r in found.collect()} == want
    assert "FlatMapGroups" not in found._jdf.queryExecution().toString() and found.where(F.col("col") < 0).count() == 0


def test_border_expressions_do_not_multiply(spark):
    """What an edge or a fill is read from is named once in the plan for each thing read, not once for each width or line it may be."""
    entry = '<hh:borderFill><hh:leftBorder type="DASH" width=" 0.7 mm" color="#12aBcd"/><hh:rightBorder /><hh:topBorder type="ODD" width="2mm" color="red"/></hh:borderFill>'
    rows = spark.createDataFrame([(entry,)], "entry string")
    edges = [F.struct(*[c.alias(k) for k, c in headers.border_edge(F.col("entry"), side).items()]).alias(side) for side in ("left", "right", "top", "bottom")]
    found = rows.select(*edges)
    assert [tuple(x) for x in found.first()] == [("dashed", 2.6, "#12ABCD"), ("none", 0.5, "#000000"), ("solid", 7.56, "#000000"), (None, None, None)]
    for df in (found, rows.select(*[c.alias(k) for k, c in headers.border_fill(F.col("entry")).items()])):
        assert df._jdf.queryExecution().optimizedPlan().toString().count("regexp_extract") < 100
