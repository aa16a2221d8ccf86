"""Small cases with literal rows."""

import re
import time

import pandas as pd
import pytest
from pyspark.sql import functions as F

from quire.functions import text as X
from quire.operators import edit, fill, find, grid, intents, layout, profile, selection, spatial, style
from quire.plans import registry
from quire.sources import packages, sinks
from quire.sources.detect import detect


def paras(spark, *texts, simple=True):
    return spark.createDataFrame([(1, 0, i, t, simple, i + 1) for i, t in enumerate(texts)], "doc_id long, section long, block long, text string, simple boolean, node_id long")


def starts(df):
    return sorted((r["block"], r["start"]) for r in df.collect())


def test_find_does_not_overlap_and_counts_code_points(spark):
    assert starts(find.find_matches(paras(spark, "aaaa", "🙂한글 aA", ""), "aa")) == [(0, 0), (0, 2), (1, 4)]
    assert starts(find.find_matches(paras(spark, "aaaa"), "")) == []
    assert starts(find.find_matches(paras(spark, "Aa aA"), "Aa", case_sensitive=True)) == [(0, 0)]
    assert starts(find.find_matches(paras(spark, "a.b a.b axb"), "a.b")) == [(0, 0), (0, 4)]


def test_whole_word_neighbours(spark):
    df = paras(spark, "the other the_ 한the the한 the", "the")
    assert starts(find.find_matches(df, "the", whole_word=True)) == [(0, 0), (0, 25), (1, 0)]


def test_structural_paragraphs_are_skipped(spark):
    assert starts(find.find_matches(paras(spark, "aa", simple=False), "a")) == []


def test_folding_is_for_each_character(spark):
    df = paras(spark, "σς ΣΣ s ſ")
    assert starts(find.find_matches_folded(df, "σ")) == [(0, 0), (0, 3), (0, 4)]


def test_replacement_is_literal(spark):
    row = find.replace_all(paras(spark, "a$b a$b"), "a$b", "\\x$1").first()
    assert (row["replaced"], row["n"]) == ("\\x$1 \\x$1", 2)


def test_scalars(spark):
    df = spark.createDataFrame([("  x　",)], "t string").select(
        X.trim(F.col("t")).alias("trim"),
        X.normalize_css(F.lit("color"), F.lit("#F0a")).alias("c1"),
        X.normalize_css(F.lit("font-size"), F.lit("14.0pt")).alias("c2"),
        X.normalize_css(F.lit("font-size"), F.lit("1.250 em")).alias("c3"),
        X.normalize_css(F.lit("margin"), F.lit("auto")).alias("c4"),
        X.font_class(F.lit("함초롬바탕")).alias("f1"),
        X.font_class(F.lit("Malgun Gothic")).alias("f2"),
        X.truncate(F.lit("abcdef"), 3).alias("t3"),
        X.elide(F.lit("abcdef"), 3).alias("e3"),
        X.nice_ceil(F.lit(23.0)).alias("n1"),
        X.nice_ceil(F.lit(-1.0)).alias("n2"),
        X.flat_width(F.lit("한a \t")).alias("w"),
        X.norm_label(F.lit(" 성 명 (한글) :")).alias("l"),
        X.mm_to_units(F.lit(25.4)).alias("mm"),
        X.hex_colour(F.lit("#a0b1c2")).alias("hex"),
        X.code_fence_body(F.lit("```json\n[1]\n```")).alias("fence"),
    )
    assert tuple(df.first()) == ("x", "#ff00aa", "14pt", "1.25em", "auto", "serif", "gothic", "abc…", "ab…", 50.0, 1.0, 2100.0, "성명한글", 7200, "#A0B1C2", "[1]")


def test_line_breaking():
    assert layout.break_lines("", 1000) == [(0, 0)]
    assert layout.break_lines("aa bb cc", 2500) == [(0, 3), (3, 8)]
    assert layout.break_lines("ab\ncd", 9000) == [(0, 2), (3, 5)]
    assert layout.break_lines("한글한글", 2000) == [(0, 2), (2, 4)]
    assert layout.break_lines("한글).한", 2000) == [(0, 4), (4, 5)]
    assert layout.break_lines("abcdefgh", 1500) == [(0, 3), (3, 6), (6, 8)]
    text = "the quick (brown) fox, 한국어 text\nand more" * 5
    lines = layout.break_lines(text, 7000)
    assert "".join(text[a:b] for a, b in lines) == text.replace("\n", "")


def test_pagination(spark):
    rows = [(1, 0, 0, False, [40.0]), (1, 0, 1, False, [40.0, 40.0]), (1, 0, 2, True, [10.0]), (1, 0, 3, False, [250.0]), (1, 0, 4, False, [1.0]), (1, 1, 0, False, [1.0])]
    df = spark.createDataFrame(rows, "doc_id long, section long, block long, breaks boolean, parts array<double>")
    got = [(r["section"], r["block"], r["page"]) for r in layout.paginate(df, 100.0).orderBy("section", "block").collect()]
    assert got == [(0, 0, 1), (0, 1, 1), (0, 2, 3), (0, 3, 3), (0, 4, 4), (1, 0, 5)]


def test_grid_coverage(spark):
    cells = spark.createDataFrame([(1, 0, 0, 2, 1), (1, 0, 1, 1, 2), (1, 1, 0, 1, 1)], "doc_id long, row long, ord long, row_span long, col_span long")
    placed = {(r["row"], r["ord"]): r["col"] for r in grid.place_spans(cells).collect()}
    assert placed == {(0, 0): 0, (0, 1): 1, (1, 0): 1}
    widths = spark.createDataFrame([(1, 0, 1, 100.0), (1, 1, 2, 300.0), (1, 1, 1, 120.0), (1, 3, 1, 0.0)], "doc_id long, col long, col_span long, width double")
    assert {r["col"]: r["width"] for r in grid.derive_widths(widths).collect()} == {0: 100.0, 1: 120.0, 2: 180.0, 3: 1800.0}


def test_edits(spark):
    df = spark.createDataFrame([("가나다", 1), ("ab", 5)], "t string, k int").select(edit.insert_text(F.col("t"), F.col("k"), F.lit("x\x01")).alias("i"), edit.delete_range(F.col("t"), F.lit(1), F.lit(2)).alias("d"), edit.delete_range(F.col("t"), F.lit(2), F.lit(1)).alias("r"))
    assert [tuple(r) for r in df.collect()] == [("가x나다", "가다", None), (None, "a", None)]
    moves = spark.range(5).select(edit.reindex_move(F.col("id"), F.lit(1), F.lit(4)).alias("m"), edit.reindex_move(F.col("id"), F.lit(3), F.lit(0)).alias("n"), edit.reindex_move(F.col("id"), F.lit(1), F.lit(2)).alias("same")).collect()
    assert [r["m"] for r in moves] == [0, 3, 1, 2, 4] and [r["n"] for r in moves] == [1, 2, 3, 0, 4] and [r["same"] for r in moves] == list(range(5))


def test_history_floor(spark):
    steps = spark.createDataFrame([(1, i, 60) for i in range(10)], "doc_id long, seq long, bytes long")
    assert sorted(r["seq"] for r in edit.retained_history(steps, budget=100, floor=4).collect()) == [6, 7, 8, 9]
    assert sorted(r["seq"] for r in edit.retained_history(steps, budget=0, limit=2, floor=4).collect()) == [8, 9]


def test_intents(spark):
    rows = [('{"intent":"Undo"}', "ok"), ('{"intent":"Undo","x":1}', "unknown_field"), ('{"intent":"Nope"}', "unknown_intent"), ('{"intent":"Undo","intent_version":1}', "newer_version"), ('{"intent":"Undo","intent_version":-1}', "bad_version"), ('{"intent_version":0,"intent":"Redo"}', "ok"), ("[1]", "not_object"), ("{", "not_object")]
    got = [r["status"] for r in intents.decode_intents(spark.createDataFrame([(i, j) for i, (j, _) in enumerate(rows)], "i int, json string")).orderBy("i").collect()]
    assert got == [s for _, s in rows]


def test_hit_tests(spark):
    boxes = spark.createDataFrame([(1, 1, 0.0, 0.0, 10.0, 10.0), (1, 2, 0.0, 0.0, 100.0, 40.0), (1, 3, 0.0, 60.0, 5.0, 5.0)], "page long, box long, x double, y double, w double, h double")
    points = spark.createDataFrame([(1, 1, 5.0, 5.0), (2, 1, 500.0, 52.0), (3, 2, 0.0, 0.0)], "probe long, page long, px double, py double")
    assert {r["probe"]: r["box"] for r in spatial.block_at(points, boxes).collect()} == {1: 1, 2: 3}
    assert {r["probe"]: r["box"] for r in spatial.cell_at(points, boxes).collect()} == {1: 1}


def test_styles(spark):
    runs = spark.createDataFrame([(1, " 7 "), (2, "-7"), (3, "x"), (4, None), (5, "99")], "i int, ref string")
    pool = spark.createDataFrame([(7, 3)], "xml_id long, idx long")
    assert {r["i"]: r["idx"] for r in style.resolve_pool(runs, "ref", pool).collect()} == {1: 3, 2: 0, 3: 0, 4: 0, 5: 0}
    used = spark.createDataFrame([(1, 160)] * 8 + [(1, 100)] * 2, "doc_id long, spacing long")
    tight = spark.createDataFrame([(1, 130)] * 3 + [(1, 120)] * 3, "doc_id long, spacing long")
    row = style.spacing_collapse(used, tight).first()
    assert row["applied"] and row["target"] == 120


def test_selection_order(spark):
    a = spark.createDataFrame([("x", 5), ("y", 1)], "key string, ord long")
    b = spark.createDataFrame([("z", 0), ("x", 0)], "key string, ord long")
    assert [r["key"] for r in selection.union_selection(a, b).orderBy("side", "ord").collect()] == ["y", "x", "z"]
    assert {r["key"] for r in selection.toggle_selection(a, b).collect()} == {"y", "z"}


def test_profile(spark):
    df = paras(spark, "  □ one ", "body", "■ " + "x" * 50)
    heads = profile.outline(df)
    assert [r["title"] for r in heads.collect()] == ["□ one"]
    assert profile.titles(df, heads).first()["title"] == "□ one"


def test_roster_and_fill(spark):
    values = spark.createDataFrame([("name: 홍길동\r\nphone : 010-1-2\nname: last:one\nnothing",)], "t string").select(fill.roster_rows(F.col("t")).alias("v")).first()["v"]
    assert values == {"name": "last:one", "phone": "010-1-2"}
    roster = spark.createDataFrame([(1, {"k": "x"}), (2, {})], "row_no long, values map<string,string>")
    actions = fill.fill_actions(roster, [{"key": "k", "required": True, "pinned": True, "spec": "number"}])
    assert {r["row_no"]: r["reason"] for r in actions.collect()} == {1: "format_mismatch", 2: "missing_required"}
    assert not fill.fill_report(actions, strict=True).where("created").count()


def test_packages(spark):
    good = sinks.package([["가 & <b>", "two"], ["three"]])
    files = spark.createDataFrame([("good", bytearray(good)), ("bad", bytearray(b"PK\x03\x04 broken"))], "path string, content binary")
    rows = packages.read_blocks(files, "hwpx").collect()
    assert [(r["section"], r["block"], r["text"]) for r in rows if r["path"] == "good"] == [(0, 0, "가 & <b>"), (0, 1, "two"), (1, 0, "three")]
    assert [r["error"] is not None for r in rows if r["path"] == "bad"] == [True]
    assert [r["f"] for r in files.select(detect("content").alias("f")).collect()] == ["hwpx", "unknown"]


def test_package_limits(monkeypatch):
    monkeypatch.setitem(packages.LIMITS, "inflated_bytes", 100)
    with pytest.raises(packages.LimitError, match="inflated_bytes"):
        list(packages.hwpx_rows(sinks.package([["x" * 5000]])))
    monkeypatch.setitem(packages.LIMITS, "entries", 1)
    with pytest.raises(packages.LimitError, match="entries"):
        packages.Package(sinks.package([["x"]]))


def test_sections_sort_as_text():
    package = packages.Package(sinks.package([[str(i)] for i in range(11)]))
    assert package.sections()[2] == "Contents/section10.xml"


def test_decode_text(spark):
    df = spark.createDataFrame([(bytearray("한글".encode()),), (bytearray("한글".encode("euc_kr")),)], "c binary")
    assert [r["t"] for r in df.select(packages.decode_text(F.col("c")).alias("t")).collect()] == ["한글", "한글"]


def test_chart_svg():
    from quire.operators.charts import bar_chart

    svg = bar_chart(pd.DataFrame({"name": ["a<b", "c"], "value": [1.0, 3.0]}))
    assert svg.count("<rect") == 2 and "a&lt;b" in svg


def test_line_breaking_of_long_words_and_of_batches(spark):
    """A word without a break is not read to its end for each of its lines, and paragraphs of a batch are summed together."""
    began = time.perf_counter()
    lines = layout.break_lines("x" * 60_000, 1000.0)
    assert lines == [(k, k + 2) for k in range(0, 60_000, 2)] and time.perf_counter() - began < 10
    rows = [(1, 0, 0, "aa bb cc"), (1, 0, 1, None), (1, 0, 2, "한글).한"), (2, 0, 0, "ab\ncd"), (2, 0, 1, "")]
    got = layout.line_breaks(spark.createDataFrame(rows, "doc_id long, section long, block long, text string"), 2500.0)
    found = {(r["doc_id"], r["block"]): [tuple(x) for x in r["lines"]] for r in got.collect()}
    assert found == {(1, 0): [(0, 3), (3, 8)], (1, 1): [(0, 0)], (1, 2): [(0, 4), (4, 5)], (2, 0): [(0, 2), (3, 5)], (2, 1): [(0, 0)]}


def test_tables_of_lines_are_dealt_out_once(spark, sf_dir):
    """Cells, their rows and slots lie by their orders; no cell is sorted."""
    for name in ("cell_text_first", "uncovered_columns"):
        plan = registry.QUERIES[name](spark, sf_dir)._jdf.queryExecution().executedPlan().toString()
        deals = set(re.findall(r"Exchange (hashpartitioning\([a-z_]+)", plan))
        assert len(deals) == 1 and "SortAggregate" not in plan and "Join" not in plan, (name, deals)


def test_uncovered_columns_of_tables_without_a_key(spark):
    cells = spark.createDataFrame([(1, 0, 0, 2, True), (1, 1, 1, 1, True), (1, 1, 2, 1, False), (None, 0, 0, 1, True)], "doc_id long, row long, col long, col_span long, active boolean")
    got = grid.uncovered_columns(cells, grid.table_sizes(cells)).collect()
    assert sorted(tuple(r) for r in got if r["doc_id"]) == [(1, 0, 2), (1, 1, 0), (1, 1, 2)]
    assert [tuple(r) for r in got if not r["doc_id"]] == [(None, 0, 0)]  # as in SQL, null equals nothing
