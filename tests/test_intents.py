"""Intent envelopes: what is refused and why."""

import json

import pytest

from quire.operators.intents import INTENTS, decode_intents

CELL = {"intent": "SetTableCellRuns", "section": 0, "index": 0, "row": 1, "col": 1}
PARA = {"intent": "InsertParagraphAt", "section": 0, "runs": []}
CHART = {"intent": "InsertChartAt", "section": 0}
CASES = [
    ({"intent": "Undo"}, "ok"),
    ({"intent": "Undo", "x": 1}, "unknown_field"),
    ({"intent": "SetImageSize", "section": 0}, "missing_field"),
    ({"intent": "Render", "page": "x"}, "bad_type"),
    ({"intent": "Render", "page": -1}, "bad_type"),
    ({"intent": "Render", "page": 1.5}, "bad_type"),
    ({"intent": "Render", "page": None}, "bad_type"),
    ({"intent": "Render", "page": 4294967295}, "ok"),
    ({"intent": "Render", "page": 4294967296}, "bad_type"),
    ({"intent": "HitTest", "page": 1, "x": 1, "y": 2.5}, "ok"),
    (CELL | {"runs": [{"text": "a", "bold": True}]}, "ok"),
    (CELL | {"runs": [{"text": "a"}, {"bolt": True}], "path": None}, "bad_type"),
    (CELL | {"runs": [{"text": "a", "bold": None}]}, "bad_type"),
    (CELL | {"runs": [{"size_pt": None, "color": "#FF0000"}, {}]}, "ok"),
    (CELL | {"runs": [None]}, "bad_type"),
    (CELL | {"runs": {}}, "bad_type"),
    (CELL | {"runs": [], "path": [{"block": 1, "row": 2, "col": 0}, {"block": 1, "row": 2}]}, "bad_type"),
    (CELL | {"runs": [], "path": [{"block": 1, "row": 2, "col": 0}]}, "ok"),
    (PARA | {"index": None}, "ok"),
    (PARA | {"para": {"alignment": "x"}}, "bad_type"),
    (PARA | {"para": None}, "bad_type"),
    (PARA | {"para": {"align": "left", "line_spacing_pct": 160, "indent_pt": -1.5}}, "ok"),
    ({"intent": "InsertTableAt", "section": 0, "rows": [[{"text": "a"}, {}], [], [{"row_span": 2}]]}, "ok"),
    ({"intent": "InsertTableAt", "section": 0, "rows": [[{"text": 1}]]}, "bad_type"),
    ({"intent": "InsertTableAt", "section": 0, "rows": [{"text": "a"}]}, "bad_type"),
    (CHART | {"chart": {"type": "bar", "categories": ["a"], "series": [{"name": "s", "values": [1, 2.5]}]}}, "ok"),
    (CHART | {"chart": {"type": "bar", "categories": ["a"], "series": [{"name": "s"}]}}, "bad_type"),
    (CHART | {"chart": {"type": "bar", "categories": ["a"], "series": [], "colour": 1}}, "bad_type"),
    ({"intent": "SetCharFmt", "section": 0, "block": 1, "cell": [1, 2], "bold": None}, "ok"),
    ({"intent": "SetCharFmt", "section": 0, "block": 1, "cell": [1, 2, 3]}, "bad_type"),
    ({"intent": "SetTableColWidths", "section": 0, "index": 1, "widths": [1, -2]}, "ok"),
    ({"intent": "SetTableColWidths", "section": 0, "index": 1, "widths": [1, "2"]}, "bad_type"),
    ({"intent": "SetTableColWidths", "section": 0, "index": 1, "widths": [1 << 31]}, "bad_type"),
    ({"path": "a"}, "no_intent"),
    ({"intent": 7}, "no_intent"),
    ({"intent": "Nope"}, "unknown_intent"),
    ([1], "not_object"),
    (None, "not_object"),
    ("Undo", "not_object"),
    ({"intent": "Undo", "intent_version": 0}, "ok"),
    ({"intent": "Undo", "intent_version": 1}, "newer_version"),
    ({"intent": "Undo", "intent_version": "0"}, "bad_version"),
    ({"intent": "Undo", "intent_version": -1}, "bad_version"),
    ({"intent": "Undo", "intent_version": None}, "bad_version"),
]


def test_what_is_refused(spark):
    rows = [(i, json.dumps(c), w) for i, (c, w) in enumerate(CASES)] + [(998, "{bro", "not_object"), (999, None, "not_object")]
    got = decode_intents(spark.createDataFrame(rows, "i int, json string, want string")).collect()
    assert [(r["json"], r["status"]) for r in got if r["status"] != r["want"]] == [] and len(got) == len(rows)


@pytest.mark.parametrize("fault", ["unknown_field", "missing_field", "bad_type", "ok"])
def test_every_intent(spark, fault):
    sample = {"text": "t", "bool": True, "size": 1, "u32": 1, "i32": -1, "float": 0.5, "pair": [0, 1], "[i32]": [1], "[Run]": [{"text": "x"}], "[Step]": [], "[[Cell]]": [[{}]], "Para": {}, "Chart": {"type": "pie", "categories": [], "series": []}}
    rows = []
    for name, spec in INTENTS.items():
        fields = [f.split(" ") for f in spec.split(", ") if f]
        own = {"intent": name} | {f: sample[k.rstrip("?!")] for f, k in fields}
        if fault == "unknown_field":
            own["where"] = 1
        elif fault == "missing_field":
            own.pop(next((f for f, k in fields if k[-1] not in "?!"), ""), None)
        elif fault == "bad_type" and fields:
            own[fields[-1][0]] = {"x": {}} if fields[-1][1][-1] != "]" else 5
        want = fault if fields or fault == "unknown_field" else "ok"
        rows.append((json.dumps(own), want))
    got = decode_intents(spark.createDataFrame(rows, "json string, want string")).collect()
    assert [(r["json"], r["status"]) for r in got if r["status"] != r["want"]] == []
