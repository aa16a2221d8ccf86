"""Saved sections: what is edited changes, and no other byte."""

import io
import random
import re
import zipfile

from quire.operators import patches as P
from quire.sources import packages
from quire.sources.sinks import package

SECTIONS = "doc_id bigint, section bigint, xml binary"


def p(k, body, name="hp:p", ref="0"):
    return f'<{name} id="{k}" paraPrIDRef="{ref}">{body}</{name}>'


def run(text, ref="0"):
    return f'<hp:run charPrIDRef="{ref}"><hp:t>{text}</hp:t></hp:run>'


def saved(spark, xml, edits, new=None):
    sections = spark.createDataFrame([(1, 0, xml.encode()), (2, 0, xml.encode())], SECTIONS)
    rows = [(1, 0, *(e.get(c) for c in ("kind", "ord", "runs", "para_ref", "page_break", "xml"))) for e in edits]
    more = spark.createDataFrame(new, f"doc_id bigint, section bigint, seq int, runs {P.RUNS}, para_ref string") if new else None
    after, done = P.save(sections, spark.createDataFrame(rows, P.EDIT), more)
    got = {r["doc_id"]: bytes(r["xml"]).decode() for r in after.collect()}
    assert got[2] == xml
    return got[1], {(r["kind"], r["ord"]): r["status"] for r in done.collect()}


TABLE = '<hp:run><hp:tbl a=">"><hp:tr><hp:tc><hp:subList>' + p(7, run("in")) + p(8, run("next")) + "</hp:subList></hp:tc></hp:tr></hp:tbl></hp:run>"
XML = "<?xml version='1.0'?>\n<hs:sec><!-- <hp:p>no</hp:p> -->" + p(0, run("é漢")) + p(1, run("b") + "<hp:linesegarray><hp:lineseg/></hp:linesegarray>") + p(2, TABLE) + "<hp:p/>" + p(5, run("<![CDATA[<hp:p>]]>")) + "\n</hs:sec>\n"


def test_adjacent_and_nested(spark):
    text = [("3", "x & <y>"), (None, "")]
    got, status = saved(spark, XML, [{"kind": "p", "ord": 0, "runs": text}, {"kind": "p", "ord": 1, "runs": [], "para_ref": "4", "page_break": True}, {"kind": "p", "ord": 2, "para_ref": "9"}, {"kind": "p", "ord": 3, "runs": [("1", "new")]}, {"kind": "p", "ord": 9, "runs": []}, {"kind": "p", "ord": 5, "para_ref": "a$1\\"}])
    want = XML.replace(p(0, run("é漢")), p(0, run("x &amp; &lt;y&gt;", "3") + run("")))
    want = want.replace('<hp:p id="1" paraPrIDRef="0">' + run("b") + "<hp:linesegarray><hp:lineseg/></hp:linesegarray>", '<hp:p id="1" paraPrIDRef="4" pageBreak="1">' + run(""))
    want = want.replace('<hp:p id="2" paraPrIDRef="0">', '<hp:p id="2" paraPrIDRef="9">').replace(p(7, run("in")), p(7, run("new", "1"))).replace("<hp:p/>", '<hp:p paraPrIDRef="a$1\\"/>')
    assert got == want
    assert status == {("p", 0): "ok", ("p", 1): "ok", ("p", 2): "ok", ("p", 3): "ok", ("p", 9): "no_element", ("p", 5): "ok"}


def test_a_table_covers_what_is_in_it(spark):
    got, status = saved(spark, XML, [{"kind": "tbl", "ord": 0, "xml": "<hp:tbl/>"}, {"kind": "p", "ord": 3, "runs": [("1", "new")]}, {"kind": "p", "ord": 2, "runs": [("1", "lost")]}, {"kind": "p", "ord": 6, "runs": [("0", "c")]}])
    assert got == re.sub(r"<hp:tbl a=.*</hp:tbl>", "<hp:tbl/>", XML).replace(p(5, run("<![CDATA[<hp:p>]]>")), p(5, run("c")))
    assert status == {("tbl", 0): "ok", ("p", 3): "covered", ("p", 2): "structural", ("p", 6): "ok"}


def test_new_paragraphs_come_last(spark):
    got, _ = saved(spark, XML, [{"kind": "p", "ord": 6, "runs": [("0", "c")]}], [(1, 0, 2, [("0", "second")], None), (1, 0, 1, [("2", "first")], "5")])
    tail = lambda k, ref, body: f'<hp:p id="{k}" paraPrIDRef="{ref}" styleIDRef="0" pageBreak="0" columnBreak="0" merged="0">{body}</hp:p>'
    assert got.endswith("\n" + tail(9, "5", run("first", "2")) + tail(10, "0", run("second")) + "</hs:sec>\n")


def test_random_sections(spark):
    """Edits of any set of paragraphs, against a replacement by hand of numbered marks."""
    rng = random.Random(4)

    def body(depth):
        out = []
        for _ in range(rng.randint(1, 4)):
            k = next(ids)
            if depth and rng.random() < 0.4:
                out.append((k, "<hp:run><hp:tbl><hp:tc>", body(depth - 1), "</hp:tc></hp:tbl></hp:run>"))
            else:
                out.append((k, run(f"t{k}"), None, ""))
        return out

    def text(paras, edits):
        return "".join(f'<hp:p paraPrIDRef="{edits.get(k, (0, 0))[1]}">' + (run("new") if inner is None and k in edits and edits[k][0] else a) + (text(inner, edits) if inner else "") + z + "</hp:p>" for k, a, inner, z in paras)

    sections, rows, want = [], [], {}
    for d in range(20):
        ids = iter(range(1000))
        paras = body(3)
        count = next(ids)
        edits = {k: (rng.random() < 0.7, rng.randint(0, 9)) for k in range(count) if rng.random() < 0.4}
        sections.append((d, 0, f"<s>{text(paras, {})}</s>".encode()))
        flat = {}

        def walk(ps, flat=flat):
            for k, _, inner, _ in ps:
                flat[k] = inner
                walk(inner or [])

        walk(paras)
        rows += [(d, 0, "p", k, [("0", "new")] if body_ else None, str(ref), None, None) for k, (body_, ref) in edits.items()]
        want[d] = f"<s>{text(paras, {k: v for k, v in edits.items() if not (v[0] and flat[k])})}</s>"
    after, _ = P.save(spark.createDataFrame(sections, SECTIONS), spark.createDataFrame(rows, P.EDIT))
    assert {r["doc_id"]: bytes(r["xml"]).decode() for r in after.collect()} == want


def test_packages_keep_their_other_parts(spark):
    made = package([["one", "two"], ["three"]])
    files = spark.createDataFrame([(1, made), (2, made)], "doc_id bigint, content binary")
    sections = P.read_sections(files)
    edits = spark.createDataFrame([(1, 0, "p", 1, [("0", "TWO")], None, None, None), (1, 1, "p", 0, [("0", "3")], None, None, None)], P.EDIT)
    after, done = P.save(sections, edits)
    changed = after.join(done.where("status = 'ok'").select("doc_id", "section").distinct(), ["doc_id", "section"], "left_semi")
    out = P.write_back(files, changed)
    got = {r["doc_id"]: bytes(r["content"]) for r in out.collect()}
    assert got[2] == made
    a, b = zipfile.ZipFile(io.BytesIO(made)), zipfile.ZipFile(io.BytesIO(got[1]))
    assert [(i.filename, i.compress_type) for i in a.infolist()] == [(i.filename, i.compress_type) for i in b.infolist()]
    assert all(a.read(n) == b.read(n) for n in a.namelist() if "section" not in n)
    rows = packages.read_blocks(out.selectExpr("cast(doc_id as string) path", "content"), "hwpx").orderBy("path", "section", "block").collect()
    assert [r["text"] for r in rows] == ["one", "TWO", "3", "one", "two", "three"]


def test_no_edits(spark):
    got, status = saved(spark, XML, [])
    assert got == XML and status == {}
