"""Text of page descriptions against a walk through their operations; files taken apart."""

import random
import zlib

import pytest

from quire.operators import glyphs as G
from quire.sources import pdf as P


def behind(text, at, shift):
    out, em = [], 0.0
    for k, ch in enumerate(text):
        em += sum(s for a, s in zip(at, shift, strict=True) if a == k)
        out.append(em)
        em += P.SPACE_EM if ch == " " else P.CHAR_EM
    return out


def walk(ops):
    """(seq, k, x, y, size, ch) of each character, one operation after another."""
    out, size, leading, line, x = [], G.SIZE, G.LEADING, [0.0, 0.0], 0.0
    for seq, (op, n, text, shifted, shift, advance) in enumerate(ops):
        at = lambda i: n[i] if i < len(n) else 0.0  # noqa: B023, E731
        if op == "Tf" and len(n) > 1:
            size = n[1]
        if op == "TL" and n:
            leading = n[0]
        if op == "TD":
            leading = -at(1)
        if op == "BT":
            line = [0.0, 0.0]
        elif op == "Tm" and len(n) == 6:
            line = n[4:]
        elif op in ("Td", "TD"):
            line = [line[0] + at(0), line[1] + at(1)]
        elif op in ("T*", "'", '"'):
            line = [line[0], line[1] - leading]
        if op in ("BT", "Td", "TD", "T*", "'", '"') or (op == "Tm" and len(n) == 6):
            x = line[0]
        out += [(seq, k, x + em * size, line[1], size, ch) for k, (ch, em) in enumerate(zip(text, behind(text, shifted, shift), strict=True))]
        x += advance * size
    return out


def stream(rng, length):
    number = lambda: rng.choice(["3", "-7", "0.5", "12.25", "+4", "-.5", "10."])
    text = lambda: rng.choice(["(ab c)", "(x\\)y)", "((in) side)", "()", "<41 2>", "(\\101\\n)", "(\xe9 )"])
    kinds = [
        lambda: "BT", lambda: "ET", lambda: f"/F1 {number()} Tf", lambda: "/F1 Tf", lambda: f"{number()} TL", lambda: "TL", lambda: f"{number()} {number()} Td", lambda: f"{number()} Td", lambda: f"{number()} {number()} TD",
        lambda: f"1 0 0 1 {number()} {number()} Tm", lambda: "1 2 3 Tm", lambda: "T*", lambda: f"{text()} Tj", lambda: f"{text()} '", lambda: f'1 2 {text()} "', lambda: f"[{text()} {number()} {text()} -120] TJ", lambda: "Tj", lambda: "5 Tj", lambda: "% BT (no) Tj\n",
        lambda: "q 1 0 0 rg /X gs Q", lambda: "/P << /MCID 0 /A [1 (Tj)] >> BDC", lambda: "BI /W 2 ID \x00(EIx Tj) EI",
    ]
    return " ".join(rng.choice(kinds)() for _ in range(length)).encode("latin-1")


@pytest.mark.parametrize("width", [1, 3, 7, G.WIDTH])
def test_glyphs_agree_with_a_walk(spark, width):
    rng = random.Random(width)
    pages = {k: stream(rng, n) for k, n in enumerate([0, 1, 5, 40, 90, 200])}
    df = spark.createDataFrame([*pages.items(), (99, None)], "page int, content binary").repartition(3)
    shows = G.placed_shows(P.text_operations(df, ["page"]), ["page"], width=width)
    got = {}
    for r in G.glyphs(shows, ["page"]).collect():
        got.setdefault(r.page, []).append((r.seq, r.k, r.x, r.y, r.size, r.ch))
    for page, data in pages.items():
        want = walk(list(P.text_rows(data)))
        found = sorted(got.get(page, []))
        assert [(w[0], w[1], w[5]) for w in want] == [(g[0], g[1], g[5]) for g in found]
        assert all(g[2:5] == pytest.approx(w[2:5]) for g, w in zip(found, want, strict=True))
    assert 99 not in got


def test_operations_by_hand():
    ops = list(P.operations(b"BT /F1 24 Tf 100 700 Td (Hello \\(P\\) (D)F\\\r\nx) Tj [(A) -120 <4>] TJ\nBI /W 1 ID (((EI EI ET % (gone\n1 0 (open"))
    assert ops[1] == ("Tf", ["F1", 24.0]) and ops[2] == ("Td", [100.0, 700.0])
    assert ops[3] == ("Tj", [b"Hello (P) (D)Fx"]) and ops[4] == ("TJ", [[b"A", -120.0, b"@"]])
    assert [op for op, _ in ops] == ["BT", "Tf", "Td", "Tj", "TJ", "BI", "ID", "ET"]
    (show,) = [r for r in P.text_rows(b"[(A ) -1000 (b)] TJ")]
    assert show[2:] == ("A b", [2], [1.0], pytest.approx(2.3))
    assert list(P.ems(*show[2:5])) == pytest.approx([0.0, 0.5, 1.8])


def file(objects, head=b"%PDF-1.5\n"):
    return head + b"".join(b"%d 0 obj\n%s\nendobj\n" % (n, body) for n, body in objects) + b"trailer << /Root 1 0 R >>"


def flat(body, data, packed=True, length=True):
    data = zlib.compress(data) if packed else data
    return b"<< %s %s %s >>\nstream\n%s\nendstream" % (body, b"/Filter /FlateDecode" if packed else b"", b"/Length %d" % len(data) if length else b"/Length 9 0 R", data)


HELLO = b"BT /F1 24 Tf 100 700 Td (Hello PDF) Tj ET"


def tree(page):
    return [(1, b"<< /Type /Catalog /Pages 2 0 R >>"), (2, b"<< /Type /Pages /Kids [3 0 R 4 0 R] /Count 2 /MediaBox [0 0 300 400] >>"), (3, page), (4, b"<</Type/Page/Parent 2 0 R/MediaBox 7 0 R/Contents[5 0 R 6 0 R]>>"), (7, b"[10 10 110 -90]")]


def test_files(spark):
    page = b"<< /Type /Page /Parent 2 0 R /Contents 5 0 R /Title (a \\) endobj) >>"
    streams = [(5, flat(b"", HELLO)), (6, flat(b"", b"T* (more) Tj", packed=False, length=False))]
    inner = b"3 0 4 %d " % (len(page) + 1)
    packed = [o for o in tree(page) if o[0] not in (3, 4)] + streams + [(8, flat(b"/Type /ObjStm /N 2 /First %d" % len(inner), inner + page + b" " + tree(page)[3][1]))]
    files = {
        "plain": file(tree(page) + streams), "packed": file(packed), "none": b"hello", "null": None, "no pages": file(streams),
        "loop": file([(1, b"<< /Type /Catalog /Pages 2 0 R >>"), (2, b"<< /Kids [2 0 R 3 0 R] >>"), (3, b"<< /Type /Page >>")]),
        "later": file(tree(page) + streams + [(5, flat(b"", b"BT (new) Tj"))]), "locked": file(tree(page) + streams) + b"<< /Encrypt 9 0 R >>", "filter": file(tree(page) + [(5, b"<< /Filter /LZWDecode /Length 2 >>\nstream\nab\nendstream")]),
    }
    read = P.read_pages(spark.createDataFrame(list(files.items()), "path string, content binary")).collect()
    got = {(r.path, r.page): (r.width, r.height, r.content and bytes(r.content)) for r in read if r.error is None}
    for name in ("plain", "packed"):
        assert got[name, 1] == (300.0, 400.0, HELLO)
        assert got[name, 2] == (100.0, 100.0, HELLO + b"\nT* (more) Tj")
    assert got["loop", 1] == (612.0, 792.0, b"") and ("loop", 2) not in got
    assert got["later", 1][2] == b"BT (new) Tj"
    errors = {r.path: r.error for r in read if r.error is not None}
    assert errors == {"none": "not a pdf", "null": "not a pdf", "no pages": "no pages", "locked": "encrypted", "filter": "filter LZWDecode"}


def test_text_and_paint(spark):
    page = b"<< /Type /Page /MediaBox [0 0 612 792] /Parent 2 0 R /Contents 5 0 R >>"
    files = spark.createDataFrame([("a", bytearray(file(tree(page) + [(5, flat(b"", HELLO)), (6, flat(b"", b"14 TL (low) ' T* (   ) Tj"))])))], "path string, content binary")
    lines = {(r.page, r.base, r.text) for r in G.pdf_text(files).collect()}
    assert lines == {(1, 700, "Hello PDF"), (2, 700, "Hello PDF"), (2, 686, "low")}
    pages = P.read_pages(files)
    placed = G.glyphs(G.placed_shows(P.text_operations(pages, ["path", "page"]), ["path", "page"]), ["path", "page"])
    first = G.painted(placed, pages, ["path", "page"]).where("page = 1 and k < 2").orderBy("k").collect()
    assert [(r.ch, r.x, r.y, r.size) for r in first] == [("H", 10000.0, 9200.0, 2400.0), ("e", 11200.0, 9200.0, 2400.0)]
