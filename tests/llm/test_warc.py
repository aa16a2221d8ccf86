import base64
import hashlib
from collections import defaultdict

from quire.llm import op5_warc as op
from quire.llm.common import new_dir


def brute(rows):
    best = defaultdict(set)
    for p, _, h in rows:
        best[h or ""].add(p)
    out = []
    for p, _, h in rows:
        raw, ids = (h or "").encode(), {x for x in best[h or ""] if x is not None}
        top = max(ids) if ids and sum((x[2] or "") == (h or "") for x in rows) > 1 else None
        refers = top if top is not None and p != top else None
        out.append((p, len(raw), base64.b32encode(hashlib.sha1(raw).digest()).decode(), "response" if refers is None else "revisit", refers))
    return sorted(out, key=str)


def got(df):
    return sorted(((r["page_id"], r["payload_bytes"], r["payload_digest"], r["record_type"], r["refers_to"]) for r in df.collect()), key=str)


def test_whole_table(spark, sf_dir):
    rows = [tuple(r) for r in spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", "url", "html").collect()]
    assert got(op.op5_warc(spark, sf_dir)) == brute(rows)


def test_odd_rows_and_payloads(spark):
    rows = [(1, "http://A.example.com/x y", "<p>é</p>\r\n\r\nWARC/1.1"), (2, None, None), (3, "", ""), (None, "http://a.b/", "same"), (4, "http://a.b/", "same"), (4, "http://a.b/", "same"), (-5, "http://a.b/", "same"), (6, "//user@www.C.d:80?q#f", "z" * 300000), (None, None, "alone")]
    rows += [(100 + i, "http://hot.example/", f"body {i % 3}") for i in range(50)]
    df = spark.createDataFrame([(*r, 1) for r in rows], "page_id long, url string, html string, payload int")
    at = new_dir(spark, "warc")
    entries = op.write_archives(df, at)
    files = op.write_index(entries, at, block_entries=4)
    back = op.read_captures(df, at, files)
    assert got(back) == brute(rows)
    payloads = {(r["page_id"], r["payload_digest"]): bytes(r["payload"]) for r in back.collect() if r["record_type"] == "response"}
    assert payloads[1, op.payload_digest(rows[0][2].encode())] == rows[0][2].encode()
    assert got(op.read_captures(df.where("page_id = 6"), at, files)) == [x for x in brute(rows) if x[0] == 6]
    assert got(op.read_captures(spark.createDataFrame([(9, "http://nowhere/")], "page_id long, url string"), at, files)) == []
    empty = op.archive(df.limit(0), new_dir(spark, "warc"))
    assert empty == [] and got(op.read_captures(df, at, empty)) == []


def test_small_payloads_are_all_responses(spark):
    df = spark.createDataFrame([(1, "u", "ab"), (2, "u", "ab"), (3, "u", "abcdef"), (4, "u", "abcdef")], "page_id long, url string, html string")
    at = new_dir(spark, "warc")
    kinds = {r["page_id"]: r["record_type"] for r in op.read_captures(df, at, op.archive(df, at, revisit_bytes=4)).collect()}
    assert kinds == {1: "response", 2: "response", 3: "revisit", 4: "response"}


def test_url_key():
    assert op.url_key("HTTPS://www.Example.COM:443/A/b?x=1#f") == "com,example)/a/b?x=1"
    assert op.url_key("http://example.com") == "com,example)/" and op.url_key(None) == ""


def test_half_of_all_pages_are_one_page(spark, tmp_path):
    """A digest with half of the rows: one response, all others revisit it; nothing is lost."""
    rows = [(i, f"http://h{i % 7}.org/{i}", None if i % 4 == 0 else "" if i % 4 == 2 else f"<p>{i}</p>") for i in range(2000)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").repartition(5)
    at = f"file://{tmp_path}/half"
    got = {r["page_id"]: (r["record_type"], r["refers_to"]) for r in op.read_captures(pages, at, op.archive(pages, at)).collect()}
    assert got == {i: ("response", None) if i % 2 or i == 1998 else ("revisit", 1998) for i in range(2000)}
