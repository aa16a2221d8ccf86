import hashlib
import re
from collections import defaultdict

import pytest

from quire.llm import op6_decontamination as op


def words(text):
    lower = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lower)


def brute(docs, items, n=10):
    windows = defaultdict(set)
    for i, t in items:
        w = words(t)
        for k in range(max(1, len(w) - n + 1) if w else 0):
            windows[tuple(w[k : k + n])].add(i)
    out = []
    for i, t in docs:
        w, hit, found = words(t), set(), set()
        for size in {len(x) for x in windows}:
            for k in range(len(w) - size + 1):
                if (own := tuple(w[k : k + size])) in windows:
                    hit |= set(range(k, k + size))
                    found |= windows[own]
        ids = sorted(str(x) for x in found if x is not None)
        out.append((i, len(w), len(hit), len(ids), hashlib.sha256(",".join(ids).encode()).hexdigest()))
    return sorted(out, key=str)


def got(df):
    return sorted(((r["doc_id"], r["n_words"], r["n_hit"], len(r["items"]), hashlib.sha256(",".join(r["items"]).encode()).hexdigest()) for r in df.collect()), key=str)


def test_whole_table(spark, sf_dir):
    docs = [tuple(r) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").collect()]
    items = [tuple(r) for r in spark.read.parquet(f"{sf_dir}/benchmark.parquet").select("item_id", "text").collect()]
    result = op.op6_decontamination(spark, sf_dir).collect()
    assert sorted(((r["doc_id"], r["n_words"], r["n_hit"], r["n_items"], r["items_sha256"]) for r in result), key=str) == brute(docs, items)
    assert all(r["contaminated"] == (r["n_hit"] > 0) for r in result)
    joined = op.find_contamination(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/benchmark.parquet"), broadcast_bytes=0)
    assert got(joined) == brute(docs, items)
    spans = lambda df: sorted((r["doc_id"], str(r["hit_spans"])) for r in df.select("doc_id", "hit_spans").collect())
    assert spans(joined) == spans(op.find_contamination(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/benchmark.parquet")))


@pytest.mark.parametrize("broadcast_bytes", [1 << 20, 200])
def test_odd_rows(spark, broadcast_bytes):
    items = [(1, "One two THREE"), (10, "a b c d e f g h i j k"), (2, "b c d e f g h i j k"), (3, None), (4, "!!"), (None, "zz"), (10, "a b c d e f g h i j k"), (5, "é漢 x")]
    docs = [(1, None), (2, ""), (3, "x one. Two -- three one two"), (3, "x one. Two -- three one two"), (4, "A b c d e f g h i j k l"), (None, "zz é漢 X"), (5, "word " * 20000 + "one two three"), (6, "one\ntwo"), (7, "three one two three")]
    d = spark.createDataFrame([(*r, 1) for r in docs], "doc_id long, text string, n_hit int")
    b = spark.createDataFrame([(*r, "x") for r in items], "item_id long, text string, doc_id string")
    assert got(op.find_contamination(d, b, broadcast_bytes=broadcast_bytes)) == brute(docs, items)
    assert got(op.find_contamination(d.limit(0), b)) == [] and got(op.find_contamination(d, b.limit(0))) == brute(docs, [])


def test_removal(spark):
    d = spark.createDataFrame([(1, "keep é One, two; three! end"), (2, "clean"), (3, None)], "doc_id long, text string")
    b = spark.createDataFrame([(1, "one two three")], "item_id long, text string")
    assert {r["doc_id"] for r in op.decontaminate(d, b).collect()} == {2, 3}
    spans = {r["doc_id"]: r["text"] for r in op.decontaminate(d, b, remove="spans").collect()}
    assert spans == {1: "keep é ! end", 2: "clean", 3: None}
    with pytest.raises(ValueError):
        op.decontaminate(d, b, remove="x")
