import re
from collections import Counter

import numpy as np
import pytest

from quire.llm import op11_divergence as op

SCHEMA = "doc_id long, text string, lang string, source string, value int, place string"


def brute(rows, least=10):
    """rows: (text, lang, source)."""
    groups, docs = {}, {}
    for text, lang, source in rows:
        lower = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
        words = Counter(re.findall(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", lower))
        groups.setdefault(lang or "", {}).setdefault(source or "", Counter()).update(words)
        docs.setdefault(lang or "", Counter()).update(words.keys())
    out = set()
    for lang, own in groups.items():
        kept = [t for t, n in docs[lang].items() if n >= least]
        v = len(kept)

        def shares(c, kept=kept, v=v):
            total = sum(c[t] for t in kept)
            return {t: 1 + 10**9 * (c[t] + 2) // (total + 2 * v) for t in kept}

        p = {s: shares(c) for s, c in own.items()}
        q = shares(sum(own.values(), Counter()))

        def price(a, b):
            return (a - b) ** 2 // (a + b)

        for s in own:
            found = [(-sum(price(p[s][t], p[o][t]) for t in kept), o.encode(), o) for o in own if o != s]
            out |= {(lang, s, "pair", o, -f, k + 1) for k, (f, _, o) in enumerate(sorted(found))}
            found = [(-price(p[s][t], q[t]), t.encode(), t) for t in kept if own[s][t] > 0 and p[s][t] > q[t]]
            out |= {(lang, s, "term", t, -f, k + 1) for k, (f, _, t) in enumerate(sorted(found)[:10])}
    return out


def rows_of(df):
    got = [tuple(r) for r in df.select("lang", "source", "part", "item", "value", "rank").collect()]
    assert len(got) == len(set(got))
    return set(got)


def test_whole_table(spark, sf_dir):
    rows = [tuple(r) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").select("text", "lang", "source").collect()]
    assert rows_of(op.op11_divergence(spark, sf_dir)) == brute(rows)


def made(n, seed, sources):
    rng = np.random.default_rng(seed)
    words = [f"w{chr(97 + i % 26)}{chr(97 + i // 26)}" for i in range(200)] + ["É", "漢字", "ß🙂"]
    zipf = 1 / np.arange(1, len(words) + 1)
    return [(" ".join(rng.choice(words, rng.integers(0, 40), p=zipf / zipf.sum())), ["en", "de"][i % 5 == 0], "hot" if i % 3 else f"s{i // 3 % sources}") for i in range(n)]


@pytest.mark.parametrize("block", [1, 3, 50, op.BLOCK])
def test_hot_source_odd_rows_and_any_block(spark, block, monkeypatch):
    rows = made(500, 1, 12)
    rows += [(None, None, None), ("", "", ""), ("A-b_C'd 1e2 \x00Z", None, "x"), ("rare", "xx", "a"), (None, "xx", "b"), ("t " * 3000, "en", "long"), ("t", "lone", "only")] + [("Same copy", "en", "copies")] * 60
    df = spark.createDataFrame([(i, *r, 1, "q") for i, r in enumerate(rows)], SCHEMA).repartition(6)
    assert rows_of(op.audit(df, block=block)) == brute(rows)


def test_more_sources_than_a_tile_and_small_steps(spark, monkeypatch):
    rows = made(900, 2, 90)
    df = spark.createDataFrame([(i, *r, 1, "q") for i, r in enumerate(rows)], SCHEMA).repartition(6)
    assert len({s for _, lang, s in rows if lang == "en"}) > op.SIDE
    assert rows_of(op.audit(df, least_docs=3, block=64)) == brute(rows, 3)
    assert op.audit(df.limit(0)).count() == 0


def test_equal_subtrees_are_one_node_and_equal_pairs_are_walked_once():
    counts = np.zeros((3, 64), np.int64)
    counts[1, ::4], counts[2, 5:7] = 3, 9
    forest = op.Forest(counts)
    assert [len(x) for x in forest.pairs] == [4, 3, 3, 3, 3, 3]  # of 96, 48, 24, 12, 6 and 3 places
    a, b = np.array([0, 0, 1]), np.array([1, 2, 2])
    who, x, y, times = forest.leaf_pairs(a, b)
    for k in range(3):
        want = Counter(zip(counts[a[k]].tolist(), counts[b[k]].tolist(), strict=True))
        got = list(zip(x[who == k].tolist(), y[who == k].tolist(), times[who == k].tolist(), strict=True))
        assert len(got) == len(want) and {(i, j): n for i, j, n in got} == want


@pytest.mark.parametrize("width", [1, 2, 3, 7, 33, 100])
def test_walks_of_any_width(width):
    counts = np.random.default_rng(width).integers(0, 3, (5, width))
    forest = op.Forest(counts)
    a, b = np.triu_indices(5, 1)
    who, x, y, times = forest.leaf_pairs(a, b)
    got = {(k, i, j): n for k, i, j, n in zip(who.tolist(), x.tolist(), y.tolist(), times.tolist(), strict=True)}
    assert got == Counter((k, i, j) for k in range(len(a)) for i, j in zip(counts[a[k]].tolist(), counts[b[k]].tolist(), strict=True))


def test_shares_are_exact():
    big = np.array([0, 1, 10**14, 3 * 10**15], np.int64)
    for total, kept in ((3 * 10**15, 10**9), (10**14 * 31, 7), (5, 1)):
        assert op.shares(big[big <= total], total, kept).tolist() == [1 + 10**9 * (c + 2) // (total + 2 * kept) for c in big.tolist() if c <= total]
