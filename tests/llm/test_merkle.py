import hashlib
import zlib
from collections import Counter

import pytest
from pyspark.sql import functions as F

from quire.llm import op13_merkle as op

SCHEMA = "doc_id long, source string, lang string, n_chars int, text string, leaf string, g int"


def sha(x):
    return hashlib.sha256(x.encode()).hexdigest()


def enc(v):
    return "-" if v is None else f"{len(str(v).encode())}:{v}"


def lower(t):
    return t and "".join(c.lower() if "A" <= c <= "Z" else c for c in t)


def brute(rows, arity=16):
    """rows: (doc_id, source, lang, n_chars, text); a Counter of result rows."""

    def tree(leaves):
        levels = [leaves]
        while len(levels[-1]) > 1:
            levels.append([sha("".join(levels[-1][k : k + arity])) for k in range(0, len(levels[-1]), arity)])
        return levels

    def path(levels, k):
        for level in levels[:-1]:
            a = k // arity * arity
            yield level[a:k], level[k + 1 : a + arity]
            k //= arity

    groups = {}
    for r in rows:
        leaf = sha("".join(map(enc, r)))
        bad = r[0] is not None and zlib.crc32(str(r[0]).encode()) % 5 == 0
        groups.setdefault(r[1], []).append((r[0] is not None, r[0] or 0, leaf, sha("".join(map(enc, [*r[:4], lower(r[4])]))) if bad else leaf))
    names = sorted(groups, key=lambda s: (s is not None, (s or "").encode()))
    trees = {s: tree([x[2] for x in sorted(groups[s])]) for s in names}
    top = tree([trees[s][-1][0] for s in names])
    out = Counter()
    for i, s in enumerate(names):
        for k, (there, doc, leaf, now) in enumerate(sorted(groups[s])):
            sides = [*path(trees[s], k), *path(top, i)]
            for before, after in sides:
                now = sha("".join(before) + now + "".join(after))
            out[doc if there else None, leaf, trees[s][-1][0], top[-1][0], sha("".join("".join(b) + "".join(a) for b, a in sides)), now, now == top[-1][0]] += 1
    return out


def tampered():
    return F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 0


def rows_of(df):
    return Counter(tuple(r) for r in df.select("doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified").collect())


def test_whole_table(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select(*op.FIELDS)
    assert rows_of(op.op13_merkle(spark, sf_dir)) == brute([tuple(r) for r in docs.collect()])


@pytest.mark.parametrize("block, group", [(op.BLOCK, op.GROUP), (16, 20), (5, 1)])
def test_hot_source_odd_rows_and_any_dealing(spark, block, group):
    rows = [(i * 7 % 1013, "hot" if i % 3 else f"s{i % 40}", ["en", None][i % 2], i, f"Text {i}" * (i % 3)) for i in range(600)]
    rows += [(None, None, None, None, None), (None, None, "a", 1, "B"), (4, None, "x", 0, ""), (9001, "", "x", 1, "Ä Z"), (9002, "one", "x", 1, "X:1-"), (9003, "漢", "x", 1, None)]
    rows += [(9100, "again", "en", 4, "Copy")] * 20
    df = spark.createDataFrame([(*r, "q", 1) for r in rows], SCHEMA).repartition(5)
    assert rows_of(op.manifest(df, tampered=tampered(), block=block, group=group)) == brute(rows)


@pytest.mark.parametrize("n", [1, 2, 16, 17, 257])
def test_one_source_of_n(spark, n):
    rows = [(i, "a", "en", 1, f"T{i}") for i in range(n)]
    df = spark.createDataFrame(rows, "doc_id long, source string, lang string, n_chars long, text string")
    assert rows_of(op.manifest(df, tampered=tampered())) == brute(rows)
    assert rows_of(op.manifest(df.limit(0))) == Counter()


def test_proofs_fold_to_the_root_and_other_arities(spark):
    rows = [(i, f"s{i % 3}", "en", 1, f"T{i}") for i in range(50)]
    df = spark.createDataFrame(rows, "doc_id long, source string, lang string, n_chars long, text string")
    for arity, block in ((3, 9), (2, 5)):
        got = op.manifest(df, arity=arity, block=block, group=10, proofs=True)
        assert rows_of(got.withColumn("verified", F.col("folded_root") == F.col("root"))) == Counter({k[:5] + (k[3], True): v for k, v in brute(rows, arity).items()})
        assert all(sha("".join(r["proof"])) == r["proof_sha256"] for r in got.collect())


def test_multiproof_asks_for_the_least(spark):
    """Every node asked for is used, and none could be derived."""
    import numpy as np

    rng = np.random.default_rng(5)
    for n in (1, 5, 16, 40, 300, 5000):
        leaves = np.unique(rng.integers(0, n, 1 + n // 9))
        got = {(level, k) for level, ks in enumerate(op.missing(leaves, n, 4)) for k in ks.tolist()}
        sizes, over = op.counts_up(n, 4), {(0, int(k)) for k in leaves}
        for level in range(len(sizes)):
            over |= {(level + 1, k // 4) for lv, k in over if lv == level}
        need = {(level, k) for lv, own in over for level in [lv] if lv < len(sizes) - 1 for k in range(own // 4 * 4, min(sizes[level], own // 4 * 4 + 4))}
        assert got == need - over
