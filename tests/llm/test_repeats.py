import hashlib
import random
import re
from collections import Counter, defaultdict

import numpy as np
import pytest

from quire.llm import op4_substring, op10_suffix


def sha(b):
    return hashlib.sha256(b).hexdigest()


def brute_words(rows, window):
    out, first = [], defaultdict(set)
    words = [(i, re.findall(r"[^\x20\x09-\x0D]+", t or "")) for i, t in rows]
    for i, w in words:
        for k in range(len(w) - window + 1):
            first[tuple(w[k : k + window])].add(float("inf") if i is None else i)
    for i, w in words:
        gone = set()
        for k in range(len(w) - window + 1):
            if min(first[tuple(w[k : k + window])]) < (float("inf") if i is None else i):
                gone |= set(range(k, k + window))
        out.append((i, len(w), len(gone), sha(" ".join(x for k, x in enumerate(w) if k not in gone).encode())))
    return sorted(out, key=str)


def brute_bytes(rows, window):
    data = [(i, (t or "").encode()) for i, t in rows]
    count = Counter(b[k : k + window] for _, b in data for k in range(len(b) - window + 1))
    out = []
    for i, b in data:
        gone = np.zeros(len(b) + 2, bool)
        for k in range(len(b) - window + 1):
            if count[b[k : k + window]] > 1:
                gone[k + 1 : k + 1 + window] = True
        spans = int((np.diff(gone.astype(int)) == 1).sum())
        out.append((i, len(b), int(gone.sum()), spans, sha(bytes(x for x, g in zip(b, gone[1:], strict=False) if not g))))
    return sorted(out, key=str)


def texts(seed, n=60):
    rng = random.Random(seed)
    vocabulary = ["the", "of", "é", "漢字", "x", "yy", "zzz", "a" * 30]
    passage = " ".join(rng.choice(vocabulary) for _ in range(40))
    out = []
    for i in range(n):
        t = " ".join(rng.choice(vocabulary) for _ in range(rng.randint(0, 60)))
        if rng.random() < 0.4:
            cut = rng.randint(0, 30)
            t = f"{t} {passage[cut:]} {t[: rng.randint(0, 40)]}"
        if rng.random() < 0.2:
            t = "\t\n".join([rng.choice(vocabulary)] * rng.randint(1, 90))
        out.append((i, t))
    out += [(100 + i, out[i * 3][1] + rng.choice(["", " end"])) for i in range(12)]
    out += [(200, None), (201, ""), (None, out[3][1]), (None, out[3][1]), out[5], out[7], (7, "other words " * 30)]
    rng.shuffle(out)
    return out


def rows_of(df, *names):
    return sorted((tuple(r[n] for n in names) for r in df.collect()), key=str)


def words_result(df, **options):
    return sorted(((r["doc_id"], r["n_words"], r["n_removed"], sha(r["kept"].encode())) for r in op4_substring.remove_repeated_words(df, **options).collect()), key=str)


def bytes_result(df, **options):
    return sorted(((r["doc_id"], r["n_bytes"], r["n_removed"], len(r["spans"]), sha(bytes(r["kept"]))) for r in op10_suffix.find_repeated(df, **options).collect()), key=str)


@pytest.mark.parametrize("seed", [1, 2])
@pytest.mark.parametrize("window", [5, 12])
def test_words_agree_with_brute_force(spark, seed, window):
    rows = texts(seed)
    df = spark.createDataFrame([(i, t, 1, "x") for i, t in rows], "doc_id long, text string, kind int, row_key string")
    assert words_result(df, window=window) == brute_words(rows, window)


@pytest.mark.parametrize("seed", [3, 4])
@pytest.mark.parametrize("window", [9, 40])
def test_bytes_agree_with_brute_force(spark, seed, window):
    rows = texts(seed)
    df = spark.createDataFrame([(i, t, 1, "x") for i, t in rows], "doc_id long, text string, spans int, row_key string")
    assert bytes_result(df, window=window) == brute_bytes(rows, window)


def brute_word_spans(rows, window):
    """Removed bytes of each row where windows of words found anywhere else go, with the spaces inside runs of such words."""
    words = [[(m.start(), m.end(), m[0]) for m in re.finditer(rb"[^\x20\x09-\x0D]+", (t or "").encode())] for _, t in rows]
    count = Counter(tuple(x for _, _, x in w[k : k + window]) for w in words for k in range(len(w) - window + 1))
    out = []
    for (i, t), w in zip(rows, words, strict=True):
        covered = {k + j for k in range(len(w) - window + 1) if count[tuple(x for _, _, x in w[k : k + window])] > 1 for j in range(window)}
        raw, gone = (t or "").encode(), set()
        for k in covered:
            gone |= set(range(w[k][0], w[k + 1][0] if k + 1 in covered else w[k][1]))
        out.append((i, len(raw), len(gone), sha(bytes(x for k, x in enumerate(raw) if k not in gone))))
    return sorted(out, key=str)


@pytest.mark.parametrize("block", [1, 300, op10_suffix.BLOCK])
def test_word_windows_and_hot_anchors(spark, block):
    rows = texts(5, 120)
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert bytes_result(df, window=20, block=block) == brute_bytes(rows, 20)
    got = op10_suffix.find_repeated(df, window=6, unit="words", block=block).collect()
    assert sorted(((r["doc_id"], r["n_bytes"], r["n_removed"], sha(bytes(r["kept"]))) for r in got), key=str) == brute_word_spans(rows, 6)


@pytest.mark.parametrize("classes, block", [(10, op10_suffix.BLOCK), (201, 2000), (201, op10_suffix.BLOCK), (3000, 2000), (3000, op10_suffix.BLOCK)])
def test_a_passage_in_many_surroundings(spark, classes, block):
    """Its ends stand in as many different cells as there are texts; some share surroundings of several lengths."""
    rng = random.Random(classes)
    passage = "".join(rng.choice("abcdefgh ") for _ in range(90))
    shared = ["".join(rng.choice("pqrst") for _ in range(40)) for _ in range(5)]
    rows = []
    for i in range(classes):
        before, after = (rng.choice(shared)[rng.randint(0, 39) :] if rng.random() < 0.3 else "" for _ in range(2))
        rows.append((i, f"{rng.random()}{before}{passage[rng.randint(0, 3) :]}{after[::-1]}{rng.random()}"))
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert bytes_result(df, window=40, block=block) == brute_bytes(rows, 40)


def test_words_whose_sums_collide_are_told_apart(spark):
    """A Thue-Morse word and its complement have equal polynomial sums modulo 2**64 whatever the base."""
    thue = "".join("ab"[bin(i).count("1") % 2] for i in range(2048))
    head = " ".join(f"word{i}" for i in range(49))
    rows = [(1, f"{head} {thue}"), (2, f"{head} {thue.translate(str.maketrans('ab', 'ba'))}")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert words_result(df) == brute_words(rows, 50) and all(r[2] == 0 for r in words_result(df))
    assert bytes_result(df) == brute_bytes(rows, 400)
    assert bytes_result(df, window=600) == brute_bytes(rows, 600)


def test_columns_that_clash_with_the_results(spark):
    rows = texts(8)
    own = ["_starts", "_left_id", "_right_id", "_key", "_text", "id", "anchor", "n_bytes", "kept"]
    df = spark.createDataFrame([(i, t, *["own"] * len(own)) for i, t in rows], f"doc_id long, text string, {', '.join(f'{c} string' for c in own)}")
    assert bytes_result(df, window=20) == brute_bytes(rows, 20)
    assert all(r["_starts"] == r["_right_id"] == r["anchor"] == "own" for r in op10_suffix.find_repeated(df, window=20).collect())
    assert words_result(df, window=5) == brute_words(rows, 5)


def test_one_very_long_word(spark):
    rows = [(1, "x" * 3_000_000), (2, "x" * 500), (3, None)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert words_result(df, window=1)[1][2] == 0
    assert [r[2] for r in bytes_result(df)] == [3_000_000, 500, 0]


def test_empty_table(spark):
    df = spark.createDataFrame([], "doc_id long, text string")
    assert words_result(df) == [] and bytes_result(df) == []


def test_whole_tables(spark, sf_dir):
    rows = [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()]
    assert rows_of(op4_substring.op4_substring(spark, sf_dir), "doc_id", "n_words", "n_removed", "kept_sha256") == brute_words(rows, 50)
    assert rows_of(op10_suffix.op10_suffix(spark, sf_dir), "doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256") == brute_bytes(rows, 400)


def test_remove_repeated_keeps_columns(spark):
    rows = texts(6)
    df = spark.createDataFrame([(i, t, k, "src", "x") for k, (i, t) in enumerate(rows)], "doc_id long, text string, kept int, source string, spans string")
    out = op10_suffix.remove_repeated(df, window=40)
    assert out.columns == df.columns and out.count() == len(rows)
    whole = {k: t for k, (_, t) in enumerate(rows)}
    untouched = [r for r in out.collect() if r["text"] == whole[r["kept"]]]
    assert len(untouched) == sum(r[2] == 0 for r in brute_bytes(rows, 40))
