import hashlib
import re

import numpy as np
import public_tokenizers
import pytest
import tiktoken

import corpus_pipeline as pipeline
from quire.llm import op1_toxicity as op1
from quire.llm.op6_decontamination import normal_words
from quire.llm.op7_byte_bpe import read_ranks


@pytest.fixture(scope="module")
def stages(spark, sf_dir):
    out = [spark.read.parquet(f"{sf_dir}/documents.parquet").toPandas()]
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for _, f in pipeline.STAGES:
        docs = f(spark, docs, sf_dir)
        frame = docs.toPandas()
        docs = spark.createDataFrame(frame, docs.schema)
        out.append(frame)
    return out


def test_columns_and_rows(stages):
    for before, after in zip(stages[:-2], stages[1:-1], strict=True):
        assert list(after.columns) == list(stages[0].columns)
        assert set(after.doc_id) <= set(before.doc_id) and after.doc_id.is_unique
    assert len(stages[-1]) == len(stages[-2])


def test_toxicity_stage_drops_what_it_predicts(spark, sf_dir, stages):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    net = op1.fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    kept = {r["doc_id"] for r in op1.score(docs, net).where("score < 0.5").collect()}
    assert kept == set(stages[1].doc_id)


def test_near_dedup_drops_only_near_copies(stages):
    def shingles(t):
        w = t.lower().split()
        return {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))}

    kept = set(stages[2].doc_id)
    sets = {i: shingles(t) for i, t in zip(stages[1].doc_id, stages[1].text, strict=True)}
    for i, own in sets.items():
        if i not in kept:
            assert max(len(own & sets[j]) / len(own | sets[j]) for j in sets if j < i) > 0.5
    exact = stages[1].groupby("text").doc_id.min()
    assert kept <= set(exact)


def test_suffix_stage_agrees_with_brute_force(stages):
    from collections import Counter

    words = {i: [(m.start(), m.end(), m[0]) for m in re.finditer(rb"[^\x20\x09-\x0D]+", t.encode())] for i, t in zip(stages[2].doc_id, stages[2].text, strict=True)}
    count = Counter(tuple(x for _, _, x in w[k : k + 50]) for w in words.values() for k in range(len(w) - 49))
    before = dict(zip(stages[2].doc_id, stages[2].text, strict=True))
    got = dict(zip(stages[3].doc_id, stages[3].text, strict=True))
    for i, w in words.items():
        b = before[i].encode()
        covered = {k + j for k in range(len(w) - 49) if count[tuple(x for _, _, x in w[k : k + 50])] > 1 for j in range(50)}
        gone = np.zeros(len(b), bool)
        for k in covered:  # a run of removed words goes with the spaces in it
            gone[w[k][0] : w[k + 1][0] if k + 1 in covered else w[k][1]] = True
        assert got[i] == bytes(x for x, g in zip(b, gone, strict=True) if not g).decode()


def test_decontamination_stage(spark, sf_dir, stages):
    windows = set()
    for r in spark.read.parquet(f"{sf_dir}/benchmark.parquet").collect():
        w = normal_words(r["text"])
        windows |= {tuple(w[i : i + 10]) for i in range(max(1, len(w) - 9) if w else 0)}
    sizes = {len(w) for w in windows}
    clean = set()
    for i, t in zip(stages[3].doc_id, stages[3].text, strict=True):
        w = normal_words(t)
        if not any(tuple(w[k : k + n]) in windows for n in sizes for k in range(len(w) - n + 1)):
            clean.add(i)
    assert clean == set(stages[4].doc_id)


def test_last_stage_agrees_with_tiktoken(stages):
    own = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=read_ranks(public_tokenizers.path("byte_bpe_multi_50k.tiktoken")), special_tokens={})
    texts = dict(zip(stages[4].doc_id, stages[4].text, strict=True))
    for r in stages[5].itertuples():
        ids = own.encode_ordinary(texts[r.doc_id])
        assert (r.n_tokens, r.ids_sha256, r.decoded_sha256) == (len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), hashlib.sha256(texts[r.doc_id].encode()).hexdigest())


def test_run_gives_the_same(spark, sf_dir, stages):
    got = {tuple(r) for r in pipeline.run(spark, sf_dir).select("doc_id", "n_tokens", "ids_sha256").collect()}
    assert got == {(r.doc_id, r.n_tokens, r.ids_sha256) for r in stages[5].itertuples()}
