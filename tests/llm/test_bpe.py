import hashlib
import random

import numpy as np
import public_tokenizers
import pytest
import tiktoken
from hypothesis import given, settings
from hypothesis import strategies as st

from quire.llm import op7_byte_bpe as op

PATH = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
RANKS = op.read_ranks(PATH)
REAL = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=RANKS, special_tokens={})


@pytest.fixture(scope="module")
def own():
    return op.ByteBpe(RANKS, public_tokenizers.PATTERN, cache=1000)


def ids(text):
    return np.array(REAL.encode_ordinary(text), "<u4").tobytes()


@settings(max_examples=300, deadline=None)
@given(st.text(max_size=80))
def test_any_text(text):
    own = op.codec(RANKS, public_tokenizers.PATTERN, "test")
    assert own.encode(text) == ids(text) and own.decode(own.encode(text)) == text.encode()


def test_awkward_texts(own):
    rng = random.Random(1)
    letters = "aé ß\t\n\x1c\x1d\x85\xa0 漢字🙂😀'sSdt1２½#$% ZZ한국어\x00"
    texts = ["", " ", "  x", "don't 're'LL", "<|endoftext|><|im_start|>", "a" * 5000, "x\n\n \n y"] + ["".join(rng.choice(letters) for _ in range(rng.randint(0, 60))) for _ in range(2000)]
    for t in texts:
        assert own.encode(t) == ids(t) and own.decode(own.encode(t)) == t.encode()


def test_other_vocabulary():
    ranks = op.read_ranks(public_tokenizers.path("byte_bpe_50k.tiktoken"))
    real = tiktoken.Encoding("two", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    own = op.ByteBpe(ranks, public_tokenizers.PATTERN)
    for t in ("Hello world, it's 2024!", "naïve 漢字"):
        assert np.frombuffer(own.encode(t), "<u4").tolist() == real.encode_ordinary(t)
    with pytest.raises(ValueError):
        op.serialise_model({b"a": 0, b"b": 2})


def test_whole_table(spark, sf_dir):
    texts = {r["doc_id"]: r["text"] or "" for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()}
    for r in op.op7_byte_bpe(spark, sf_dir).collect():
        t = texts.pop(r["doc_id"])
        assert (r["n_tokens"], r["ids_sha256"], r["decoded_sha256"]) == (len(ids(t)) // 4, hashlib.sha256(ids(t)).hexdigest(), hashlib.sha256(t.encode()).hexdigest())
    assert not texts


def test_encode_then_decode(spark):
    rows = [(1, None), (2, ""), (3, "x y é🙂"), (3, "x y é🙂"), (None, "z" * 70000)]
    df = spark.createDataFrame([(*r, "q") for r in rows], "doc_id long, text string, decoded string")
    coded = op.encode(df, PATH, public_tokenizers.PATTERN)
    back = op.decode(coded, PATH, public_tokenizers.PATTERN).collect()
    assert sorted((str(r["doc_id"]), bytes(r["decoded"])) for r in back) == sorted((str(i), (t or "").encode()) for i, t in rows)
    assert all(r["n_tokens"] == len(r["token_ids"]) for r in back)
    assert op.encode(df.limit(0), PATH, public_tokenizers.PATTERN).count() == 0
