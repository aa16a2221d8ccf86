import zlib
from collections import Counter

import pytest

from quire.llm import op12_sharding as op

SCHEMA = "doc_id long, source string, text string, slot int, k string"


def check(rows, got, shards=op.SHARDS):
    """rows: (doc_id, source, text); the laws that every result must hold."""
    n = len(rows)
    assert Counter((r["doc_id"], r["size"], r["text_crc32"]) for r in got) == Counter((i, len((t or "").encode()) + 8, zlib.crc32((t or "").encode())) for i, _, t in rows)
    assert all(r["law"] == "rows" and r["grown_shard"] is None and 0 <= r["shard"] < shards for r in got)
    each = Counter(r["shard"] for r in got)
    assert max([0, *each.values()]) - min(each.get(k, 0) for k in range(shards)) <= 1 and sum(each.values()) == n
    for k in range(shards):
        assert sorted(r["slot"] for r in got if r["shard"] == k) == list(range(each[k]))


def mixture(rows, got, shards=op.SHARDS):
    source = {i: s for i, s, _ in rows}
    total, own = Counter(source.values()), Counter((source[r["doc_id"]], r["shard"]) for r in got)
    return max(abs(own[s, k] - n / shards) for s, n in total.items() for k in range(shards))


def by_hand(rows, seed=op.SEED, shards=op.SHARDS):
    """The same order by plain sorts."""
    import hashlib

    def digest(*v):
        return int(hashlib.md5("|".join("-" if x is None else f"={x}" for x in v).encode()).hexdigest()[:15], 16)

    groups = {}
    for i, s, t in rows:
        c = zlib.crc32((t or "").encode())
        groups.setdefault(s, []).append((digest(seed, i, c), i if i is not None else -1, c))
    places = [((k + (digest(seed, s) >> 40) / (1 << 20)) / len(own), s is not None, s or "", *x) for s, own in groups.items() for k, x in enumerate(sorted(own))]
    n, out = len(places), Counter()
    for pos, (*_, i, c) in enumerate(sorted(places)):
        shard = pos * shards // n
        out[None if i < 0 else i, c, shard, pos - -(-shard * n // shards)] += 1
    return out


def test_whole_table(spark, sf_dir):
    rows = [(r["doc_id"], r["source"], r["text"]) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()]
    got = op.op12_sharding(spark, sf_dir).collect()
    check(rows, got)
    assert mixture(rows, got) <= 2.5
    assert Counter((r["doc_id"], r["text_crc32"], r["shard"], r["slot"]) for r in got) == by_hand(rows)


@pytest.mark.parametrize("bucket", [1, 7, op.BUCKET])
def test_hot_source_odd_rows_and_any_bucket(spark, bucket):
    rows = [(i, "hot" if i % 3 else f"s{i % 50}", f"text {i % 5}" * (i % 4)) for i in range(900)]
    rows += [(None, None, None), (None, None, ""), (7, "", None), (5000, "é漢", "🙂" * 50), (5001, "one", "x"), (5002, None, "y")]
    rows += [(6000, "again", "copy")] * 40
    df = spark.createDataFrame([(*r, 1, "q") for r in rows], SCHEMA).repartition(5)
    got = op.assign(df, bucket=bucket)
    assert got.columns == ["doc_id", "source", "k", *op.RESULT]
    got = got.collect()
    check(rows, got)
    assert Counter((r["doc_id"], r["text_crc32"], r["shard"], r["slot"]) for r in got) == by_hand(rows)


def test_fewer_rows_than_shards_and_none(spark):
    df = spark.createDataFrame([(i, "a", "t") for i in range(5)], "doc_id long, source string, text string")
    check([(i, "a", "t") for i in range(5)], op.assign(df).collect())
    assert op.assign(df.limit(0)).collect() == []


def test_written_shards_hold_their_slots_in_order(spark, tmp_path):
    rows = [(i, f"s{i % 3}", f"text {i}") for i in range(200)]
    df = spark.createDataFrame(rows, "doc_id long, source string, text string")
    op.write_shards(df, str(tmp_path / "out"), shards=4, rows_per_file=20)
    back = spark.read.parquet(str(tmp_path / "out")).collect()
    assert {(r["doc_id"], r["text"]) for r in back} == {(i, t) for i, _, t in rows}
    want = {r["doc_id"]: (r["shard"], r["slot"]) for r in op.assign(df, shards=4).collect()}
    assert {r["doc_id"]: (r["shard"], r["slot"]) for r in back} == want


def test_main_path_is_native(spark, sf_dir, tmp_path):
    spark.sparkContext.setCheckpointDir(str(tmp_path))
    import inspect

    source = inspect.getsource(op)
    assert not any(x in source for x in ("udf", "InArrow", "InPandas", ".rdd", "toPandas"))
