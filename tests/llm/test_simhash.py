import re

import numpy as np
import pytest
import xxhash

from quire.llm import op3_simhash as op


def lower(text):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")


def brute_fingerprint(text, k=4):
    words = re.findall(r"[^\x20\x09-\x0D]+", lower(text))
    shingles = [" ".join(words[i : i + k]) for i in range(max(1, len(words) - k + 1))] if words else []
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << i for i in range(64) if sum(h >> i & 1 for h in hashes) * 2 > len(hashes))


def brute_components(ids, fps, radius):
    fps, ids = np.array(fps, np.uint64), np.array(ids)
    label = ids.copy()
    near = [np.flatnonzero(np.bitwise_count(fps ^ f) <= radius) for f in fps]
    while True:
        new = np.array([label[n].min() for n in near])
        if (new == label).all():
            return dict(zip(ids.tolist(), label.tolist(), strict=True))
        label = new


def test_whole_table(spark, sf_dir):
    rows = spark.read.parquet(f"{sf_dir}/documents.parquet").collect()
    got = {r["doc_id"]: r for r in op.op3_simhash(spark, sf_dir).collect()}
    fps = {r["doc_id"]: brute_fingerprint(r["text"]) for r in rows}
    assert {k: f"{v:016x}" for k, v in fps.items()} == {k: r["fingerprint"] for k, r in got.items()}
    assert brute_components(list(fps), list(fps.values()), 4) == {k: r["component_id"] for k, r in got.items()}
    assert len(got) == len(rows)


@pytest.mark.parametrize(("radius", "segments", "block"), [(4, 3, 8), (4, 2, 2048), (7, 4, 5), (1, 3, 3), (0, 2, 2048)])
def test_links_connect_all_near_pairs(spark, radius, segments, block):
    rng = np.random.default_rng(radius)
    centres = rng.integers(0, 1 << 63, 12, dtype=np.uint64)
    fps = set()
    for c in centres:
        for _ in range(25):
            f = int(c)
            for b in rng.integers(0, 64, rng.integers(0, radius + 3)):
                f ^= 1 << int(b)
            fps.add(f)
    fps = sorted(fps)
    nodes = spark.createDataFrame([(int(np.uint64(f).astype(np.int64)), i, 0) for i, f in enumerate(fps)], "fingerprint long, node long, sketch long")
    links = op.links(nodes, radius=radius, segments=segments, block=block).collect()
    assert all(bin(fps[r["u"]] ^ fps[r["v"]]).count("1") <= radius for r in links)
    from quire.llm.components import components

    found = {i: i for i in range(len(fps))} | {r["u"]: r["root"] for r in components(spark.createDataFrame([(r["u"], r["v"]) for r in links] or [(0, 0)], "u long, v long")).collect()}
    assert found == brute_components(range(len(fps)), fps, radius)


def test_chain_components(spark):
    from quire.llm.components import components

    links = spark.createDataFrame([(i, i + 1) for i in range(40)] + [(100, 101), (101, 100), (7, 7)], "u long, v long")
    got = {r["u"]: r["root"] for r in components(links).collect()}
    assert got == {i: 0 for i in range(41)} | {100: 100, 101: 100}
    assert components(spark.createDataFrame([], "u long, v long")).count() == 0


def test_odd_rows(spark):
    rows = [(1, None), (2, ""), (3, " \t"), (None, "a b c d e"), (4, "a b c d e"), (4, "a b c d e"), (5, "word " * 30000), (6, "A B C D E")]
    df = spark.createDataFrame([(i, t, "x", 1.0) for i, t in rows], "doc_id long, text string, fingerprint string, component_id double")
    got = {(r["doc_id"], r["fingerprint"], r["component_id"]) for r in op.near_duplicates(df).collect()}
    signed = lambda t: int(np.uint64(brute_fingerprint(t)).astype(np.int64))
    assert got == {(1, 0, 1), (2, 0, 1), (3, 0, 1), (None, signed("a b c d e"), None), (4, signed("a b c d e"), 4), (6, signed("a b c d e"), 4), (5, signed("word " * 30000), 5)}
    assert op.near_duplicates(df.limit(0)).count() == 0


def test_keep_one_of_near_copies(spark):
    import random

    rng = random.Random(3)
    words = [f"w{i}" for i in range(3000)]
    base = [" ".join(rng.choice(words) for _ in range(300)) for _ in range(12)]
    rows = [(i, t) for i, t in enumerate(base)]
    rows += [(100 + i, t) for i, t in enumerate(base[:4])]
    rows += [(200 + i, t + " one more") for i, t in enumerate(base[4:8])]
    rows += [(300, None), (None, base[0]), (9, base[9])]
    df = spark.createDataFrame([(*r, "x") for r in rows], "doc_id long, text string, fingerprint string")
    kept = op.keep_one(df)
    assert kept.columns == df.columns
    assert sorted((r["doc_id"] is None, r["doc_id"] or 0) for r in kept.collect()) == [(False, i) for i in range(12)] + [(False, 300), (True, 0)]


def test_keep_one_links_all_pairs_of_the_similarity(spark):
    import random

    rng = random.Random(5)
    common = [f"c{i}" for i in range(40)]
    texts = []
    for _ in range(60):
        base = [f"w{rng.randrange(4000)}" for _ in range(rng.randrange(30, 200))]
        texts.append(base)
        for _ in range(3):
            own = list(base)
            for _ in range(rng.randrange(1, 2 + len(own) // 35)):
                own[rng.randrange(len(own))] = f"x{rng.randrange(10**6)}"
            texts.append(own)
    texts = [" ".join(t + common if rng.random() < 0.5 else t) for t in texts]
    rng.shuffle(texts)
    sets = [{tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} for w in (t.split() for t in texts)]
    alike = np.array([[len(a & b) >= 0.8 * len(a | b) for b in sets] for a in sets])
    label = np.arange(len(texts))
    while not (label == (new := np.array([label[row].min() for row in alike]))).all():
        label = new
    assert alike.sum() > len(texts) + 60
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    for block in (16, 2048):
        assert {r["doc_id"] for r in op.keep_one(df, block=block).collect()} == set(label.tolist())


def test_bitmaps_never_rule_out_what_is_near():
    """They differ in no more bits than the sets do in members, and tell most unlike sets apart."""
    from quire.llm import jaccard

    rng = np.random.default_rng(9)
    sets = [rng.integers(0, 1 << 63, n).astype(np.uint64) for n in (0, 1, 5, 63, 64, 65, 300, 1000, 5000)]
    sets += [np.concatenate([s[: len(s) * 9 // 10], rng.integers(0, 1 << 63, len(s) // 20).astype(np.uint64)]) for s in sets]
    sets = [np.unique(s) for s in sets]
    maps = jaccard.bitmaps(np.concatenate(sets), np.cumsum([0, *map(len, sets)]))
    for i, a in enumerate(sets):
        for j, b in enumerate(sets):
            differ = len(np.setxor1d(a, b))
            assert jaccard.apart(maps[i], maps[j]) <= differ
            if min(len(a), len(b)) >= 300 and differ > len(a) and 0.8 < len(a) / len(b) < 1.25:
                assert jaccard.apart(maps[i], maps[j]) > (len(a) + len(b)) / 9


def test_one_star_of_many_links(spark):
    """A centre with half of all links; components are those of union by hand."""
    from quire.llm.components import components

    links = [(5000, i) for i in range(2000)] + [(i, i + 1) for i in range(10000, 12000)]
    got = {r["u"]: r["root"] for r in components(spark.createDataFrame(links, "u long, v long").repartition(7)).collect()}
    assert all(got[i] == 0 for i in (*range(2000), 5000)) and all(got[i] == 10000 for i in range(10000, 12001))
