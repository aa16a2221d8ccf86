"""Near-dedup: large groups of alike texts give few pairs to test, and none that is similar is left out."""

import random

import numpy as np
from pyspark.sql import functions as F

from quire.llm import jaccard
from quire.llm import op3_simhash as op
from quire.llm.components import components


def test_pairs_of_texts_that_only_share_a_part_are_ruled_out_where_they_meet(spark):
    rng = random.Random(3)
    word = lambda: f"w{rng.randrange(10**6)}"
    shared = [word() for _ in range(90)]
    texts = [shared + [word() for _ in range(rng.randrange(40, 60))] for _ in range(120)]
    texts += [[*t[:-2], word(), word()] for t in texts[::10]]
    sets = [{tuple(t[i : i + 5]) for i in range(len(t) - 4)} for t in texts]
    alike = {(i, j) for j in range(len(sets)) for i in range(j) if len(sets[i] & sets[j]) >= 0.8 * len(sets[i] | sets[j])}
    df = spark.createDataFrame([(i, i, " ".join(t)) for i, t in enumerate(texts)], "node long, root long, text string")
    for block in (16, 2048):
        got = [(r["u"], r["v"]) for r in jaccard.candidates(df, len(texts), shingle_words=5, similarity=0.8, block=block).collect()]
        assert len(alike) >= 12 and alike <= set(got) and len(got) == len(set(got)) < 3 * len(alike)


def test_bitmaps_of_many_pairs_differ_as_those_of_one_do():
    rng = np.random.default_rng(4)
    sizes = [0, 1, 64, 65, 130, 700, 701, 3000]
    maps = [*jaccard.bitmaps(rng.integers(0, 1 << 63, sum(sizes)).astype(np.uint64), np.cumsum([0, *sizes])), None]
    x, y = (a.ravel() for a in np.indices((9, 9)))
    want = [0 if maps[i] is None or maps[j] is None else jaccard.apart(maps[i], maps[j]) for i, j in zip(x.tolist(), y.tolist(), strict=True)]
    assert jaccard.all_apart(maps, x, y).tolist() == want


def test_a_group_of_near_fingerprints_gives_few_links(spark):
    """A centre and all that differ from it in one or two bits; each cell gives a forest, and cells give the same links."""
    fps = [0] + [1 << i for i in range(64)] + [1 << i | 1 << j for i in range(64) for j in range(i)]
    nodes = spark.createDataFrame([(f - (1 << 64) if f >> 63 else f, i, 7) for i, f in enumerate(fps)], "fingerprint long, node long, sketch long")
    found = op.links(nodes, radius=9, segments=5, least=3, spare=jaccard.SPARE, ball=0).distinct().cache()
    assert found.count() < 4 * len(fps)
    assert components(found).agg(F.count("*"), F.max("root")).first() == (len(fps), 0)


def test_the_nearest_of_other_groups_come_first_and_are_few(spark):
    """Each text of a large group gives one pair at most, to the text whose bitmap differs least."""
    rng = random.Random(8)
    base = [f"w{i}" for i in range(160)]
    texts = []
    for _ in range(90):
        own = list(base)
        own[rng.randrange(5, 155)] = f"x{rng.randrange(10**6)}"
        texts.append(own)
    df = spark.createDataFrame([(i, i, " ".join(t)) for i, t in enumerate(texts)], "node long, root long, text string")
    every = {(r["u"], r["v"]) for r in jaccard.candidates(df, len(texts), shingle_words=5, similarity=0.8).collect()}
    few = {(r["u"], r["v"]) for r in jaccard.candidates(df, len(texts), shingle_words=5, similarity=0.8, nearest=True).collect()}
    assert few and few <= every and len(few) <= len(texts) and len(every) > 10 * len(texts)
