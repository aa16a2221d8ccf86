import zlib

import numpy as np
import pyarrow as pa

from quire.llm import grams
from quire.llm import op1_toxicity as op
from quire.llm.op6_decontamination import normal_words


def planted(n, seed):
    rng = np.random.default_rng(seed)
    letters = np.random.default_rng(0)
    vocabulary = ["".join(letters.choice(list("aeioulnrst"), 5)) for _ in range(300)]
    texts, labels = [], []
    for i in range(n):
        w = [vocabulary[k] for k in rng.integers(0, 300, rng.integers(5, 150))]
        if i % 4 == 0:
            w[rng.integers(0, len(w))] = rng.choice(["beastly", "vile", f"grrr{vocabulary[rng.integers(0, 300)]}"])
        texts.append(" ".join(w))
        labels.append(int(i % 4 == 0))
    return texts, labels


def scores(net, texts):
    return np.concatenate([net.scores(op.tokenise(d, o)) for _, d, o in grams.chunks(pa.array(texts, pa.string()))])


def test_held_out_accuracy_on_planted_words():
    net = op.train(*planted(800, 1))
    texts, labels = planted(400, 2)
    assert ((scores(net, texts) >= 0.5) == np.array(labels)).mean() > 0.97


def test_gradients_agree_with_differences():
    texts, labels = planted(6, 3)
    data, offsets = grams.texts(pa.array(texts))
    t = op.tokenise(data, offsets)
    start, length, text = op.windows_of(t.first)
    net = op.Network()
    net.p = {k: v.astype(np.float64) for k, v in net.p.items()}
    y, w = np.array(labels)[text], np.ones(len(text))

    def loss():
        z = net.layers(np.concatenate([net.vectors(t), np.zeros((1, op.WIDTH))])[net.window_words(t, start, length)[0]] @ net.p["Wx"] + net.p["bx"], net.window_words(t, start, length)[1])
        return float(np.mean(np.logaddexp(0, z) - y * z))

    found = net.gradients(t, start, length, y, w)
    rng = np.random.default_rng(0)
    for name, value in net.p.items():
        places = np.flatnonzero(found[name].ravel())
        for k in rng.choice(places, min(4, len(places)), replace=False):
            flat, eps = value.reshape(-1), 1e-3
            before = flat[k]
            flat[k] = before + eps
            up = loss()
            flat[k] = before - eps
            down = loss()
            flat[k] = before
            assert abs((up - down) / (2 * eps) - found[name].ravel()[k]) < 1e-3 + 0.05 * abs(found[name].ravel()[k]), name


def test_windows_cover_all_words_and_overlap():
    first = np.array([0, 0, 1, 33, 65, 200])
    start, length, text = op.windows_of(first)
    for k in range(5):
        own = [(s, s + n) for s, n, t in zip(start, length, text, strict=True) if t == k]
        assert own and set().union(*(range(a, b) for a, b in own)) == set(range(first[k], first[k + 1]))


def test_whole_table(spark, sf_dir):
    got = op.op1_toxicity(spark, sf_dir).collect()
    assert len(got) == spark.read.parquet(f"{sf_dir}/documents.parquet").count()
    for r in got:
        assert r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0)
        assert 0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.5)


def test_held_out_labels_teach_nothing(spark):
    texts, labels = planted(120, 5)
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    truth = spark.createDataFrame([(i, y) for i, y in enumerate(labels)], "doc_id long, toxic int")
    lies = spark.createDataFrame([(i, 1 - y if zlib.crc32(str(i).encode()) % 5 == 0 else y) for i, y in enumerate(labels)], "doc_id long, toxic int")
    a, b = op.fit(docs, truth), op.fit(docs, lies)
    assert all(np.array_equal(a.p[k], b.p[k]) for k in a.p) and a.offset == b.offset


def test_odd_rows(spark):
    docs = spark.createDataFrame([(1, None, 5), (2, "", 5), (None, "x", 5), (3, "word " * 40000, 5), (3, "word " * 40000, 5)], "doc_id long, text string, score int")
    for rows in ([], [(1, 1)], [(1, None), (None, 1), (9, 0)]):
        net = op.fit(docs, spark.createDataFrame(rows, "doc_id long, toxic int"))
        assert all(0 <= r["score"] <= 1 for r in op.score(docs, net).collect())
    assert op.score(docs.limit(0), op.Network()).count() == 0


def plain_score(net, text):
    """The score of a text by loops over words and windows, one at a time."""
    p, h, sigmoid = net.p, op.HIDDEN, lambda x: 1 / (1 + np.exp(-x))
    words = normal_words(text)
    starts = sorted({min(k, max(0, len(words) - op.WINDOW)) for k in range(0, max(1, len(words) - op.WINDOW + op.STRIDE), op.STRIDE)})
    vector = {w: net.vectors(op.tokenise(np.frombuffer(w, np.uint8), np.array([0, len(w)])))[0].astype(float) for w in set(words)}
    logits = []
    for s in starts:
        window = words[s : s + op.WINDOW]
        states = np.zeros((max(1, len(window)), 2 * h))
        for side, u in ((0, p["Uf"]), (1, p["Ub"])):
            now = np.zeros(h)
            for t in range(len(window)) if side == 0 else range(len(window) - 1, -1, -1):
                g = (vector[window[t]] @ p["Wx"] + p["bx"])[side * 3 * h : (side + 1) * 3 * h]
                z, r = (sigmoid(g[k * h : (k + 1) * h] + (now @ u)[k * h : (k + 1) * h]) for k in (0, 1))
                now = z * now + (1 - z) * np.tanh(g[2 * h :] + r * (now @ u)[2 * h :])
                states[t, side * h : (side + 1) * h] = now
        a = np.exp(np.tanh(states @ p["Wa"] + p["ba"]) @ p["va"])
        logits.append((a / a.sum()) @ states @ p["wo"] + p["bo"][0])
    return sigmoid(max(logits) * net.scale + net.offset)


def test_scores_agree_with_a_plain_forward_pass(spark):
    net = op.train(*planted(200, 3), rounds=1)
    texts = ["one", "a b c", "word " * 32, " ".join(f"w{i}" for i in range(33)), " ".join(f"v{i % 7} Ünï" for i in range(60)), planted(3, 4)[0][0], "x " * 47 + "kill"]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    for r in op.score(df, net).collect():
        assert abs(r["score"] - plain_score(net, r["text"])) < 1e-4, r["text"]


def test_fitted_in_a_task_as_on_the_driver(spark, sf_dir):
    docs, labels = spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/labels.parquet")
    rows = sorted(op.labelled_sample(docs, labels, "toxic", per_class=op.PER_CLASS, learn=~op.held_out()).collect(), key=lambda r: r["doc_id"])
    own, net = op.train([r["text"] for r in rows], [r["label"] for r in rows]), op.fit(docs, labels)
    texts = [r["text"] for r in rows]
    assert own.p.keys() == net.p.keys() and all(own.p[k].shape == net.p[k].shape for k in own.p)
    # sums of floats depend on the number of threads of the linear algebra library, so weights are near, not equal
    assert np.mean((scores(own, texts) >= 0.5) == (scores(net, texts) >= 0.5)) >= 0.97
