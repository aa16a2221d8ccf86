import re
from collections import Counter

from pyspark.sql import functions as F

from quire.llm import op9_quality as op


def brute(text):
    text = text or ""
    w = re.findall(r"[^\x20\x09-\x0D]+", text)
    lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    windows = [tuple(w[i : i + 3]) for i in range(len(w) - 2)]
    count = Counter(windows)
    covered = {i + k for i, x in enumerate(windows) if count[x] > 1 for k in range(3)}
    failed = len(w) < 50 or 100 * len(covered) > 50 * len(w)
    return len(w), sum(map(len, w)), sum(text.count(c) for c in "#*$%&|<>"), len(lines) - len(set(lines)), len(covered), failed


def test_whole_table(spark, sf_dir):
    rows = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()}
    labels = {r["doc_id"]: r["quality"] for r in spark.read.parquet(f"{sf_dir}/labels.parquet").collect()}
    got = {r["doc_id"]: r for r in op.op9_quality(spark, sf_dir).collect()}
    assert got.keys() == rows.keys()
    for i, t in rows.items():
        assert tuple(got[i][c] for c in [*op.BASE, "base_failed"]) == brute(t), i
        assert not (got[i]["base_failed"] and got[i]["kept"])
    seen = [(labels[i], got[i]["kept"]) for i in labels if i in got and not got[i]["base_failed"]]
    assert sum(y == 1 and not k for y, k in seen) <= 0.02 * len(seen)


def test_odd_texts(spark):
    texts = [None, "", " \n\t", "a b", "a b c", "a a a a", "x\x1cy \x0b z\x0c\n\n\nl\nl\n l\nl", "é 漢 🙂 " * 40, "b c d " * 3000, "|<#>&%*$ " * 7, "\x00 a\x00 b"]
    df = spark.createDataFrame([(i, t, 9, "q") for i, t in enumerate(texts)], "doc_id long, text string, n_words int, kept string")
    got = {r["doc_id"]: r for r in op.judge(df, []).collect()}
    for i, t in enumerate(texts):
        assert tuple(got[i][c] for c in [*op.BASE, "base_failed"]) == brute(t), (i, t)
        assert got[i]["kept"] == (not got[i]["base_failed"])
    assert op.judge(df.limit(0), []).count() == 0


def test_learner_finds_a_planted_rule():
    rows = []
    for i in range(300):
        bad = i % 5 == 0
        rows.append({f: 0.0 for f in op.FEATURES} | {"words": 100.0 + i, "symbols_per_word": 1.0 + i / 300 if bad else i / 3000, "digit_share": 0.5 if bad == (i % 10 == 0) else 0.1, "label": 0 if bad else 1, "part": i % 3})
    rules = op.learn(rows)
    assert rules and all(any(r.holds(x) for r in rules) == (x["label"] == 0) for x in rows)
    assert op.learn([]) == [] and op.learn([r for r in rows if r["label"] == 1]) == []


def test_a_list_of_several_rules_decides_in_spark_as_in_python(spark):
    """Three planted causes, each needs a rule of its own; every text's verdict is that of the first rule that holds."""
    plain = [f"w{i}" for i in range(60)]
    made = {0: lambda: plain, 1: lambda: [f"#{i}" for i in range(60)], 2: lambda: [f"W{i}" for i in range(60)], 3: lambda: [f"!{i}" for i in range(60)]}
    docs = spark.createDataFrame([(i, " ".join([f"t{i}", *made[i % 8 if i % 8 < 4 else 0]()])) for i in range(480)], "doc_id long, text string").repartition(4)
    labels = spark.createDataFrame([(i, int(i % 8 in (0, 4, 5, 6, 7))) for i in range(480)], "doc_id long, quality int")
    rows = op.labelled_rows(docs, labels)
    rules = op.learn(rows)
    assert len(rules) >= 3
    got = {r["doc_id"]: r["kept"] for r in op.judge(docs, rules).collect()}
    for r in rows:
        first = next((False for rule in rules if rule.holds(r)), True)
        assert got[r["doc_id"]] == first == (r["label"] == 1)
    assert len({next(k for k, rule in enumerate(rules) if rule.holds(r)) for r in rows if not got[r["doc_id"]]}) >= 3


def test_learned_verdicts_of_a_whole_table(spark, sf_dir):
    docs, labels = spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/labels.parquet")
    rules = op.learn(op.labelled_rows(docs, labels))
    features = [F.expr(sql).cast("double").alias(f) for f, sql in op.FEATURES.items()]
    got = {r["doc_id"]: r["kept"] for r in op.op9_quality(spark, sf_dir).collect()}
    for r in op.with_statistics(docs).select("doc_id", op.base_failed().alias("failed"), *features).collect():
        assert got[r["doc_id"]] == (not r["failed"] and not any(rule.holds(r.asDict()) for rule in rules))


def test_a_million_words_with_many_repeats(spark):
    text = " ".join(f"a{i % 400000}" for i in range(1000000))
    df = spark.createDataFrame([(1, text)], "doc_id long, text string")
    assert op.with_statistics(df).first()["n_repeat_words"] == 1000000


def test_no_python_in_the_plan(spark, sf_dir):
    plan = op.op9_quality(spark, sf_dir)._jdf.queryExecution().executedPlan().toString()
    assert not re.search("Python|Pandas|Arrow", plan)
