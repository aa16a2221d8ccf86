"""Runs split at a range where a paragraph's runs lie in one row."""

from pyspark.sql import functions as F

from quire.operators import edit


def test_lines_split_as_their_runs_do_and_nothing_is_dealt_out(spark, sf_dir):
    texts = [["", "ab", "", "cdefg", "é", "", "h" * 40, "i", "j"], [], ["x"] * 60, [""] * 30 + ["y" * 3] * 20, None, [None, "k", None, "lm"], ["n" * 10, "o" * 15, "p"]]
    ranges = [(10, 25), (0, 0), (3, 4), (25, 10), (-4, 6), (0, 1000), (-3, -1), (7, 7)]
    lines = spark.createDataFrame([(d, b, t, *r) for d, t in enumerate(texts) for b, r in enumerate(ranges)], "doc_id long, block long, runs array<string>, a int, b int")
    runs = lines.select("doc_id", "block", "a", "b", F.posexplode("runs").alias("run", "text")).withColumn("run", F.col("run").cast("long"))
    got, want = edit.split_lines(lines, "a", "b"), edit.split_runs(runs, "a", "b")
    assert got.dtypes == want.dtypes and sorted(got.collect()) == sorted(want.collect())
    assert "Exchange" not in edit.run_split(spark, sf_dir)._jdf.queryExecution().executedPlan().toString()
