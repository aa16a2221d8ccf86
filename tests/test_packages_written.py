"""Packages of many documents written and read back without a Python group for each."""

from quire.operators.files import hwpx_scan
from quire.sources import packages, sinks


def test_sections_and_lines_come_back_in_order(spark):
    lines = [(d, s, b, f"{d} <{s}> & {b}" if b % 3 else "") for d in range(700) for s in range(1 + d % 3) for b in range(1 + d % 12)]
    paras = spark.createDataFrame(sorted(lines, key=lambda r: hash(r)), "doc_id int, section int, block int, text string").repartition(5)
    made = sinks.write_packages(paras)
    assert made.dtypes == [("doc_id", "bigint"), ("content", "binary")]
    files = made.selectExpr("cast(doc_id as string) path", "content").unionByName(spark.createDataFrame([("bad", b"PK")], "path string, content binary"))
    rows = packages.read_blocks(files, "hwpx").collect()
    assert [r["path"] for r in rows if r["error"]] == ["bad"]
    assert sorted((int(r["path"]), r["section"], r["block"], r["text"]) for r in rows if not r["error"]) == sorted(lines)


def test_no_group_of_pandas_for_each_document(spark, sf_dir):
    assert "FlatMapGroupsInPandas" not in hwpx_scan(spark, sf_dir)._jdf.queryExecution().executedPlan().toString()
