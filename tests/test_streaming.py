import datetime as dt

from pyspark.sql import functions as F

from quire.streaming import history


def run(spark, frame, path, schema, transform, mode="append"):
    frame.write.mode("overwrite").parquet(path)
    stream = transform(spark.readStream.schema(schema).parquet(path))
    name = f"out_{abs(hash(path)) % 10**9}"
    q = stream.writeStream.format("memory").queryName(name).outputMode(mode).trigger(availableNow=True).start()
    q.awaitTermination(120)
    return spark.sql(f"SELECT * FROM {name}").collect()


def test_history(spark, tmp_path):
    commands = ["a", "b", "undo", "undo", "undo", "redo", "c", "redo"]
    frame = spark.createDataFrame([(1, i, c) for i, c in enumerate(commands)], "doc_id long, seq long, command string")
    rows = run(spark, frame, str(tmp_path / "h"), frame.schema, history.edit_history)
    got = [(r["seq"], r["revision"], r["undo_depth"], r["redo_depth"]) for r in sorted(rows, key=lambda r: r["seq"])]
    assert got == [(0, 1, 1, 0), (1, 2, 2, 0), (2, 3, 1, 1), (3, 4, 0, 2), (4, 4, 0, 2), (5, 5, 1, 1), (6, 6, 2, 0), (7, 6, 2, 0)]


def test_autosaves(spark, tmp_path):
    base = dt.datetime(2024, 1, 1)
    frame = spark.createDataFrame([(1, base + dt.timedelta(seconds=s)) for s in (0, 1, 2, 10, 11, 60)], "doc_id long, ts timestamp")
    rows = run(spark, frame, str(tmp_path / "s"), frame.schema, history.autosaves)
    assert sorted(r["edits"] for r in rows) == [2, 3]


def test_events(spark, tmp_path):
    lines = [history.event_line("status", text="x"), "", "{broken", '{"type":"other"}', history.event_line("error")]
    frame = spark.createDataFrame([(x,) for x in lines], "value string")
    rows = run(spark, frame, str(tmp_path / "e"), frame.schema, lambda s: history.parsed_events(s).select(F.col("type")))
    assert sorted(r["type"] for r in rows) == ["error", "status"]
