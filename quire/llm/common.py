"""Spark helpers shared by the text operators."""

from __future__ import annotations

import os
import tempfile
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

#: Rows in an Arrow batch; with long texts a batch of Spark's default 10,000 rows would be gigabytes.
BATCH_ROWS = 400


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share: spark.checkpoint.dir. Only a local master (tests) may do without it."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir", None)
    if not found:
        found = spark.sparkContext._jsc.sc().getCheckpointDir()
        found = found.get() if found.isDefined() else None
    if not found:
        if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster"):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        found = "file://" + os.path.join(tempfile.gettempdir(), "quire-shared")
        os.makedirs(found.removeprefix("file://"), exist_ok=True)
    return found


def new_dir(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"


def remove(spark: SparkSession, at: str) -> None:
    path = spark._jvm.org.apache.hadoop.fs.Path(at)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


@contextmanager
def settings(spark: SparkSession, **conf: str) -> Iterator[None]:
    """Session settings for what is computed within the block; put back afterwards. Dots are written as __."""
    before = {k: spark.conf.get(k.replace("__", ".")) for k in conf}
    try:
        for k, v in conf.items():
            spark.conf.set(k.replace("__", "."), v)
        yield
    finally:
        for k, v in before.items():
            spark.conf.set(k.replace("__", "."), v)


def arrow_rows(spark: SparkSession, rows: int):
    """Arrow batches of so many rows, for narrow tables."""
    return settings(spark, spark__sql__execution__arrow__maxRecordsPerBatch=str(rows))


class Scratch:
    """Tables in the shared folder for the steps of one job. They survive lost executors, and go when the block ends.

    What outlives the block must be cut() inside it. Within the block each step's shuffle files go when the step has
    ended, and Arrow batches have at most `rows` rows; both settings are put back afterwards.
    """

    def __init__(self, spark: SparkSession, name: str, rows: int = BATCH_ROWS):
        self.spark, self.at, self.held = spark, new_dir(spark, name), []
        self.conf = settings(spark, spark__sql__classic__shuffleDependency__fileCleanup__enabled="true", spark__sql__execution__arrow__maxRecordsPerBatch=str(rows))

    def __enter__(self) -> Scratch:
        self.conf.__enter__()
        return self

    def __exit__(self, *_) -> None:
        self.conf.__exit__(None, None, None)
        remove(self.spark, self.at)

    def table(self, df: DataFrame, *, instead: DataFrame | None = None) -> DataFrame:
        """df, written and read again; instead is a table of this folder that it takes the place of, which goes."""
        at = f"{self.at}/{uuid.uuid4().hex}"
        df.write.option("compression", "zstd").parquet(at)
        out = self.spark.read.schema(df.schema).parquet(at)
        self.held = [(t, a) for t, a in self.held if t is not instead or remove(self.spark, a)] + [(out, at)]
        return out


def cut(df: DataFrame) -> DataFrame:
    """Materialises df in the shared folder, so that lost executors cost no recomputation and no second evaluation differs."""
    sc = df.sparkSession.sparkContext
    if not sc._jsc.sc().getCheckpointDir().isDefined():
        sc.setCheckpointDir(shared_dir(df.sparkSession))
    return df.checkpoint(eager=True)


def small_batches(spark: SparkSession) -> None:
    """Arrow batches of whole texts from here on. It stays so: plans over texts are lazy and run with what is set then."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(spark.conf.get(key)) <= BATCH_ROWS:
        spark.conf.set(key, str(BATCH_ROWS))


def map_batches(df: DataFrame, fn: Callable[[pa.RecordBatch], dict], added: T.StructType, *, keep: bool = True) -> DataFrame:
    """Applies fn to each Arrow batch. fn gives lists or arrays for the added columns, one value a row.

    With keep, the input's columns come first, but for those whose names the added ones take.
    """
    small_batches(df.sparkSession)
    taken = {f.name.lower() for f in added}
    kept = [f for f in df.schema if keep and f.name.lower() not in taken]
    schema = T.StructType([*kept, *added])
    arrow = to_arrow_schema(schema)
    own = {f.name: arrow.field(f.name).type for f in added}
    names = [f.name for f in kept]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if not b.num_rows:
                continue
            out = fn(b)
            cols = [b.column(b.schema.get_field_index(n)) for n in names]
            cols += [v if isinstance(v, pa.Array) else pa.array(v, t) for v, t in ((out[n], t) for n, t in own.items())]
            yield pa.RecordBatch.from_arrays(cols, names=[*names, *own])

    return df.mapInArrow(run, schema)


def hide(df: DataFrame) -> tuple[DataFrame, dict[str, str]]:
    """df with columns named so that no operator's result takes their place, and the new name of each."""
    names = {c: f"_c{k}" for k, c in enumerate(df.columns)}
    return df.select([F.col(f"`{c}`").alias(new) for c, new in names.items()]), names


def unhide(df: DataFrame, names: dict[str, str], replaced: dict[str, str] | None = None) -> DataFrame:
    """The columns under their old names, in their old order; replaced gives other columns for some."""
    return df.select([F.col((replaced or {}).get(c, new)).alias(c) for c, new in names.items()])


def row_key(id_col: str, text_col: str) -> Column:
    """What tells rows of one id apart; rows of the same id and text share it."""
    return F.xxhash64(F.col(id_col), F.col(text_col).cast("string"))


def text_only(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Just the id and the text, whatever else the table holds."""
    return df.select(F.col(id_col), F.col(text_col).cast("string").alias(text_col))
