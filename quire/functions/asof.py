"""Lookups in an order, without one task for each key: the order is cut into buckets, and boundaries are carried."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quire.sources.shared import dealt


def as_of(left: DataFrame, right: DataFrame, by: list[str], on: str, take: list[str], *, width: int, above: bool = False, rows: int | None = None, bucket: str | None = None) -> DataFrame:
    """left with the columns `take` of the last row of right at or before left's `on`; with above, of the first one beyond it.

    Where there is none they are null. `on` is integer, not null, and unique for each `by` in right. Rows meet in
    buckets of `width`; what a bucket lacks comes from the nearest one that has a row of right, by a window over the
    buckets (one row each). So neither a key nor a long run of empty buckets gathers rows in one task.
    With `rows`, the number of rows of both, they are dealt out over as many tasks as that takes.
    If both lie by `by` and a column that has their bucket already, `bucket` names it, and they are not dealt out again.
    """
    kept = [c for c in left.columns if c not in take and c != bucket]
    b = (F.floor(F.col(on) / width) if bucket is None else F.col(bucket)).alias("_b")
    asked = left.select(*by, b, F.col(on).alias("_on"), F.lit(1).alias("_l"), F.struct(*kept).alias("_row"), F.lit(None).cast(right.select(F.struct(*take).alias("v")).schema["v"].dataType).alias("_v"))
    there = right.select(*by, b, F.col(on).alias("_on"), F.lit(0).alias("_l"), F.lit(None).cast(left.select(F.struct(*kept).alias("r")).schema["r"].dataType).alias("_row"), F.struct(*take).alias("_v"))
    both = asked.unionByName(there)
    if rows is not None:
        both = dealt(both, [*by, "_b"], rows)
    nearest = (F.min_by if above else F.max_by)("_v", F.when(F.col("_l") == 0, F.col("_on")))
    along = Window.partitionBy(*by).orderBy(F.desc("_b") if above else F.asc("_b")).rowsBetween(Window.unboundedPreceding, -1)
    edges = both.groupBy(*by, "_b").agg(nearest.alias("_near")).withColumn("_carried", F.last("_near", ignorenulls=True).over(along)).drop("_near")
    order = [F.desc("_on"), F.desc("_l")] if above else [F.asc("_on"), F.asc("_l")]
    own = Window.partitionBy(*by, "_b").orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    found = both.withColumn("_own", F.last("_v", ignorenulls=True).over(own)).where("_l = 1").join(edges, [*by, "_b"])
    found = found.withColumn("_v", F.coalesce("_own", "_carried"))
    return found.select(*[F.col(f"_row.{c}").alias(c) for c in kept], *[F.col(f"_v.{c}").alias(c) for c in take])
