"""Running sums in an order, without one task for each key."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Places in a stretch.
WIDTH = 1 << 16


def running(rows: DataFrame, by: list[str], on: str, sums: dict[str, Column], *, width: int = WIDTH) -> DataFrame:
    """rows with a running sum of each of `sums`, its own row included, in the order of `on` within `by`.

    `on` is integer, not null and unique in `by`; the sums are of integers. Stretches are summed alone, a window over
    them (one row each) gives what comes before, and rows take it from there.
    """
    parts = rows.withColumns({"_stretch": F.floor(F.col(on) / width), **{f"_v_{k}": v.cast("long") for k, v in sums.items()}})
    along = Window.partitionBy(*by).orderBy("_stretch").rowsBetween(Window.unboundedPreceding, -1)
    totals = parts.groupBy(*by, "_stretch").agg(*[F.sum(f"_v_{k}").alias(f"_t_{k}") for k in sums])
    before = totals.select(*by, "_stretch", *[F.coalesce(F.sum(f"_t_{k}").over(along), F.lit(0)).alias(f"_b_{k}") for k in sums])
    own = Window.partitionBy(*by, "_stretch").orderBy(on).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    here = parts.select(*rows.columns, "_stretch", *[F.sum(f"_v_{k}").over(own).alias(f"_o_{k}") for k in sums])
    return here.join(before, [*by, "_stretch"]).select(*rows.columns, *[(F.col(f"_o_{k}") + F.col(f"_b_{k}")).alias(k) for k in sums])
