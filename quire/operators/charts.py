"""Chart arithmetic, units, sizes and view maths."""

from __future__ import annotations

import math

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quire.functions import text as X
from quire.plans.registry import query
from quire.sources.adapters import table


def domain(series: DataFrame, by: list[str]) -> DataFrame:
    """(…, low, high): a value axis from zero or the least value to a round maximum."""
    out = series.groupBy(*by).agg(F.min("value").alias("least"), F.max("value").alias("most"))
    return out.select(*by, F.least(F.col("least"), F.lit(0.0)).alias("low"), X.nice_ceil(F.col("most")).alias("high"))


def shares(series: DataFrame, by: str, order: str) -> DataFrame:
    """Each value's share of its pie and the angles, in degrees, between which it lies. Negative values count as zero."""
    value = F.greatest(F.col("value"), F.lit(0.0))
    whole = F.sum(value).over(Window.partitionBy(by))
    before = F.coalesce(F.sum(value).over(Window.partitionBy(by).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0))
    return series.withColumn("share", value / whole).withColumn("start", before / whole * 360).withColumn("end", (before + value) / whole * 360)


def bar_chart(frame: pd.DataFrame, width: int = 400, height: int = 240) -> str:
    """A bar chart's SVG from name and value columns."""
    top = max([0.0, *frame["value"]])
    scale = 10.0 ** math.floor(math.log10(top)) if top > 0 else 1.0
    most = next(m for m in (1, 2, 5, 10) if top <= m * scale) * scale if top > 0 else 1.0
    step = width / max(1, len(frame))
    bars = []
    for i, (name, value) in enumerate(zip(frame["name"], frame["value"], strict=True)):
        tall = max(0.0, value) / most * height
        label = str(name).replace("&", "&amp;").replace("<", "&lt;").replace(">", "&gt;")
        bars.append(f'<rect x="{i * step + step * 0.1:.2f}" y="{height - tall:.2f}" width="{step * 0.8:.2f}" height="{tall:.2f}"><title>{label}</title></rect>')
    return f'<svg xmlns="http://www.w3.org/2000/svg" viewBox="0 0 {width} {height}">{"".join(bars)}</svg>'


def fit_size(w: Column, h: Column, most: Column) -> tuple[Column, Column]:
    """A size scaled down, never up, to a width, its shape kept."""
    scale = F.least(F.lit(1.0), most / w)
    return w * scale, h * scale


def zoom_about(scale: Column, origin: Column, point: Column, factor: float, low: float = 0.25, high: float = 4.0) -> tuple[Column, Column]:
    """A zoom, clamped, and the origin that keeps a point where it is."""
    new = F.least(F.greatest(scale * factor, F.lit(low)), F.lit(high))
    return new, point - (point - origin) * new / scale


@query("SELECT l_suppkey, 0.0::DOUBLE AS low, CASE WHEN m <= b THEN b WHEN m <= 2 * b THEN 2 * b WHEN m <= 5 * b THEN 5 * b ELSE 10 * b END::DOUBLE AS high FROM (SELECT l_suppkey, max(l_extendedprice) AS m, pow(10, floor(log10(max(l_extendedprice)))) AS b FROM lineitem GROUP BY l_suppkey)")
def chart_domain(spark: SparkSession, sf_dir: str) -> DataFrame:
    return domain(table(spark, sf_dir, "lineitem").selectExpr("l_suppkey", "l_extendedprice as value"), ["l_suppkey"])


@query("SELECT event_id, CASE WHEN v <= 0 THEN 1.0 WHEN v <= b THEN b WHEN v <= 2 * b THEN 2 * b WHEN v <= 5 * b THEN 5 * b ELSE 10 * b END::DOUBLE AS nice FROM (SELECT event_id, value - 5 AS v, CASE WHEN value > 5 THEN pow(10, floor(log10(value - 5))) END AS b FROM events)")
def nice_ceil(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").select("event_id", X.nice_ceil(F.col("value") - 5).alias("nice"))


@query("WITH v AS (SELECT p_brand, p_partkey, greatest(p_size - 5, 0)::DOUBLE AS v FROM part) SELECT p_brand, p_partkey, v / sum(v) OVER (PARTITION BY p_brand) AS share, (coalesce(sum(v) OVER (PARTITION BY p_brand ORDER BY p_partkey ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0.0) / sum(v) OVER (PARTITION BY p_brand) * 360) AS start FROM v")
def pie_shares(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = table(spark, sf_dir, "part").select("p_brand", "p_partkey", (F.col("p_size") - 5).cast("double").alias("value"))
    return shares(v, "p_brand", "p_partkey").select("p_brand", "p_partkey", "share", "start")


@query("SELECT p_partkey, round(p_size * 7200 / 25.4)::BIGINT AS units, p_size * 7200 / 25.4 / 75 AS px, (p_size * 100)::BIGINT AS pt, least(1.0, 40.0 / p_size) * p_size AS w, least(1.0, 40.0 / p_size) * p_retailprice AS h FROM part")
def unit_convert(spark: SparkSession, sf_dir: str) -> DataFrame:
    size = F.col("p_size").cast("double")
    w, h = fit_size(size, F.col("p_retailprice"), F.lit(40.0))
    return table(spark, sf_dir, "part").select("p_partkey", X.mm_to_units(size).alias("units"), (size * 7200 / 25.4 / 75).alias("px"), (F.col("p_size") * 100).cast("long").alias("pt"), F.when(size > 0, w).alias("w"), F.when(size > 0, h).alias("h"))


@query()
def svg_chart(spark: SparkSession, sf_dir: str) -> DataFrame:
    part = table(spark, sf_dir, "part").groupBy("p_brand", "p_type").agg(F.avg("p_retailprice").alias("value"))
    def draw(frame: pd.DataFrame) -> pd.DataFrame:
        rows = frame.sort_values("p_type").rename(columns={"p_type": "name"})
        return pd.DataFrame({"p_brand": [rows["p_brand"].iloc[0]], "svg": [bar_chart(rows)]})

    return part.groupBy("p_brand").applyInPandas(draw, "p_brand string, svg string")
