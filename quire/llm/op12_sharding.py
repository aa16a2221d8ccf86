"""Sharding by proportional stratified interleaving.

Rows of each stratum (a source) are shuffled by a seeded digest of their id and text and ranked; a row's place is its
fractional rank, (rank + offset) / rows of the stratum, where the stratum's seeded offset in [0, 1) keeps small strata
from meeting at one place. All rows are sorted by place and the order is cut into shards of equal row counts (at most
one apart), so each shard holds each stratum in the mixture's proportion, give or take a row or two.

No rank is taken by one task: digests cut a stratum into buckets of some `bucket` rows, and places cut the whole order
likewise; rows are ranked within their bucket, and running sums over the counts of buckets (one row each) give what
stands before it. A stratum that holds a third of all rows has a third of the buckets.

Everything is DataFrame expressions. The steps go to tables in the shared folder, without the texts unless `carry`
asks for them: a plan that read the texts for each of its three passes would read the corpus thrice.

Defined cases: a null text has no bytes and the digest of the empty text; a null stratum is a stratum of its own, apart
from the empty string; null and repeated ids are told apart by their texts; rows that are equal in id, stratum and text
are ranked one after the other, which of them is first does not matter; with fewer rows than shards some shards are
empty; an empty table gives an empty result; other columns pass through, but for those whose names results take.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from quire.llm.common import Scratch, cut, hide

SHARDS, SEED, BUCKET = 24, 20, 4096
#: What a row takes in a shard beside its text.
OVERHEAD = 8

RESULT = ["size", "text_crc32", "law", "shard", "slot", "grown_shard"]


def _digest(*values: Column) -> Column:
    """60 bits, the same for equal values; null differs from any text."""
    parts = [F.coalesce(F.concat(F.lit("="), v.cast("string")), F.lit("-")) for v in values]
    return F.conv(F.substring(F.md5(F.concat_ws("|", *parts)), 1, 15), 16, 10).cast("long")


def _before(counts: DataFrame, by: list[str], order: str, n: str) -> DataFrame:
    """counts with `before`, the sum of n over what stands earlier in its partition."""
    return counts.withColumn("before", F.coalesce(F.sum(n).over(W.partitionBy(*by).orderBy(order).rowsBetween(W.unboundedPreceding, -1)), F.lit(0)))


def assign(docs: DataFrame, *, shards: int = SHARDS, seed: int = SEED, id_col: str = "doc_id", text_col: str = "text", stratum_col: str = "source", carry: bool = False, bucket: int = BUCKET) -> DataFrame:
    """docs with size, text_crc32, law ('rows'), shard, slot (gapless from 0 in each shard) and grown_shard (null: the law is not 'key').

    The text itself stays in the result only with carry.
    """
    hidden, at = hide(docs)
    text = F.coalesce(F.col(at[text_col]).cast("string"), F.lit(""))
    kept = [n for c, n in at.items() if carry or c != text_col]
    rows = hidden.select(
        *kept,
        (F.octet_length(text) + OVERHEAD).cast("long").alias("size"),
        F.crc32(text.cast("binary")).alias("crc"),
        _digest(F.lit(seed), F.col(at[id_col]), F.crc32(text.cast("binary"))).alias("h"),
        F.col(at[stratum_col]).cast("string").alias("s"),
    )
    with Scratch(docs.sparkSession, "sharding") as scratch:
        rows = scratch.table(rows)
        strata = scratch.table(rows.groupBy("s").agg(F.count("*").alias("n")).select(F.col("s").alias("s2"), "n", F.ceil(F.col("n") / bucket).alias("buckets"), (F.shiftright(_digest(F.lit(seed), F.col("s")), 40) / F.lit(float(1 << 20))).alias("offset")))
        total = strata.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
        dealt = rows.join(strata, F.col("s").eqNullSafe(F.col("s2"))).drop("s2").withColumn("b", F.shiftright(F.shiftright("h", 30) * F.col("buckets"), 30))
        counts = scratch.table(dealt.groupBy(F.coalesce(F.concat(F.lit("="), "s"), F.lit("-")).alias("k"), "b").agg(F.count("*").alias("k_n")))
        ahead = _before(counts, ["k"], "b", "k_n").select(F.col("k").alias("k2"), F.col("b").alias("b2"), "before")
        own = W.partitionBy("k", "b").orderBy("h", at[id_col], "crc")
        ranked = dealt.withColumn("k", F.coalesce(F.concat(F.lit("="), "s"), F.lit("-"))).withColumn("rank", F.row_number().over(own) - 1)
        ranked = ranked.join(ahead, (F.col("k") == F.col("k2")) & (F.col("b") == F.col("b2"))).drop("k2", "b2")
        places = ranked.withColumn("place", (F.col("before") + F.col("rank") + F.col("offset")) / F.col("n"))
        places = scratch.table(places.withColumn("p", F.floor(F.col("place") * max(1, -(-total // bucket)))).select(*kept, "size", "crc", "h", "s", "place", "p"), instead=rows)
        ahead = _before(scratch.table(places.groupBy("p").agg(F.count("*").alias("p_n"))), [], "p", "p_n").select(F.col("p").alias("p2"), "before")
        order = W.partitionBy("p").orderBy("place", F.col("s").asc_nulls_first(), "h", at[id_col], "crc")
        out = places.withColumn("in_p", F.row_number().over(order) - 1).join(ahead, F.col("p") == F.col("p2")).withColumn("position", F.col("before") + F.col("in_p"))
        out = out.withColumn("shard", F.expr(f"position * {shards} div {max(1, total)}"))
        start = F.expr(f"(shard * {total} + {shards - 1}) div {shards}")
        taken = set(RESULT)
        out = out.select(
            *[F.col(n).alias(c) for c, n in at.items() if n in kept and c.lower() not in taken],
            "size",
            F.col("crc").alias("text_crc32"),
            F.lit("rows").alias("law"),
            F.col("shard").cast("int").alias("shard"),
            (F.col("position") - start).cast("long").alias("slot"),
            F.lit(None).cast("int").alias("grown_shard"),
        )
        return cut(out)


def write_shards(docs: DataFrame, at: str, *, shards: int = SHARDS, rows_per_file: int = 1 << 17, **options) -> None:
    """Writes docs under `at`, a folder for each shard; each file holds consecutive slots in their order."""
    out = assign(docs, shards=shards, carry=True, **options)
    run = F.floor(F.col("slot") / rows_per_file)
    out.repartition(F.col("shard"), run).sortWithinPartitions("shard", "slot").write.partitionBy("shard").parquet(at)


def op12_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "source", "text")
    return assign(docs).select("doc_id", *RESULT)
