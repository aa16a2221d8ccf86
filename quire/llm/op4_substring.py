"""Substring dedup over words by level-wise doubling.

Only stretches that are repeated at one length are extended to twice that length; candidates are whatever is left.

* The first level is an eighth of a window (6 words of 50). Of each window its least such stretch, the seed, is looked
  up: windows that are equal have equal seeds at equal places. Windows that follow one another with one seed are one
  candidate, a row with the identifiers of the seed at each length.
* A seed is extended to the right where the window has room for the last length there, else to the left, so a
  candidate's windows hold the whole of it. At each level the stretches of that length are counted over the corpus;
  candidates whose stretch no other text has leave, and the rest are extended to twice the length: 6, 12, 24 words.
* What survives to the last doubling is compared at the full length. Candidates of equal words are one class; a class
  that an earlier text has is removed whole. Of classes that share their last stretch with another class one member
  each is taken apart into its single windows, and of each of these the smallest id is found.

Each level is a table; every count is an aggregate with partial sums, so a passage in a third of all texts adds a row
a task, and no group is ever gathered. Identifiers sieve; words that are removed have equal 128-bit digests.

Defined cases: a null text has no words; texts of fewer words than a window lose nothing; of texts of equal ids
neither counts as smaller; a null id is larger than any other and no smaller than another null; repeated rows keep
their words unless an earlier text has them; an empty table gives an empty result; other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quire.llm import grams
from quire.llm.common import Scratch, cut, map_batches, row_key, text_only


def lengths(window: int) -> list[int]:
    """The lengths of the levels below the window; one side of any seed has room for the last."""
    out = [max(1, window // 8)]
    while 2 * out[-1] <= (window + out[0]) // 2:
        out.append(2 * out[-1])
    return out


def candidates_of(raw: np.ndarray, offsets: np.ndarray, window: int) -> tuple[np.ndarray, ...]:
    """(text, start, windows, digest of all words, identifier of the seed's stretch at each length...) of a chunk's candidates."""
    data, begin, end, first = grams.spaced(raw, offsets)
    ids, levels = grams.word_ids(data, begin, end), lengths(window)
    if len(ids) < window:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64), [], *[np.zeros(0, np.int64)] * len(levels)
    seed = grams.window_argmin(grams.runs_ids(ids, levels[0]), window - levels[0] + 1)
    left = seed - np.arange(len(seed)) > window - levels[-1]
    change = np.ones(len(seed), np.bool_)
    change[1:] = (seed[1:] != seed[:-1]) | (left[1:] != left[:-1])
    a, z = grams.runs_of(change, grams.inside(first, window))
    at, side = seed[a], left[a]
    sums = grams.prefix(ids, grams.WORD_BASE)
    keys = []
    for n in levels:
        x = np.where(side, at + levels[0] - n, at)
        keys.append(grams.mix(grams.spans_ids(sums, x, x + n, grams.WORD_BASE) + side.astype(np.uint64)).view(np.int64))
    text = np.searchsorted(first, a, "right") - 1
    whole = data.tobytes()
    digests = [grams.digest(whole[x:y]) for x, y in zip(begin[a].tolist(), end[z + window - 1].tolist(), strict=True)]
    return text, a - first[text], z - a + 1, digests, *keys


def _has_earlier(low: Column, own: Column) -> Column:
    """Whether low is smaller than own; a null is larger than all but a null."""
    return F.coalesce((low < own) | (own.isNull() & low.isNotNull()), F.lit(False))


def repeated_starts(docs: DataFrame, *, window: int, id_col: str, text_col: str) -> DataFrame:
    """(id, row_key, starts array<struct<a,b>>): half-open runs of starts of windows that a text of a smaller id has too."""
    spark = docs.sparkSession
    texts = docs.select(F.col(id_col).alias("id"), row_key(id_col, text_col).alias("row_key"), F.col(text_col).cast("string").alias("_text"))
    kind = texts.schema["id"].dataType.simpleString()
    keys = [f"k{n}" for n in lengths(window)]

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for row, raw, offsets in grams.chunks(b.column(2)):
                text, start, count, digests, *found = candidates_of(raw, offsets, window)
                who = pa.array(row + text)
                columns = [b.column(0).take(who), b.column(1).take(who), pa.array(start.astype(np.int32)), pa.array(count.astype(np.int32)), pa.array(digests, pa.binary()), *map(pa.array, found)]
                yield pa.RecordBatch.from_arrays(columns, names=["id", "row_key", "s", "n", "kind", *keys])

    with Scratch(spark, "substring") as scratch:
        left = scratch.table(texts.mapInArrow(scan, f"id {kind}, row_key long, s int, n int, kind binary, {', '.join(f'{k} long' for k in keys)}"))
        for k in keys:
            several = (F.col("low") < F.col("high")) | ((F.col("known") > 0) & (F.col("known") < F.col("all")))
            # materialised before it is joined: a join with an aggregate on the same partitioning cannot be split where one key holds a large part
            repeated = cut(left.groupBy(k).agg(F.min("id").alias("low"), F.max("id").alias("high"), F.count("id").alias("known"), F.count("*").alias("all")).where(several).select(k))
            longer = left.join(repeated, k, "left_semi")
            left = scratch.table(longer if k == keys[-1] else longer.drop(k), instead=left)
        last = keys[-1]
        classes = cut(left.groupBy(last, "kind").agg(F.min("id").alias("least"), F.min(F.struct("id", "row_key", "s", "n")).alias("member")))
        apart = (F.col("low") < F.col("high")) | ((F.col("known") > 0) & (F.col("known") < F.col("all")))
        shared = cut(classes.groupBy(last).agg(F.min("least").alias("low"), F.max("least").alias("high"), F.count("least").alias("known"), F.count("*").alias("all")).where(apart).select(last))
        wanted = classes.join(shared, last, "left_semi").select(F.col("member.id").alias("wid"), F.col("member.row_key").alias("wkey"), F.struct("kind", "least", F.col("member.s").alias("s"), F.col("member.n").alias("n")).alias("cell"))
        wanted = wanted.groupBy("wid", "wkey").agg(F.collect_list("cell").alias("cells"))

        def expand(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                for row, raw, offsets in grams.chunks(b.column(0)):
                    data, begin, end, first = grams.spaced(raw, offsets)
                    whole, lists = data.tobytes(), b.column(1).slice(row, len(offsets) - 1)
                    flat, count = lists.flatten(), np.diff(lists.offsets.to_numpy())
                    s, n = flat.field("s").to_numpy() + np.repeat(first[:-1], count), flat.field("n").to_numpy()
                    which = np.repeat(np.arange(len(s)), n)
                    off = np.arange(len(which)) - np.repeat(np.cumsum(n) - n, n)
                    x = s[which] + off
                    digests = [grams.digest(whole[p:q]) for p, q in zip(begin[x].tolist(), end[x + window - 1].tolist(), strict=True)]
                    which = pa.array(which)
                    yield pa.RecordBatch.from_arrays([pa.array(digests, pa.binary()), flat.field("kind").take(which), pa.array(off.astype(np.int32)), flat.field("least").take(which)], names=["window", "kind", "off", "least"])

        joined = texts.join(wanted, F.col("id").eqNullSafe(F.col("wid")) & (F.col("row_key") == F.col("wkey"))).select("_text", "cells")
        windows = scratch.table(joined.mapInArrow(expand, f"window binary, kind binary, off int, least {kind}"))
        low = cut(windows.groupBy("window").agg(F.min("least").alias("low"), F.count("*").alias("n")).where("n > 1").select("window", "low"))
        early = windows.join(low, "window").where(_has_earlier(F.col("low"), F.col("least"))).select("kind", "off")
        known = left.select("id", "row_key", "s", "n", "kind", last).join(classes.select(last, "kind", "least"), [last, "kind"]).withColumn("whole", _has_earlier(F.col("least"), F.col("id")))
        run = lambda a, b: F.struct(a.cast("int").alias("a"), b.cast("int").alias("b")).alias("run")
        whole = known.where("whole").select("id", "row_key", run(F.col("s"), F.col("s") + F.col("n")))
        part = known.where("not whole").join(early.distinct(), "kind").select("id", "row_key", run(F.col("s") + F.col("off"), F.col("s") + F.col("off") + 1))
        return cut(whole.union(part).groupBy("id", "row_key").agg(F.collect_list("run").alias("starts")))


def remove_repeated_words(docs: DataFrame, *, window: int = 50, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, n_words, n_removed, kept): kept has the words that stay, joined by one space."""
    docs = text_only(docs, id_col, text_col)
    starts = repeated_starts(docs, window=window, id_col=id_col, text_col=text_col)

    def run(batch: pa.RecordBatch) -> dict:
        n_words, n_removed, kept = [], [], []
        at, lists = batch.schema.get_field_index(text_col), batch.column(batch.schema.get_field_index("_starts"))
        for row, raw, offsets in grams.chunks(batch.column(at)):
            begin, end, first = grams.words(raw, offsets, grams.SPACED)
            data = raw.tobytes()
            for k in range(len(offsets) - 1):
                a, b = first[k], first[k + 1]
                runs = lists[row + k].as_py() or ()
                gone = grams.covered(b - a, np.array([r["a"] for r in runs], np.int64), np.array([r["b"] for r in runs], np.int64) + window - 1)
                kept.append(b" ".join([data[x:y] for x, y in zip(begin[a:b][~gone].tolist(), end[a:b][~gone].tolist(), strict=True)]).decode())
                n_words.append(int(b - a))
                n_removed.append(int(gone.sum()))
        return {"n_words": n_words, "n_removed": n_removed, "kept": kept}

    left = docs.select(F.col(id_col).alias("id"), row_key(id_col, text_col).alias("row_key"), F.col(text_col).cast("string").alias("_text"))
    right = starts.withColumnsRenamed({"id": "_id", "row_key": "_key", "starts": "_starts"})
    joined = left.join(right, F.col("id").eqNullSafe(F.col("_id")) & (F.col("row_key") == F.col("_key")), "left").select(F.col("id").alias(id_col), F.col("_text").alias(text_col), "_starts")
    added = T.StructType([T.StructField("n_words", T.LongType()), T.StructField("n_removed", T.LongType()), T.StructField("kept", T.StringType())])
    return map_batches(joined, run, added).select(id_col, "n_words", "n_removed", "kept")


def op4_substring(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = remove_repeated_words(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return found.select("doc_id", "n_words", "n_removed", F.sha2(F.col("kept").cast("binary"), 256).alias("kept_sha256"))
