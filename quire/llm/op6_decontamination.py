"""Benchmark decontamination: a broadcast set of normalised test n-grams, looked up in every training window.

Words are maximal runs of letters a-z, digits and non-ASCII characters after lower-casing A-Z. A window is n
consecutive words of a test item; an item of fewer words, but not none, is one window. All windows of a text are
identified by 64-bit hashes in numpy, sieved through a bitmap and a sorted table, and each hit is compared with
the words themselves.

Defined cases: a null text has no words and no hits; null and wordless items have no windows; a null item id is
reported as no item but its windows still count as hits; repeated rows are judged one by one; an empty table on
either side gives no hits; other columns pass through unless a result column takes the name.

The set is broadcast while it holds at most `broadcast_bytes`. Of a larger benchmark only a bitmap of 8 MB is
broadcast, whatever its size: places of windows that it marks are joined with the table of windows on 128-bit digests
of their words, and come back to the texts by their digests.
"""

from __future__ import annotations

import hashlib
from collections import defaultdict
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quire.llm import grams
from quire.llm.common import Scratch, cut, hide, map_batches, small_batches, text_only, unhide

BROADCAST_BYTES = 32 << 20
#: The bitmap for larger benchmarks has 2**SIEVE bits, in rows of 2**ROW.
SIEVE, ROW = 26, 15

RESULT = T.StructType(
    [
        T.StructField("n_words", T.LongType()),
        T.StructField("n_hit", T.LongType()),
        T.StructField("items", T.ArrayType(T.StringType())),
        T.StructField("hit_spans", T.ArrayType(T.StructType([T.StructField("start", T.LongType()), T.StructField("end", T.LongType())]))),
    ]
)


def normal_words(text: str | None) -> list[bytes]:
    data = grams.LOWER[np.frombuffer((text or "").encode(), np.uint8)]
    starts, ends, _ = grams.words(data, np.array([0, len(data)]), grams.ALNUM)
    raw = data.tobytes()
    return [raw[a:b] for a, b in zip(starts.tolist(), ends.tolist(), strict=True)]


class NgramSet:
    """Windows of test items by length, and the items that each comes from."""

    def __init__(self, items: Iterable[tuple[object, str | None]], n: int):
        owners: dict[bytes, set[str]] = defaultdict(set)
        for item, text in items:
            w = normal_words(text)
            for i in range(max(1, len(w) - n + 1) if w else 0):
                owners[b" ".join(w[i : i + n])] |= set() if item is None else {str(item)}
        self.owners = {k: sorted(v) for k, v in owners.items()}
        by_length: dict[int, list[bytes]] = defaultdict(list)
        for window in self.owners:
            by_length[window.count(b" ") + 1].append(window)
        self.tables = {}
        for size, windows in sorted(by_length.items()):
            data = np.frombuffer(b" ".join(windows), np.uint8)
            starts, ends, _ = grams.words(data, np.array([0, len(data)]), grams.ALNUM)
            keys = np.unique(grams.runs_ids(grams.word_ids(data, starts, ends), size)[::size])
            bits = max(16, int(len(keys) * 64).bit_length())
            sieve = np.zeros(1 << bits, np.bool_)
            sieve[(keys >> np.uint64(64 - bits)).astype(np.int64)] = True
            self.tables[size] = (keys, sieve, bits)

    def hits(self, ids: np.ndarray, size: int) -> np.ndarray:
        """Where windows of this size may occur, to be verified."""
        keys, sieve, bits = self.tables[size]
        found = grams.runs_ids(ids, size)
        at = np.flatnonzero(sieve[(found >> np.uint64(64 - bits)).astype(np.int64)])
        place = np.minimum(np.searchsorted(keys, found[at]), len(keys) - 1)
        return at[keys[place] == found[at]]


def tally(offsets: np.ndarray, starts: np.ndarray, ends: np.ndarray, first: np.ndarray, hit: np.ndarray) -> tuple[list, list, list]:
    """(words, hit words, hit byte spans) of each text, from which of its words are hit."""
    counts = np.diff(np.concatenate([[0], np.cumsum(hit)])[first])
    spans = []
    for k in range(len(offsets) - 1):
        if not counts[k]:
            spans.append([])
            continue
        own = np.concatenate([[0], hit[first[k] : first[k + 1]].view(np.int8), [0]])
        turn = np.flatnonzero(np.diff(own))
        spans.append([{"start": int(starts[first[k] + a] - offsets[k]), "end": int(ends[first[k] + b - 1] - offsets[k])} for a, b in zip(turn[::2], turn[1::2], strict=True)])
    return np.diff(first).tolist(), counts.tolist(), spans


def scan(text_col: str, known: Callable[[], NgramSet]) -> Callable[[pa.RecordBatch], dict]:
    def run(batch: pa.RecordBatch) -> dict:
        n_words, n_hit, items, spans = [], [], [], []
        for _, raw, offsets in grams.chunks(batch.column(batch.schema.get_field_index(text_col))):
            data = grams.LOWER[raw]
            starts, ends, first = grams.words(data, offsets, grams.ALNUM)
            ids = grams.word_ids(data, starts, ends)
            owner = np.repeat(np.arange(len(offsets) - 1), np.diff(first))
            found: dict[int, set[str]] = defaultdict(set)
            hit = np.zeros(len(ids), np.bool_)
            for size in known().tables:
                at = known().hits(ids, size)
                at = at[owner[at] == owner[at + size - 1]]
                for i in at.tolist():
                    window = _window(data, starts, ends, i, size)
                    if window in known().owners:
                        hit[i : i + size] = True
                        found[int(owner[i])].update(known().owners[window])
            for all_texts, own in zip((n_words, n_hit, spans), tally(offsets, starts, ends, first, hit), strict=True):
                all_texts += own
            items += [sorted(found.get(k, ())) for k in range(len(offsets) - 1)]
        return {"n_words": n_words, "n_hit": n_hit, "items": items, "hit_spans": spans}

    return run


def _window(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, i: int, size: int) -> bytes:
    return b" ".join(data[a:b].tobytes() for a, b in zip(starts[i : i + size].tolist(), ends[i : i + size].tolist(), strict=True))


def _by_join(docs: DataFrame, items: DataFrame, *, n: int, text_col: str) -> DataFrame:
    """find_contamination for benchmarks of any size. items: their id, as a string, and their text."""
    spark = docs.sparkSession
    small_batches(spark)
    hidden, names = hide(docs)
    own_text = F.col(names[text_col]).cast("string")
    keyed = hidden.withColumn("_key", F.sha2(F.coalesce(own_text, F.lit("")).cast("binary"), 256))

    def item_windows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for row, raw, offsets in grams.chunks(b.column(1)):
                data = grams.LOWER[raw]
                starts, ends, first = grams.words(data, offsets, grams.ALNUM)
                ids, count = grams.word_ids(data, starts, ends), np.diff(first)
                for size in np.unique(np.minimum(count[count > 0], n)).tolist():
                    at = np.flatnonzero(np.repeat(np.minimum(count, n), count) == size)
                    at = at[at + size <= np.repeat(first[1:], count)[at]]
                    found = grams.runs_ids(ids, size)[at]
                    who = pa.array(row + np.searchsorted(first, at, "right") - 1)
                    digests = [grams.digest(_window(data, starts, ends, i, size)) for i in at.tolist()]
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(len(at), size, np.int32)), pa.array((found >> np.uint64(64 - SIEVE)).astype(np.int32)), pa.array(digests, pa.binary()), b.column(0).take(who)], names=["size", "place", "digest", "owner"])

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = []
            for places in b.column(1):
                bits = np.zeros(1 << ROW, np.bool_)
                bits[places.values.to_numpy() & ((1 << ROW) - 1)] = True
                rows.append(np.packbits(bits).tobytes())
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(rows, pa.binary())], names=["part", "bits"])

    def look(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for row, raw, offsets in grams.chunks(b.column(1)):
                data = grams.LOWER[raw]
                starts, ends, first = grams.words(data, offsets, grams.ALNUM)
                ids, owner = grams.word_ids(data, starts, ends), np.repeat(np.arange(len(offsets) - 1), np.diff(first))
                for size in sizes:
                    place = (grams.runs_ids(ids, size) >> np.uint64(64 - SIEVE)).astype(np.int64)
                    at = np.flatnonzero(shared.value[place >> 3] >> (7 - (place & 7)).astype(np.uint8) & 1)
                    at = at[owner[at] == owner[at + size - 1]]
                    digests = [grams.digest(_window(data, starts, ends, i, size)) for i in at.tolist()]
                    start = (at - first[owner[at]]).astype(np.int32)
                    yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(row + owner[at])), pa.array(start), pa.array(np.full(len(at), size, np.int32)), pa.array(digests, pa.binary())], names=["_key", "start", "size", "digest"])

    def settle(batch: pa.RecordBatch) -> dict:
        out: dict[str, list] = {f.name: [] for f in RESULT}
        of = lambda c: batch.column(batch.schema.get_field_index(c))
        for row, raw, offsets in grams.chunks(of(names[text_col])):
            starts, ends, first = grams.words(grams.LOWER[raw], offsets, grams.ALNUM)
            edge = np.zeros(len(starts) + 1, np.int64)
            for k in range(len(offsets) - 1):
                for h in of("_hits")[row + k].as_py() or ():
                    edge[first[k] + h["start"]] += 1
                    edge[first[k] + h["start"] + h["size"]] -= 1
            for name, own in zip(("n_words", "n_hit", "hit_spans"), tally(offsets, starts, ends, first, np.cumsum(edge)[:-1] > 0), strict=True):
                out[name] += own
            out["items"] += [of("_items")[row + k].as_py() or [] for k in range(len(offsets) - 1)]
        return out

    with Scratch(spark, "benchmark") as scratch:
        windows = scratch.table(items.mapInArrow(item_windows, "size int, place int, digest binary, owner string").distinct())
        sizes = sorted(r[0] for r in windows.select("size").distinct().collect())  # n at most
        bits = np.zeros(1 << SIEVE - 3, np.uint8)
        parts = windows.groupBy(F.shiftright("place", ROW).alias("part")).agg(F.collect_set("place").alias("places"))
        for part, packed in parts.mapInArrow(pack, "part int, bits binary").collect():  # 8 MB at most
            bits[part << ROW - 3 : part + 1 << ROW - 3] = np.frombuffer(packed, np.uint8)
        shared = spark.sparkContext.broadcast(bits)
        places = scratch.table(keyed.select("_key", own_text.alias("_text")).mapInArrow(look, "_key string, start int, size int, digest binary"))
        hits = scratch.table(places.join(cut(windows.select("digest").distinct()), "digest"), instead=places)
        spans = hits.groupBy("_key").agg(F.collect_set(F.struct("start", "size")).alias("_hits"))
        owners = hits.select("_key", "digest").distinct().join(windows.where("owner is not null").select("digest", "owner"), "digest").groupBy("_key").agg(F.array_sort(F.collect_set("owner")).alias("_items"))
        found = cut(spans.join(owners, "_key", "left"))
    out, taken = map_batches(keyed.join(found, "_key", "left"), settle, RESULT), {f.name for f in RESULT}
    return out.select(*[F.col(new).alias(c) for c, new in names.items() if c.lower() not in taken], *[f.name for f in RESULT])


def find_contamination(docs: DataFrame, benchmark: DataFrame, *, n: int = 10, text_col: str = "text", item_id: str = "item_id", item_text: str = "text", broadcast_bytes: int = BROADCAST_BYTES) -> DataFrame:
    """docs with n_words, n_hit, the items whose windows occur, and the hit byte spans of the text's UTF-8."""
    spark = docs.sparkSession
    items = benchmark.select(F.col(item_id).cast("string").alias("item"), F.col(item_text).cast("string").alias("words"))
    size = items.agg(F.coalesce(F.sum(F.octet_length("words")), F.lit(0))).first()[0]
    if size * n > broadcast_bytes:
        return _by_join(docs, items, n=n, text_col=text_col)
    shared = spark.sparkContext.broadcast(NgramSet([tuple(r) for r in items.collect()], n))
    return map_batches(docs, scan(text_col, lambda: shared.value), RESULT)


def decontaminate(docs: DataFrame, benchmark: DataFrame, *, remove: str = "documents", n: int = 10, text_col: str = "text") -> DataFrame:
    """docs without contaminated documents, or with their hit words cut out (remove="spans"). Columns stay as they are."""
    if remove not in ("documents", "spans"):
        raise ValueError(f"remove is documents or spans, not {remove}")
    hidden, names = hide(docs)
    own_text = names[text_col]
    found = find_contamination(hidden, benchmark, n=n, text_col=own_text)
    if remove == "documents":
        return unhide(found.where(F.col("n_hit") == 0), names)

    def cut_spans(batch: pa.RecordBatch) -> dict:
        out = []
        column = batch.column(batch.schema.get_field_index(own_text)).to_pylist()
        for text, spans in zip(column, batch.column(batch.schema.get_field_index("hit_spans")).to_pylist(), strict=True):
            raw, kept, at = (text or "").encode(), [], 0
            for s in spans or ():
                kept.append(raw[at : s["start"]])
                at = s["end"]
            out.append(None if text is None else b"".join([*kept, raw[at:]]).decode())
        return {"cut": out}

    return unhide(map_batches(found, cut_spans, T.StructType([T.StructField("cut", T.StringType())])), names, {text_col: "cut"})


def op6_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = find_contamination(text_only(spark.read.parquet(f"{sf_dir}/documents.parquet")), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
    return found.select(
        "doc_id",
        "n_words",
        "n_hit",
        F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join("items", ",").cast("binary"), 256).alias("items_sha256"),
        (F.col("n_hit") > 0).alias("contaminated"),
    )


def items_digest(items: Iterable[str]) -> str:
    return hashlib.sha256(",".join(sorted(items)).encode()).hexdigest()
