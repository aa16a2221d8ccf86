"""Suffix dedup by bucket-pointer refinement.

Suffixes are put into buckets by a q-gram, and a bucket is refined by the bucket identifiers that stand at later
offsets, twice as far each time, until a whole window (400 bytes) is told apart; suffixes alone in a bucket leave at
once, and each level's identifiers are used again by the next. All of it is exact: the first identifiers number the
q-grams themselves, later ones number pairs.

The corpus is dealt out before that. Of each window only its least q-gram of a quarter window, the anchor, is put into
a bucket of the corpus, for equal windows have equal anchors. Windows that follow one another with one anchor form a
cell, a row; there are some 0.7 cells for each 100 bytes.

1. Anchors that one cell alone has, once, are buckets of one: their windows are done.
2. Cells of equal bytes (equal 128-bit digests) are one class; each window of a class of two or more is repeated.
3. The cells that are left, each alone in its class, are refined against the other classes of their anchor, one member
   of each, by bucket pointers. Where these are more than `block` symbols (a passage in very many surroundings), they
   are first parted across the cluster, by what all windows at one stretch of distances from the anchor share, until
   what is left of a part can be refined in one task.

Symbols are bytes, or words (unit="words"), for windows that mean the same in every script.

Defined cases: a null text has nothing; texts shorter than a window lose nothing; a window that occurs twice in one
text counts, overlapping too; repeated rows are each other's copies; an empty table gives an empty result; other
columns pass through, but for those whose names results take. Cutting may split a character: kept bytes are as they
are, kept text leaves out the split parts.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quire.llm import grams
from quire.llm.common import Scratch, cut, hide, map_batches, row_key, text_only, unhide

WINDOW = 400
#: Symbols of one anchor's classes that one task refines; it takes some 100 bytes for each.
BLOCK = 1 << 22


@dataclass
class Symbols:
    """The symbols of a chunk of texts: their identifiers, the n+1 offsets of the texts in them, and the bytes that hold them."""

    ids: np.ndarray
    first: np.ndarray
    data: np.ndarray
    begin: np.ndarray | None = None
    end: np.ndarray | None = None

    @staticmethod
    def of(raw: np.ndarray, offsets: np.ndarray, unit: str) -> Symbols:
        if unit == "bytes":
            return Symbols(grams.byte_values()[raw], offsets, raw)
        data, begin, end, first = grams.spaced(raw, offsets)
        return Symbols(grams.word_ids(data, begin, end), first, data, begin, end)

    def parts(self, a: np.ndarray, z: np.ndarray) -> list[bytes]:
        """The bytes of the symbols from a up to z, exclusive, for each pair."""
        whole = self.data.tobytes()
        x, y = (a, z) if self.begin is None else (self.begin[a], self.end[z - 1])
        return [whole[p:q] for p, q in zip(x.tolist(), y.tolist(), strict=True)]

    def codes(self) -> tuple[np.ndarray, int]:
        """A number for each symbol, equal for equal ones only, and how many symbols each stands for: eight bytes, or a word."""
        if self.begin is None:
            padded = np.concatenate([self.data, np.zeros(7, np.uint8)]).astype(np.uint64)
            code = np.zeros(len(self.data), np.uint64)
            for k in range(8):
                code |= padded[k : k + len(code)] << np.uint64(8 * k)
            return np.unique(code, return_inverse=True)[1], 8
        words = pa.array(self.parts(np.arange(len(self.begin)), np.arange(len(self.begin)) + 1), pa.binary())
        return words.dictionary_encode().indices.to_numpy().astype(np.int64), 1


def cells_of(symbols: Symbols, window: int, gram: int) -> tuple[np.ndarray, ...]:
    """(text, start, windows, anchor, whether the anchor stands in it twice) of a chunk's cells."""
    if len(symbols.ids) < window:
        none = np.zeros(0, np.int64)
        return none, none, none, none, none.astype(bool)
    ids = grams.runs_ids(symbols.ids, gram)
    anchor = grams.window_min(ids, window - gram + 1)
    change = np.ones(len(anchor), np.bool_)
    np.not_equal(anchor[1:], anchor[:-1], out=change[1:])
    first = symbols.first
    change[first[:-1][first[:-1] < len(change)]] = True
    a, z = grams.runs_of(change, grams.inside(first, window))
    twice = np.fromiter((np.count_nonzero(ids[x:y] == h) > 1 for x, y, h in zip(a.tolist(), (z + window - gram + 1).tolist(), anchor[a], strict=True)), bool, len(a))
    text = np.searchsorted(first, a, "right") - 1
    return text, a - first[text], z - a + 1, anchor[a].view(np.int64), twice


def refine(codes: np.ndarray, depth: int, first: np.ndarray, group: np.ndarray, window: int) -> np.ndarray:
    """For each place, the bucket of the window that starts there, or -1 where it is alone in it or runs over its sequence.

    codes number the first `depth` symbols of each place; sequences of different groups share no bucket.
    """
    n = len(codes)
    room = np.repeat(first[1:], np.diff(first)) - np.arange(n)
    bucket = np.full(n, -1, np.int64)

    def number(at: np.ndarray, keys: np.ndarray) -> None:
        _, which, count = np.unique(keys, return_inverse=True, return_counts=True)
        bucket[:] = -1
        bucket[at] = np.where(count[which] > 1, which, -1)

    at = np.flatnonzero(room >= depth)
    number(at, codes[at] + np.repeat(group, np.diff(first))[at] * (n + 1))
    while depth < window:
        step = min(depth, window - depth)
        at = np.flatnonzero((bucket >= 0) & (room >= depth + step))
        at = at[bucket[at + step] >= 0]
        number(at, bucket[at] * (n + 1) + bucket[at + step])
        depth += step
    return bucket


def pieces_of(symbols: Symbols, a: np.ndarray, n: np.ndarray, level: int, window: int, gram: int) -> tuple[np.ndarray, list[bytes], list[bytes], np.ndarray, np.ndarray]:
    """Of each sequence's n windows from its a-th on, the pieces: (sequence, core's digest, whole's digest, first window, windows).

    A window's place is the distance from its start to its anchor. A piece has the windows that follow one another
    with one anchor and places in one block of 2**level; its core is what all windows of such places share.
    """
    anchor = grams.window_argmin(grams.runs_ids(symbols.ids, gram), window - gram + 1)
    which = np.repeat(np.arange(len(n)), n)
    x = (symbols.first[:-1] + a)[which] + np.arange(len(which)) - np.repeat(np.cumsum(n) - n, n)
    at = anchor[x]
    block = (at - x) >> level
    change = np.ones(len(x), np.bool_)
    change[1:] = (which[1:] != which[:-1]) | (at[1:] != at[:-1]) | (block[1:] != block[:-1])
    begin = np.flatnonzero(change)
    count = np.diff(np.append(begin, len(x)))
    x, at, block, which = x[begin], at[begin], block[begin], which[begin]
    low = block << level
    high = np.minimum(low + (1 << level) - 1, window - gram)
    cores = [grams.digest(b"%d " % k + p) for k, p in zip(block.tolist(), symbols.parts(at - low, at - high + window), strict=True)]
    wholes = [grams.digest(p) for p in symbols.parts(x, x + count + window - 1)]
    return which, cores, wholes, x - symbols.first[which], count


def parted(scratch: Scratch, members: DataFrame, *, window: int, gram: int, unit: str, block: int) -> tuple[DataFrame, DataFrame]:
    """Anchors with more classes than one task refines: ((kind, a, b), (anchor, kind, alone, a, n)).

    members: kind, alone, bytes; one row for each class of cells. Windows that are equal stand equally far from their
    anchor, so cells are cut into pieces by that distance, finer at each level. Pieces of equal bytes are repeated and
    are the first result; pieces whose core no other has are not repeated; pieces of one core that are no more than
    `block` symbols are the second, to be refined; the rest go on, one for each class.
    """

    def split(level: int):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                for row, raw, offsets in grams.chunks(b.column(4)):
                    symbols, own = Symbols.of(raw, offsets, unit), b.slice(row, len(offsets) - 1)
                    n = own.column(3).to_numpy()
                    n = np.where(n < 0, np.diff(symbols.first) - window + 1, n)
                    which, cores, wholes, a, count = pieces_of(symbols, own.column(2).to_numpy(), n, level, window, gram)
                    who = pa.array(which)
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(cores, pa.binary()), pa.array(wholes, pa.binary()), own.column(0).take(who), own.column(1).take(who), pa.array(a.astype(np.int32)), pa.array(count.astype(np.int32))],
                        names=["core", "whole", "kind", "alone", "a", "n"],
                    )

        return run

    left = members.select("kind", "alone", F.lit(0).alias("a"), F.lit(-1).alias("n"), "bytes")
    done = small = None
    for level in [*range((window - gram).bit_length() - 2, 0, -2), 0]:  # one level that holds all places would tell what the anchors tell
        pieces = scratch.table(left.mapInArrow(split(level), "core binary, whole binary, kind binary, alone boolean, a int, n int"))
        classes = scratch.table(pieces.groupBy("core", "whole").agg(((F.count("*") == 1) & F.bool_and("alone")).alias("alone"), F.min(F.struct("kind", "a", "n")).alias("member")))
        found = pieces.where("alone").join(classes.where("not alone").select("core", "whole"), ["core", "whole"], "left_semi").select("kind", "a", (F.col("a") + F.col("n")).alias("b"))
        size = F.sum(F.col("member.n").cast("long") + window - 1)
        shared = scratch.table(classes.groupBy("core").agg(F.count("*").alias("classes"), F.bool_or("alone").alias("open"), size.alias("size")).where("classes > 1 and open").select("core", (F.col("size") > block).alias("many")))
        rows = scratch.table(classes.join(shared, "core").select("core", "member.*", "alone", "many"))
        own = rows.where("not many").select(F.xxhash64("core").alias("anchor"), "kind", "alone", "a", "n")  # cores that share an identifier share no window
        done, small = (found, own) if done is None else (done.union(found), small.union(own))
        if not rows.where("many").limit(1).count():
            break
        left = rows.where("many").join(members.select("kind", "bytes"), "kind").select("kind", "alone", "a", "n", "bytes")
    return done, small


def repeated_starts(docs: DataFrame, *, window: int, unit: str, id_col: str, text_col: str, block: int = BLOCK) -> DataFrame:
    """(id, row_key, starts array<struct<a,b>>): half-open runs of starts of windows that also start anywhere else."""
    texts = docs.select(F.col(id_col).alias("id"), row_key(id_col, text_col).alias("row_key"), F.col(text_col).cast("string").alias("_text"))
    kind, gram = texts.schema["id"].dataType.simpleString(), max(1, window // 4)

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for row, raw, offsets in grams.chunks(b.column(2)):
                symbols = Symbols.of(raw, offsets, unit)
                text, start, count, anchor, twice = cells_of(symbols, window, gram)
                a = start + symbols.first[text]
                digests = [grams.digest(x) for x in symbols.parts(a, a + count + window - 1)]
                who = pa.array(row + text)
                yield pa.RecordBatch.from_arrays(
                    [b.column(0).take(who), b.column(1).take(who), pa.array(start.astype(np.int32)), pa.array(count.astype(np.int32)), pa.array(anchor), pa.array(digests, pa.binary()), pa.array(twice)],
                    names=["id", "row_key", "s", "n", "anchor", "kind", "twice"],
                )

    def expand(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for row, raw, offsets in grams.chunks(b.column(0)):
                symbols, lists = Symbols.of(raw, offsets, unit), b.column(1).slice(row, len(offsets) - 1)
                flat = lists.flatten()
                s = flat.field("s").to_numpy() + np.repeat(symbols.first[:-1], np.diff(lists.offsets.to_numpy()))
                parts = symbols.parts(s, s + flat.field("n").to_numpy() + window - 1)
                yield pa.RecordBatch.from_arrays([flat.field("anchor"), flat.field("kind"), flat.field("alone"), flat.field("many"), pa.array(parts, pa.binary())], names=["anchor", "kind", "alone", "many", "bytes"])

    def cut_out(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """The bytes of the n windows from the a-th on."""
        for b in batches:
            for row, raw, offsets in grams.chunks(b.column(5)):
                symbols, own = Symbols.of(raw, offsets, unit), b.slice(row, len(offsets) - 1)
                a = symbols.first[:-1] + own.column(3).to_numpy()
                parts = symbols.parts(a, a + own.column(4).to_numpy() + window - 1)
                yield pa.RecordBatch.from_arrays([*[own.column(k) for k in range(4)], pa.array(parts, pa.binary())], names=["anchor", "kind", "alone", "a", "bytes"])

    def compare(rows: pa.Table) -> pa.RecordBatch:
        """(kind, a, b) of the runs of repeated windows in cells that are alone in their class; rows come by whole anchors.

        rows: anchor, kind, alone, the number of the first window, and the windows' bytes.
        """
        kinds, anchors = rows.column("kind").combine_chunks(), rows.column("anchor").to_numpy()
        raw, offsets = grams.texts(rows.column("bytes").combine_chunks())
        symbols = Symbols.of(raw, offsets, unit)
        group = np.cumsum(np.concatenate([[0], anchors[1:] != anchors[:-1]])) if len(anchors) else np.zeros(0, np.int64)
        codes, depth = symbols.codes() if unit == "words" or window >= 8 else (raw.astype(np.int64), 1)
        hit = refine(codes, depth, symbols.first, group, window) >= 0
        first, owner = symbols.first, np.repeat(np.arange(rows.num_rows), np.diff(symbols.first))
        hit &= rows.column("alone").to_numpy().astype(bool)[owner]
        change = np.zeros(len(hit), np.bool_)
        change[first[:-1][first[:-1] < len(hit)]] = True
        a, z = grams.runs_of(change, hit)
        moved = rows.column("a").to_numpy()[owner[a]] - first[owner[a]]
        return pa.RecordBatch.from_arrays([kinds.take(pa.array(owner[a])), pa.array((a + moved).astype(np.int32)), pa.array((z + 1 + moved).astype(np.int32))], names=["kind", "a", "b"])

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        for b in batches:
            if not b.num_rows:
                continue
            at = b.column(0).to_numpy()
            change = np.flatnonzero(at[1:] != at[:-1])
            if held and held[-1].column(0)[-1].as_py() != at[0]:
                yield compare(pa.Table.from_batches(held))
                held = []
            if len(change):
                end = int(change[-1]) + 1
                yield compare(pa.Table.from_batches([*held, b.slice(0, end)]))
                held = [b.slice(end)]
            else:
                held.append(b)
        if held:
            yield compare(pa.Table.from_batches(held))

    with Scratch(docs.sparkSession, "suffix") as scratch:
        cells = scratch.table(texts.mapInArrow(scan, f"id {kind}, row_key long, s int, n int, anchor long, kind binary, twice boolean"))
        # aggregates are materialised before they are joined back: a join with an aggregate that lies on the same
        # partitioning cannot be split where one anchor or class holds a large part of the rows
        live = scratch.table(cells.groupBy("anchor").agg(F.count("*").alias("k"), F.bool_or("twice").alias("twice")).where((F.col("k") > 1) | F.col("twice")).select("anchor"))
        found = scratch.table(cells.join(live, "anchor", "left_semi"), instead=cells)
        classes = scratch.table(found.groupBy("anchor", "kind").agg(F.count("*").alias("k"), F.bool_or("twice").alias("twice"), F.min(F.struct("id", "row_key", "s", "n")).alias("member")))
        size = F.sum(F.col("member.n").cast("long") + window - 1)
        anchors = classes.groupBy("anchor").agg(F.count("*").alias("classes"), F.min("k").alias("least"), F.bool_or("twice").alias("twice"), size.alias("size"))
        anchors = scratch.table(anchors.where((F.col("least") == 1) & ((F.col("classes") > 1) | F.col("twice"))).select("anchor", (F.col("size") > block).alias("many")))
        wanted = classes.join(anchors, "anchor").select(F.col("member.id").alias("wid"), F.col("member.row_key").alias("wkey"), F.struct("anchor", "kind", (F.col("k") == 1).alias("alone"), "many", F.col("member.s").alias("s"), F.col("member.n").alias("n")).alias("cell"))
        wanted = wanted.groupBy("wid", "wkey").agg(F.collect_list("cell").alias("cells"))
        joined = texts.join(wanted, F.col("id").eqNullSafe(F.col("wid")) & (F.col("row_key") == F.col("wkey"))).select("_text", "cells")
        members = scratch.table(joined.mapInArrow(expand, "anchor long, kind binary, alone boolean, many boolean, bytes binary"))
        few, done = members.where("not many").select("anchor", "kind", "alone", F.lit(0).alias("a"), "bytes"), None
        if members.where("many").limit(1).count():
            hot = members.where("many").select("kind", "alone", "bytes")
            done, small = parted(scratch, hot, window=window, gram=gram, unit=unit, block=block)
            few = few.union(small.join(hot.select("kind", "bytes"), "kind").select("anchor", "kind", "alone", "a", "n", "bytes").mapInArrow(cut_out, "anchor long, kind binary, alone boolean, a int, bytes binary"))
        runs = few.repartition("anchor").sortWithinPartitions("anchor").mapInArrow(judge, "kind binary, a int, b int")
        if done is not None:
            runs = runs.union(done)
        known = found.join(classes.select("anchor", "kind", "k"), ["anchor", "kind"])
        whole = known.where("k > 1").select("id", "row_key", F.struct(F.col("s").alias("a"), (F.col("s") + F.col("n")).alias("b")).alias("run"))
        part = known.where("k = 1").join(runs, "kind").select("id", "row_key", F.struct((F.col("s") + F.col("a")).alias("a"), (F.col("s") + F.col("b")).alias("b")).alias("run"))
        return cut(whole.union(part).groupBy("id", "row_key").agg(F.collect_list("run").alias("starts")))


RESULT = T.StructType(
    [
        T.StructField("n_bytes", T.LongType()),
        T.StructField("n_removed", T.LongType()),
        T.StructField("spans", T.ArrayType(T.StructType([T.StructField("start", T.LongType()), T.StructField("end", T.LongType())]))),
        T.StructField("kept", T.BinaryType()),
    ]
)


def find_repeated(docs: DataFrame, *, window: int = WINDOW, unit: str = "bytes", id_col: str = "doc_id", text_col: str = "text", block: int = BLOCK) -> DataFrame:
    """docs with n_bytes, n_removed, spans and kept: spans are half-open byte runs to remove, kept the bytes that stay.

    With unit="words", window counts words, and a span goes from its first word's first byte to its last word's last.
    """
    if unit not in ("bytes", "words"):
        raise ValueError(f"unit is bytes or words, not {unit}")
    starts = repeated_starts(docs, window=window, unit=unit, id_col=id_col, text_col=text_col, block=block)

    def run(batch: pa.RecordBatch) -> dict:
        n_bytes, n_removed, spans, kept = [], [], [], []
        lists, column = batch.column(batch.schema.get_field_index("_starts")), batch.column(batch.schema.get_field_index("_text"))
        for row, raw, offsets in grams.chunks(column):
            begin, end, first = grams.words(raw, offsets, grams.SPACED) if unit == "words" else (None, None, offsets)
            for k in range(len(offsets) - 1):
                own, runs = raw[offsets[k] : offsets[k + 1]], lists[row + k].as_py()
                n_bytes.append(len(own))
                if not runs:
                    n_removed.append(0)
                    spans.append([])
                    kept.append(own.tobytes())
                    continue
                gone = grams.covered(int(first[k + 1] - first[k]), np.array([r["a"] for r in runs]), np.array([r["b"] for r in runs]) + window - 1)
                turn = np.flatnonzero(np.diff(np.concatenate([[0], gone.view(np.int8), [0]])))
                a, z = turn[::2], turn[1::2]
                if unit == "words":
                    a, z = begin[first[k] + a] - offsets[k], end[first[k] + z - 1] - offsets[k]
                stays = ~grams.covered(len(own), a, z)
                n_removed.append(int((z - a).sum()))
                spans.append([{"start": x, "end": y} for x, y in zip(a.tolist(), z.tolist(), strict=True)])
                kept.append(own[stays].tobytes())
        return {"n_bytes": n_bytes, "n_removed": n_removed, "spans": spans, "kept": kept}

    taken = {f.name for f in RESULT}
    hidden, at = hide(docs)
    left = hidden.select(F.col(at[id_col]).alias("_id"), F.xxhash64(at[id_col], F.col(at[text_col]).cast("string")).alias("_key"), F.col(at[text_col]).cast("string").alias("_text"), *[n for c, n in at.items() if c not in (id_col, text_col)])
    right = starts.withColumnsRenamed({"id": "_right_id", "row_key": "_right_key", "starts": "_starts"})
    joined = left.join(right, F.col("_id").eqNullSafe(F.col("_right_id")) & (F.col("_key") == F.col("_right_key")), "left").drop("_right_id", "_right_key", "_key")
    found = map_batches(joined, run, RESULT)
    back = at | {id_col: "_id", text_col: "_text"}
    return found.select(*[F.col(n).alias(c) for c, n in back.items() if c.lower() not in taken], *[f.name for f in RESULT])


def remove_repeated(docs: DataFrame, *, window: int = WINDOW, unit: str = "bytes", id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """docs with the repeated passages cut out of their texts; columns stay as they are. Null texts stay null."""
    hidden, at = hide(docs)
    found = find_repeated(hidden, window=window, unit=unit, id_col=at[id_col], text_col=at[text_col])

    def decode(batch: pa.RecordBatch) -> dict:
        kept, count = batch.column(batch.schema.get_field_index("kept")), batch.column(batch.schema.get_field_index("n_removed"))
        text = batch.column(batch.schema.get_field_index(at[text_col]))
        return {"cut": [bytes(k.as_py()).decode(errors="ignore") if n.as_py() else t.as_py() for k, n, t in zip(kept, count, text, strict=True)]}

    return unhide(map_batches(found, decode, T.StructType([T.StructField("cut", T.StringType())])), at, {text_col: "cut"})


def op10_suffix(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = find_repeated(text_only(spark.read.parquet(f"{sf_dir}/documents.parquet")))
    return found.select("doc_id", "n_bytes", "n_removed", F.size("spans").cast("long").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"))
