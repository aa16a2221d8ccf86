"""SimHash near-duplicates by multi-index hashing.

Fingerprints are cut into segments. By the pigeonhole principle two fingerprints at distance r agree, in one of
the s segments, but for r // s bits. So each distinct fingerprint is put into a table under each segment's value,
and looks up the small Hamming ball around each of its own values; of the two directions of a lookup only the one
that sets the mask's highest bit is made. Whatever shares a table key is verified by the complete distance.

Equal fingerprints are one node. Within a table key only a spanning forest of the verified links is emitted, so a
group of g mutually near fingerprints gives g - 1 links and not all pairs. A key with more than `block` entries is
dealt out by blocks: each pair of blocks is one cell, worked on alone. Nothing is left out and nothing gathers an
unbounded group in one task. Links are then joined to components in tables.

Defined cases: a null text counts as empty; texts without words have fingerprint zero and are linked like any
other; fewer words than a shingle count as one shingle; repeated shingles count as often as they occur; ties (a
bit set in exactly half) give 0; repeated rows are linked with themselves; rows whose id is null get a fingerprint
but no component; an empty table gives an empty result; other columns are not read.
"""

from __future__ import annotations

import itertools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quire.llm import grams
from quire.llm.common import Scratch, cut, map_batches, text_only
from quire.llm.components import components

BLOCK = 2048


def _shingles(raw: np.ndarray, offsets: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """The hash of each shingle of all texts, one text after another, and how many each text has."""
    data, a, b, first = grams.spaced(grams.LOWER[raw], offsets)
    if not len(a):
        return np.zeros(0, np.uint64), np.zeros(len(offsets) - 1, np.int64)
    text = data.tobytes()
    count = np.diff(first)
    shingles = np.where(count > 0, np.maximum(count - k + 1, 1), 0)
    begin = np.repeat(first[:-1] - np.concatenate([[0], np.cumsum(shingles)[:-1]]), shingles) + np.arange(shingles.sum())
    last = np.minimum(begin + k, np.repeat(first[1:], shingles)) - 1
    digest = xxhash.xxh64_intdigest
    hashes = np.fromiter((digest(text[x:y], 42) for x, y in zip(a[begin].tolist(), b[last].tolist(), strict=True)), np.uint64, len(begin))
    return hashes, shingles


def fingerprints_of(raw: np.ndarray, offsets: np.ndarray, k: int, sketches: list | None = None, digests: list | None = None) -> np.ndarray:
    """The 64-bit SimHash of each text. sketches gets an array of the texts' sketches: eight bytes, each of the least hash in an eighth of the range.

    digests gets an array of 64-bit digests of the texts' shingles, in any order.
    """
    out = np.zeros(len(offsets) - 1, np.uint64)
    for asked in (sketches, digests):
        if asked is not None:
            asked.append(np.zeros(len(out), np.uint64))
    hashes, shingles = _shingles(raw, offsets, k)
    if not len(hashes):
        return out
    some = np.flatnonzero(shingles)
    edges = np.concatenate([[0], np.cumsum(shingles[some])])
    if digests is not None:
        digests[-1][some] = np.add.reduceat(grams.mix(hashes + np.uint64(1)), edges[:-1])
    if sketches is not None:
        mixed = grams.mix(hashes)
        for part in range(8):
            least = np.minimum.reduceat(np.where(mixed >> np.uint64(61) == part, mixed, np.uint64(0xFFFFFFFFFFFFFFFF)), edges[:-1])
            sketches[-1][some] |= (grams.mix(least) & np.uint64(0xFF)) << np.uint64(8 * part)
    step = 1 << 16
    totals = np.zeros((len(some), 64), np.int64)
    for lo in range(0, len(hashes), step):
        part = np.unpackbits(hashes[lo : lo + step].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        x, y = np.searchsorted(edges, lo, "right") - 1, np.searchsorted(edges, min(lo + step, len(hashes)), "left")
        totals[x:y] += np.add.reduceat(part, np.maximum(edges[x:y] - lo, 0), axis=0, dtype=np.int32)
    set_ = totals * 2 > shingles[some][:, None]
    out[some] = np.packbits(set_, axis=1, bitorder="little").view(np.uint64)[:, 0]
    return out


def fingerprint(docs: DataFrame, *, shingle_words: int = 4, text_col: str = "text") -> DataFrame:
    """docs with fingerprint, the 64 bits as a signed long, and sketch, eight bytes that agree as often as shingle sets do."""

    def run(batch: pa.RecordBatch) -> dict:
        column, sketches = batch.column(batch.schema.get_field_index(text_col)), []
        parts = [fingerprints_of(data, offsets, shingle_words, sketches) for _, data, offsets in grams.chunks(column)]
        return {"fingerprint": pa.array(np.concatenate(parts).view(np.int64)), "sketch": pa.array(np.concatenate(sketches).view(np.int64))}

    return map_batches(docs, run, T.StructType([T.StructField("fingerprint", T.LongType()), T.StructField("sketch", T.LongType())]))


def segments_of(count: int) -> list[tuple[int, int]]:
    """(lowest bit, width) of each segment of 64 bits."""
    cuts = [64 * i // count for i in range(count + 1)]
    return [(a, b - a) for a, b in itertools.pairwise(cuts)]


def _ball(width: int, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """Masks of 1 to radius bits, and the highest bit of each."""
    masks = [sum(1 << b for b in bits) for r in range(1, radius + 1) for bits in itertools.combinations(range(width), r)]
    return np.array(masks, np.uint64), np.array([1 << (m.bit_length() - 1) for m in masks], np.uint64)


def _index(nodes: DataFrame, ball: int, segments: int) -> DataFrame:
    """(key, fingerprint, node, sketch, probe): the table's entries and the lookups."""
    layout = [(i, a, w, *_ball(w, ball)) for i, (a, w) in enumerate(segments_of(segments))]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            fp, node, sketch = b.column(0).to_numpy().view(np.uint64), b.column(1).to_numpy(), b.column(2).to_numpy()
            for i, low, width, masks, high in layout:
                value = (fp >> np.uint64(low)) & np.uint64((1 << width) - 1)
                row, mask = np.nonzero((value[:, None] & high[None, :]) == 0) if len(masks) else (np.zeros(0, int),) * 2
                key = np.concatenate([value, value[row] ^ masks[mask]]) if len(masks) else value
                whose = np.concatenate([np.arange(len(fp)), row])
                yield pa.RecordBatch.from_arrays(
                    [pa.array(key.astype(np.int64) * segments + i), pa.array(fp[whose].view(np.int64)), pa.array(node[whose]), pa.array(sketch[whose]), pa.array(np.arange(len(whose)) >= len(fp))],
                    names=["key", "fingerprint", "node", "sketch", "probe"],
                )

    return nodes.select("fingerprint", "node", "sketch").mapInArrow(run, "key long, fingerprint long, node long, sketch long, probe boolean")


def _alike(x: np.ndarray, y: np.ndarray, least: int) -> np.ndarray:
    """Whether at least so many of the sketches' eight bytes agree."""
    return ((x ^ y)[..., None].view(np.uint8) == 0).sum(-1) >= least


def forest(fp: np.ndarray, sketch: np.ndarray, probe: np.ndarray, radius: int, least: int, spare: int = 8) -> tuple[np.ndarray, np.ndarray]:
    """Links that span what is linked among entries of one cell, all of them or, if they are over `spare` an entry, a forest; two lookups are not linked, the table is between."""
    table = np.flatnonzero(~probe)
    pairs_a, pairs_b, n = [], [], 0
    for i in range(0, len(table), 256):
        rows = table[i : i + 256]
        x, y = np.nonzero(np.bitwise_count(fp[rows][:, None] ^ fp[None, :]) <= radius)
        x = rows[x]
        once = (x < y) | (probe[y] & (x != y))
        x, y = x[once], y[once]
        if least:
            ok = _alike(sketch[x], sketch[y], least)
            x, y = x[ok], y[ok]
        pairs_a.append(x)
        pairs_b.append(y)
        n += len(x)
        if n > spare * len(fp):
            return _walk(fp, sketch, probe, radius, least)
    return np.concatenate(pairs_a), np.concatenate(pairs_b)


def _walk(fp: np.ndarray, sketch: np.ndarray, probe: np.ndarray, radius: int, least: int) -> tuple[np.ndarray, np.ndarray]:
    """The forest by walking from entry to entry, each compared with what is not yet reached."""
    left, a, b = np.arange(len(fp)), [], []
    while len(left):
        queue, left = [left[0]], left[1:]
        while queue and len(left):
            x = queue.pop()
            near = np.bitwise_count(fp[left] ^ fp[x]) <= radius
            if probe[x]:
                near &= ~probe[left]
            if least:
                near &= _alike(sketch[left], sketch[x], least)
            found = left[near]
            if len(found):
                a += [x] * len(found)
                b += found.tolist()
                queue += found.tolist()
                left = left[~near]
    return np.array(a, np.int64), np.array(b, np.int64)


def _cells(rows: DataFrame, radius: int, least: int, spare: int) -> DataFrame:
    """Links of each cell; rows come sorted by cell."""

    def links(key: np.ndarray, fp: np.ndarray, node: np.ndarray, sketch: np.ndarray, probe: np.ndarray) -> pa.RecordBatch:
        edge = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))
        size = np.diff(np.append(edge, len(key)))
        live = np.flatnonzero((size > 1) & (np.add.reduceat(~probe, edge, dtype=np.int64) > 0))
        x = edge[live[size[live] == 2]]
        ok = (np.bitwise_count(fp[x] ^ fp[x + 1]) <= radius) & ~(probe[x] & probe[x + 1])
        if least:
            ok &= _alike(sketch[x], sketch[x + 1], least)
        out_a, out_b = [node[x[ok]]], [node[x[ok] + 1]]
        for s, n in zip(edge[live[size[live] > 2]].tolist(), size[live[size[live] > 2]].tolist(), strict=True):
            a, b = forest(fp[s : s + n], sketch[s : s + n], probe[s : s + n], radius, least, spare)
            out_a.append(node[s + a])
            out_b.append(node[s + b])
        u, v = np.concatenate(out_a), np.concatenate(out_b)
        other = u != v
        return pa.RecordBatch.from_arrays([pa.array(u[other]), pa.array(v[other])], names=["u", "v"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = None
        for b in batches:
            got = [np.asarray(c.to_numpy(zero_copy_only=False)) for c in b.columns]
            got[1] = got[1].view(np.uint64)
            held = got if held is None else [np.concatenate([x, y]) for x, y in zip(held, got, strict=True)]
            change = np.flatnonzero(held[0][1:] != held[0][:-1])
            if len(change):
                end = change[-1] + 1
                yield links(*(x[:end] for x in held))
                held = [x[end:] for x in held]
        if held is not None and len(held[0]):
            yield links(*held)

    return rows.mapInArrow(run, "u long, v long")


def links(nodes: DataFrame, *, radius: int = 4, segments: int = 3, least: int = 0, block: int = BLOCK, spare: int = 8, ball: int | None = None) -> DataFrame:
    """(u, v): links that connect all nodes with fingerprints at `radius` or fewer differing bits.

    With a ball smaller than radius // segments lookups are fewer, and near nodes that share no segment but for so many
    bits may be left apart; only for callers that look for what is missed by other means.
    nodes: fingerprint, node and sketch. With least, so many bytes of two nodes' sketches must agree besides. A cell with
    more than `spare` links an entry gives a forest, which begins at its least node, so that cells that hold the same
    nodes give the same links. Best run with arrow_rows of some 20,000.
    """
    index = _index(nodes, radius // segments if ball is None else ball, segments)
    hot = index.groupBy("key").agg(F.count("*").alias("n"), F.count_if(~F.col("probe")).alias("t")).where((F.col("n") > block) & (F.col("t") > 0))
    hot = hot.select("key", F.ceil(F.col("n") / block).cast("int").alias("blocks"))
    own = F.pmod(F.xxhash64("fingerprint", "node"), F.col("blocks")).cast("int")
    pairs = F.when(F.col("blocks").isNull(), F.array(F.lit(0).cast("long"))).otherwise(
        F.transform(F.sequence(F.lit(0), F.col("blocks") - 1), lambda j: F.least(own, j).cast("long") * F.col("blocks") + F.greatest(own, j) + 1)
    )
    rows = index.join(hot, "key", "left").withColumn("pair", F.explode(pairs)).select(F.xxhash64("key", "pair").alias("cell"), "fingerprint", "node", "sketch", "probe")
    return _cells(rows.repartition("cell").sortWithinPartitions("cell", "node"), radius, least, spare)


def near_duplicates(docs: DataFrame, *, shingle_words: int = 4, radius: int = 4, segments: int = 3, least: int = 0, block: int = BLOCK, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, fingerprint, component_id) of each document; component_id is the least id reachable by links.

    With least, documents are linked only if so many of their sketches' eight bytes agree besides, equal fingerprints included.
    """
    spark, by = docs.sparkSession, ["fingerprint", "sketch"] if least else ["fingerprint"]
    marked = cut(fingerprint(text_only(docs, id_col, text_col), shingle_words=shingle_words, text_col=text_col).select(id_col, "fingerprint", "sketch"))
    with Scratch(spark, "simhash", rows=20000) as scratch:
        nodes = cut(marked.where(F.col(id_col).isNotNull()).groupBy(*by).agg(F.min(id_col).cast("long").alias("node"), *([] if least else [F.lit(0).cast("long").alias("sketch")])))
        roots = components(scratch.table(links(nodes, radius=radius, segments=segments, least=least, block=block)))
    named = nodes.join(roots, nodes["node"] == roots["u"], "left").select(*by, F.coalesce("root", "node").alias("component_id"))
    return marked.join(named, by, "left").select(id_col, "fingerprint", F.when(F.col(id_col).isNotNull(), F.col("component_id")).alias("component_id"))


def keep_one(docs: DataFrame, *, shingle_words: int = 5, similarity: float = 0.8, segments: int = 5, block: int = BLOCK, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """docs with one document of each group of near copies: the one with the least id. Rows with a null id stay.

    Groups are the components of all pairs whose shingle sets have a Jaccard similarity of `similarity` or more; see quire.llm.jaccard.
    """
    from quire.llm import jaccard

    known = jaccard.groups(docs, shingle_words=shingle_words, similarity=similarity, segments=segments, block=block, id_col=id_col, text_col=text_col)
    stays = known.where(F.col("_component") == F.col(id_col)).select(id_col)
    kept = docs.join(stays, id_col, "left_semi").select(*docs.columns)
    if known.where("_n > 1").limit(1).count():
        kept = kept.dropDuplicates([id_col])
    nameless = docs.where(F.col(id_col).isNull())
    return kept.unionByName(nameless)


def op3_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = near_duplicates(spark.read.parquet(f"{sf_dir}/documents.parquet"), shingle_words=4, radius=4)
    return found.select("doc_id", F.lpad(F.lower(F.hex("fingerprint")), 16, "0").alias("fingerprint"), "component_id")
