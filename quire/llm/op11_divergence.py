"""Source divergence audit: how far the word frequencies of each source are from those of every other of its language.

Terms are runs of letters (A-Z lower-cased) and non-ASCII characters. A language keeps the terms that stand in at least
`least_docs` of its documents. With smoothed shares p of a source and q of another, in billionths, a term adds
(p - q)**2 / (p + q), rounded down; a pair's value is the sum over all kept terms, also those that neither has. The
terms that set a source apart from its whole language are priced alike. All arithmetic is in integers.

Method: a segment tree of counts for each source over the ids of a language's terms, hash-consed, so that identical
subtrees of counts are one node, wherever they stand and whoever has them. Two trees are walked together from their
roots, and each level's equal pairs of nodes are walked on once, with the number of places they stand for; what is left
at the leaves are distinct pairs of counts, each priced once. Most terms are rare, so most subtrees are alike.

Scale: words are counted per task before anything is shuffled. A language's terms are dealt to blocks of some `block`
by a hash, each a subtree that one task builds for `side` sources against `side` others (tiles, where a language has more
sources); a block's values are sums of integers, so blocks add up. No task sees all terms of a language, or all
sources.

Defined cases: null text, language and source count as empty strings, and an empty name is a group like any other;
texts without terms make groups of no counts, with all other sources to be compared with; a language without kept terms
has pairs of value 0 and no terms; a language with one source has no pairs; repeated rows count each; an empty table
gives an empty result; other columns are ignored.
"""

from __future__ import annotations

from collections import Counter, defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from quire.llm.common import Scratch, cut

LEAST_DOCS, TOP_TERMS = 10, 10
BLOCK, SIDE = 4096, 32
SCALE_DIGITS = 3  # the scale is 1000**3: a share is in billionths
#: Entries that a task counts before it lets them go, and pairs of nodes that it walks at once.
HELD, WALKED = 400_000, 1 << 20

_LETTERS = bytes(b + 32 if 65 <= b <= 90 else b if 97 <= b <= 122 or b >= 128 else 32 for b in range(256))


def terms_of(text: bytes) -> list[bytes]:
    return text.translate(_LETTERS).split()


def shares(counts: np.ndarray, total: np.ndarray | int, kept: int) -> np.ndarray:
    """1 + floor(10**9 * (count + 2) / (total + 2 * kept)), by long division in base 1000: exact below 9 * 10**15."""
    d = total + 2 * kept
    out, rest = np.divmod(counts.astype(np.int64) + 2, d)
    for _ in range(SCALE_DIGITS):
        step, rest = np.divmod(rest * 1000, d)
        out = out * 1000 + step
    return out + 1


def price(p: np.ndarray, q: np.ndarray) -> np.ndarray:
    return (p - q) ** 2 // (p + q)


class Forest:
    """Hash-consed segment trees of several count vectors of one length.

    Level 0 has a node for each distinct count; a node above stands for a distinct pair of nodes below. Odd levels end
    in a node of its own kind that stands for no terms.
    """

    def __init__(self, counts: np.ndarray):
        """counts: a row for each tree, a column for each term."""
        self.values, at = np.unique(counts, return_inverse=True)
        at = at.reshape(counts.shape)
        self.pairs: list[np.ndarray] = []  # of each level from 1 on: the two nodes below of each node; -1 is none
        while at.shape[1] > 1:
            if at.shape[1] % 2:
                at = np.concatenate([at, np.full((len(at), 1), -1)], axis=1)
            left, right = at[:, ::2].ravel(), at[:, 1::2].ravel()
            wide = int(at.max()) + 2
            keys, at2 = np.unique(left * wide + right + 1, return_inverse=True)
            self.pairs.append(np.stack([keys // wide, keys % wide - 1], axis=1))
            at = at2.reshape(len(at), -1)
        self.roots = at[:, 0]

    def leaf_pairs(self, a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """(which pair of trees, count in a's tree, count in b's, at how many terms), each combination once.

        All pairs of trees (a[i], b[i]) are walked together.
        """
        who, x, y, times = np.arange(len(a)), self.roots[a], self.roots[b], np.ones(len(a), np.int64)
        for pairs in reversed(self.pairs):
            below_x, below_y = pairs[x], pairs[y]
            there = below_x[:, 1] >= 0  # the right one may be none; then it is none in all trees
            who = np.concatenate([who, who[there]])
            x, y = np.concatenate([below_x[:, 0], below_x[there, 1]]), np.concatenate([below_y[:, 0], below_y[there, 1]])
            times = np.concatenate([times, times[there]])
            wide = int(max(x.max(), y.max())) + 1
            keys, at = np.unique((who * wide + x) * wide + y, return_inverse=True)
            times = np.bincount(at, times, len(keys)).astype(np.int64)
            who, x, y = keys // wide // wide, keys // wide % wide, keys % wide
        return who, self.values[x], self.values[y], times


def _scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(lang, source, term, n, docs): occurrences and documents of each term in what this task has read; term null names the group."""
    counts: dict[tuple, list[Counter]] = defaultdict(lambda: [Counter(), Counter()])
    held = 0

    def out() -> Iterator[pa.RecordBatch]:
        for (lang, source), (n, docs) in counts.items():
            terms = [None, *n]
            columns = [pa.array([lang] * len(terms), pa.string()), pa.array([source] * len(terms), pa.string()), pa.array(terms, pa.binary()).cast(pa.string()), pa.array([0, *n.values()], pa.int64()), pa.array([0, *(docs[t] for t in n)], pa.int64())]
            yield pa.RecordBatch.from_arrays(columns, names=["lang", "source", "term", "n", "docs"])
        counts.clear()

    for b in batches:
        lang, source, text = (pc.fill_null(b.column(k), "") for k in range(3))
        for la, so, words in zip(lang.to_pylist(), source.to_pylist(), map(terms_of, text.cast(pa.binary()).to_pylist()), strict=True):
            n, docs = counts[la, so]
            own = Counter(words)
            held -= len(n)
            n.update(own)
            docs.update(own.keys())
            held += len(n)
            if held > HELD:
                yield from out()
                held = 0
    yield from out()


def _block(key: tuple, rows: pa.Table) -> pa.Table:
    """The values of one block's terms, for one tile of sources.

    rows: kind 0, a source (or, as place -1, the language) with its total; kind 1, a count of a term. Gives (i, j, term,
    value): a pair of places with term null, or a source's foremost terms with j null.
    """
    lang, low, high = key[0].as_py(), key[2].as_py(), key[3].as_py()
    kind, place, n = (rows.column(c).to_numpy().astype(np.int64) for c in ("kind", "place", "n"))
    kept = int(rows.column("kept")[0].as_py())
    heads = np.flatnonzero(kind == 0)
    heads = heads[np.argsort(place[heads])]
    places, totals = place[heads], n[heads]
    cells = np.flatnonzero(kind == 1)
    if not len(cells):  # hashes may leave a block empty
        return pa.table({"lang": pa.array([], pa.string()), "i": pa.array([], pa.int64()), "j": pa.array([], pa.int64()), "term": pa.array([], pa.string()), "value": pa.array([], pa.int64())})
    terms = rows.column("term").take(pa.array(cells)).combine_chunks().dictionary_encode()
    counts = np.zeros((len(places), len(terms.dictionary)), np.int64)
    counts[np.searchsorted(places, place[cells]), terms.indices.to_numpy()] = n[cells]
    order = np.lexsort(counts[::-1])  # terms that are alike become neighbours, and so subtrees that are alike
    forest = Forest(counts[:, order])
    i, j = np.meshgrid(np.arange(len(places)), np.arange(len(places)), indexing="ij")
    chunk = places // SIDE
    real = (places >= 0)[i] & (places >= 0)[j] & (i < j) & (np.minimum(chunk[i], chunk[j]) == low) & (np.maximum(chunk[i], chunk[j]) == high)
    i, j = i[real], j[real]
    values = np.zeros(len(i), np.int64)
    step = max(1, WALKED // max(1, counts.shape[1]))
    for at in range(0, len(i), step):
        who, x, y, times = forest.leaf_pairs(i[at : at + step], j[at : at + step])
        p, q = shares(x, totals[i[at + who]], kept), shares(y, totals[j[at + who]], kept)
        np.add.at(values, at + who, price(p, q) * times)
    out = [(places[i], places[j], pa.nulls(len(i), pa.string()), values)]
    if low == high:
        q = shares(counts[0], int(totals[0]), kept)  # the language stands first, as place -1
        for k in range(1, len(places)):
            own = np.flatnonzero(counts[k])
            p = shares(counts[k, own], int(totals[k]), kept)
            f = price(p, q[own])
            own, f = own[p > q[own]], f[p > q[own]]
            if len(f) > TOP_TERMS:
                least = np.partition(f, -TOP_TERMS)[-TOP_TERMS]
                own, f = own[f >= least], f[f >= least]
            names = terms.dictionary.take(pa.array(own))
            best = sorted(range(len(f)), key=lambda m, f=f, names=names: (-f[m], names[m].as_py().encode()))[:TOP_TERMS]
            out.append((np.full(len(best), places[k]), np.full(len(best), -1), names.take(pa.array(best, pa.int64())), f[best]))
    flat = [pa.concat_arrays([pa.array(x[c]) if c != 2 else x[c] for x in out]) for c in range(4)]
    return pa.table({"lang": pa.array([lang] * len(flat[0]), pa.string()), "i": flat[0], "j": flat[1], "term": flat[2], "value": flat[3]})


def audit(docs: DataFrame, *, least_docs: int = LEAST_DOCS, block: int = BLOCK, text_col: str = "text", lang_col: str = "lang", source_col: str = "source") -> DataFrame:
    """(lang, source, part, item, value, rank): part 'pair' prices each other source of the language, 'term' the foremost terms."""
    spark = docs.sparkSession
    texts = docs.select(F.col(lang_col).cast("string"), F.col(source_col).cast("string"), F.col(text_col).cast("string"))
    with Scratch(spark, "divergence") as scratch:
        seen = texts.mapInArrow(_scan, "lang string, source string, term string, n long, docs long")
        counts = scratch.table(seen.groupBy("lang", "term", "source").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs")))
        kept = scratch.table(counts.where("term is not null").groupBy("lang", "term").agg(F.sum("docs").alias("docs"), F.sum("n").alias("n")).where(F.col("docs") >= least_docs).drop("docs"))
        langs = scratch.table(kept.groupBy("lang").agg(F.count("*").alias("kept"), F.sum("n").alias("n")).withColumn("blocks", F.ceil(F.col("kept") / block)))
        own = counts.where("term is not null").join(kept.select("lang", "term"), ["lang", "term"], "left_semi").select("lang", "source", "term", "n")
        totals = scratch.table(own.groupBy("lang", "source").agg(F.sum("n").alias("n")))
        groups = counts.where("term is null").select("lang", "source").join(totals, ["lang", "source"], "left").fillna(0, "n")
        groups = scratch.table(groups.withColumn("place", F.row_number().over(W.partitionBy("lang").orderBy("source")) - 1))
        chunks = groups.groupBy("lang").agg((F.floor(F.max("place") / SIDE)).cast("int").alias("last"))
        shape = scratch.table(langs.join(chunks, "lang").select("lang", "kept", "blocks", "last"))
        named = own.join(groups.select("lang", "source", "place"), ["lang", "source"]).select("lang", "place", "term", "n")
        cells = named.union(kept.select("lang", F.lit(-1), "term", "n")).join(shape, "lang").select(F.lit(1).alias("kind"), "lang", "place", "term", "n", "kept", "last", F.pmod(F.xxhash64("term"), F.col("blocks")).alias("block"))
        heads = groups.select("lang", "place", "n").union(langs.select("lang", F.lit(-1), "n")).join(shape, "lang")
        heads = heads.select(F.lit(0).alias("kind"), "lang", "place", F.lit(None).cast("string").alias("term"), "n", "kept", "last", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)).alias("block"))
        rows = cells.union(heads)
        mine = F.floor(F.col("place") / SIDE).cast("int")
        all_tiles = F.flatten(F.transform(F.sequence(F.lit(0), F.col("last")), lambda k: F.transform(F.sequence(k, F.col("last")), lambda m: F.struct(k.alias("low"), m.alias("high")))))
        own_tiles = F.transform(F.sequence(F.lit(0), F.col("last")), lambda k: F.struct(F.least(mine, k).alias("low"), F.greatest(mine, k).alias("high")))
        tiles = F.when(F.col("place") < 0, all_tiles).otherwise(own_tiles)  # the language's counts name all terms of a block, also those that a tile's sources lack
        rows = rows.withColumn("tile", F.explode(tiles)).select("lang", "block", F.col("tile.low").alias("low"), F.col("tile.high").alias("high"), "kind", "place", "term", "n", "kept")
        found = scratch.table(rows.groupBy("lang", "block", "low", "high").applyInArrow(_block, "lang string, i long, j long, term string, value long"))
        values = found.where("term is null").groupBy("lang", "i", "j").agg(F.sum("value").alias("value"))
        one, other = groups.select("lang", "source", F.col("place").alias("a")), groups.select("lang", F.col("source").alias("item"), F.col("place").alias("b"))
        pairs = one.join(other, "lang").where("a <> b").withColumns({"i": F.least("a", "b").cast("long"), "j": F.greatest("a", "b").cast("long")})
        pairs = pairs.join(values, ["lang", "i", "j"], "left").select("lang", "source", F.lit("pair").alias("part"), "item", F.coalesce("value", F.lit(0)).alias("value"))
        terms = found.where("term is not null").select("lang", F.col("i").cast("int").alias("a"), F.col("term").alias("item"), "value").join(one, ["lang", "a"]).select("lang", "source", F.lit("term").alias("part"), "item", "value")
        order = W.partitionBy("lang", "source", "part").orderBy(F.desc("value"), "item")
        pairs = pairs.withColumn("rank", F.row_number().over(order))
        terms = terms.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= TOP_TERMS)
        return cut(pairs.union(terms))


def op11_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audit(spark.read.parquet(f"{sf_dir}/documents.parquet"))
