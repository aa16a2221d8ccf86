"""A Merkle manifest of a dataset: a tree for each source, a tree over the sources' roots, and proofs of all rows.

A row is a leaf, the digest of its fields with their lengths. Leaves of a source stand by id; every `arity` consecutive
nodes become the digest of their hex digests, level by level, to the source's root; the sources' roots, by name, give
the root likewise. Digests are lower-case hex SHA-256.

Proofs come by octopus multiproof. Leaves are dealt to groups by blocks of consecutive ones. Each group computes the
least set of nodes that it must know beyond its own leaves, over all its blocks and levels at once; these coordinates
are joined with the table of nodes, so that a node comes to a group once, however many proofs use it. The group then
derives the nodes above its leaves, each once, and writes out each row's proof from them. A row whose text was tampered
with is folded to a root of its own, from the siblings of the untouched tree.

Scale: leaves are ranked by a range partition with counts of its parts, never by one task for a source. A level is one
aggregation with at most `arity` digests a group. A group holds some 2**16 leaves, and `arity` - 1 nodes at most for
each block and level.

Defined cases: a null field counts as "-", which no value gives; a null id stands first, and is not tampered with; rows
of one id stand in the order of their digests; equal rows are leaves of their own; a null source is a source of its
own, before all others; one row alone is leaf, source root and root, with an empty proof; an empty table gives an empty
result; other columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections import defaultdict
from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from quire.llm.common import Scratch, cut

ARITY, BLOCK, GROUP = 16, 1 << 12, 1 << 16
FIELDS = ["doc_id", "source", "lang", "n_chars", "text"]
#: The tree over the sources' roots; the sources' trees are numbered from 0.
TOP = -1


def _field(value: Column) -> Column:
    s = value.cast("string")
    return F.when(value.isNull(), "-").otherwise(F.concat(F.octet_length(s).cast("string"), F.lit(":"), s))


def leaf_digest(fields: list[Column]) -> Column:
    return F.sha2(F.concat(*[_field(f) for f in fields]).cast("binary"), 256)


def tampered_text(text: Column) -> Column:
    return F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def counts_up(n: int, arity: int) -> list[int]:
    """How many nodes each level has, from n leaves to one root."""
    out = [n]
    while out[-1] > 1:
        out.append(-(-out[-1] // arity))
    return out


def missing(leaves: np.ndarray, n: int, arity: int) -> list[np.ndarray]:
    """For each level below the root, the nodes that complete the runs of what the leaves lie under, but are not over them."""
    out = []
    for size in counts_up(n, arity)[:-1]:
        runs = np.unique(leaves // arity)
        members = (runs[:, None] * arity + np.arange(arity)).ravel()
        out.append(np.setdiff1d(members[members < size], leaves, assume_unique=True))
        leaves = runs
    return out


def derive(nodes: dict[tuple[int, int], str], leaves: np.ndarray, n: int, arity: int) -> None:
    """Adds all nodes above the leaves to nodes, (level, place) -> digest, which has the leaves and what missing() named."""
    for level, size in enumerate(counts_up(n, arity)[:-1]):
        runs = np.unique(leaves // arity)
        for r in runs.tolist():
            run = "".join(nodes[level, k] for k in range(r * arity, min(size, (r + 1) * arity)))
            nodes[level + 1, r] = hashlib.sha256(run.encode()).hexdigest()
        leaves = runs


class Paths:
    """Proofs and folds in one tree, of which nodes has all that is needed; what lies above a node is written once."""

    def __init__(self, nodes: dict[tuple[int, int], str], n: int, arity: int, above: list[tuple[str, str]]):
        """above: the runs above this tree's root, as (what stands before, what stands after) on each level."""
        self.nodes, self.sizes, self.arity, self.known, self.end = nodes, counts_up(n, arity), arity, {}, above

    def sides(self, level: int, k: int) -> list[tuple[str, str]]:
        """What stands before and after node k's own digest in its run, on this level and all above it."""
        if level == len(self.sizes) - 1:
            return self.end
        got = self.known.get((level, k))
        if got is None:
            a = k // self.arity * self.arity
            z = min(self.sizes[level], a + self.arity)
            own = ("".join(self.nodes[level, i] for i in range(a, k)), "".join(self.nodes[level, i] for i in range(k + 1, z)))
            got = [own, *self.sides(level + 1, k // self.arity)]
            if level:  # a leaf's own is asked for once
                self.known[level, k] = got
        return got


def fold(leaf: str, sides: list[tuple[str, str]]) -> str:
    for before, after in sides:
        leaf = hashlib.sha256(f"{before}{leaf}{after}".encode()).hexdigest()
    return leaf


def _levels(scratch: Scratch, leaves: DataFrame, most: int, arity: int) -> list[DataFrame]:
    """The tables of levels 0, 1, ... of (tree, level, k, n, digest), n being the nodes of the tree on that level."""
    out = [leaves]
    for _ in counts_up(most, arity)[1:]:
        run = F.sort_array(F.collect_list(F.struct("k", "digest")))  # at most `arity` of them
        parent = out[-1].where("n > 1").groupBy("tree", "level", F.expr(f"k div {arity}").alias("up"), "n").agg(F.sha2(F.array_join(F.transform(run, lambda x: x["digest"]), "").cast("binary"), 256).alias("digest"))
        out.append(scratch.table(parent.select("tree", (F.col("level") + 1).alias("level"), F.col("up").alias("k"), F.expr(f"(n + {arity - 1}) div {arity}").alias("n"), "digest")))
    return out


def _needed(arity: int) -> Callable[[pa.Table], pa.Table]:
    def run(rows: pa.Table) -> pa.Table:
        group, trees, at, n, source_count = (rows.column(c).to_numpy() for c in ("g", "tree", "k", "n", "sources"))
        out = []
        for t in np.unique(trees).tolist():
            own = np.flatnonzero(trees == t)
            out += [(t, level, k) for level, ks in enumerate(missing(np.unique(at[own]), int(n[own[0]]), arity)) for k in ks.tolist()]
        out += [(TOP, level, k) for level, ks in enumerate(missing(np.unique(trees), int(source_count[0]), arity)) for k in ks.tolist()]
        cols = np.array(out, np.int64).reshape(-1, 3)
        return pa.table({"g": np.full(len(cols), group[0], np.int64), "tree": cols[:, 0], "level": cols[:, 1], "k": cols[:, 2]})

    return run


def _expand(arity: int, root: str, whole: bool) -> Callable[[pa.Table, pa.Table], pa.Table]:
    def run(rows: pa.Table, fetched: pa.Table) -> pa.Table:
        nodes: dict[int, dict[tuple[int, int], str]] = defaultdict(dict)
        for t, level, k, digest in zip(*(fetched.column(c).to_pylist() for c in ("tree", "level", "k", "digest")), strict=True):
            nodes[t][level, k] = digest
        trees, at, n, source_count = (rows.column(c).to_numpy() for c in ("tree", "k", "n", "sources"))
        leaves, tampered = rows.column("leaf").to_pylist(), rows.column("tampered").to_pylist()
        for t, k, digest in zip(trees.tolist(), at.tolist(), leaves, strict=True):
            nodes[t][0, k] = digest
        own = {t: np.flatnonzero(trees == t) for t in np.unique(trees).tolist()}
        size = {t: int(n[w[0]]) for t, w in own.items()}
        for t, w in own.items():
            derive(nodes[t], np.unique(at[w]), size[t], arity)
            nodes[TOP][0, t] = nodes[t][len(counts_up(size[t], arity)) - 1, 0]
        sources = int(source_count[0]) if len(source_count) else 0
        derive(nodes[TOP], np.unique(trees), sources, arity)
        over = Paths(nodes[TOP], sources, arity, [])
        derived = nodes[TOP][len(over.sizes) - 1, 0]  # what every untouched leaf of the group folds to
        subroots, proofs, digests, folded = [], [], [], []
        paths = {t: Paths(nodes[t], size[t], arity, over.sides(0, t)) for t in own}
        for t, k, changed in zip(trees.tolist(), at.tolist(), tampered, strict=True):
            sides = paths[t].sides(0, k)
            text = "".join(x for side in sides for x in side)
            digests.append(hashlib.sha256(text.encode()).hexdigest())
            if whole:
                proofs.append([text[i : i + 64] for i in range(0, len(text), 64)])
            subroots.append(nodes[TOP][0, t])
            folded.append(derived if changed is None else fold(changed, sides))
        cols = {"doc_id": rows.column("doc_id"), "leaf": rows.column("leaf"), "subroot": subroots, "root": [root] * len(subroots), "proof_sha256": digests, "folded_root": folded, "verified": [x == root for x in folded]}
        if whole:
            cols["proof"] = pa.array(proofs, pa.list_(pa.string()))
        return pa.table({c: v if isinstance(v, pa.ChunkedArray | pa.Array) else pa.array(v, pa.bool_() if c == "verified" else pa.string()) for c, v in cols.items()})

    return run


def manifest(docs: DataFrame, *, tampered: Column | None = None, arity: int = ARITY, block: int = BLOCK, group: int = GROUP, proofs: bool = False) -> DataFrame:
    """(doc_id, leaf, subroot, root, proof_sha256, folded_root, verified) of each row, with proofs also (proof array<string>).

    tampered: where it holds, the row is checked with its text lower-cased (A-Z), against the manifest of what it was.
    """
    spark, kind = docs.sparkSession, docs.schema["doc_id"].dataType.simpleString()
    fields = {c: F.col(c) for c in FIELDS}
    changed = leaf_digest([*list(fields.values())[:-1], tampered_text(F.col("text"))])
    with Scratch(spark, "merkle", 10_000) as scratch:
        # the texts are read once, before the range partition samples its rows
        rows = scratch.table(docs.select("doc_id", F.col("source").cast("string").alias("source"), leaf_digest(list(fields.values())).alias("leaf"), F.when(F.coalesce(tampered, F.lit(False)) if tampered is not None else F.lit(False), changed).alias("tampered")))
        order = [F.col("source").asc_nulls_first(), F.col("doc_id").asc_nulls_first(), F.col("leaf")]
        ranged = scratch.table(rows.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("part", F.spark_partition_id()), instead=rows)
        parts = scratch.table(ranged.groupBy("source", "part").agg(F.count("*").alias("c")))
        sources = parts.groupBy("source").agg(F.sum("c").alias("n"))
        sources = scratch.table(sources.withColumn("tree", (F.row_number().over(W.orderBy(F.col("source").asc_nulls_first())) - 1).cast("long")))
        total, most, n_sources = sources.agg(F.coalesce(F.sum("n"), F.lit(0)), F.coalesce(F.max("n"), F.lit(0)), F.count("*")).first()
        before = F.coalesce(F.sum("c").over(W.partitionBy("source").orderBy("part").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
        offsets = parts.withColumn("before", before).join(sources.withColumnRenamed("source", "s2"), F.col("source").eqNullSafe(F.col("s2"))).select(F.col("source").alias("s2"), F.col("part").alias("part2"), "before", "tree", "n")
        own = W.partitionBy("part", "source").orderBy(F.col("doc_id").asc_nulls_first(), "leaf")
        placed = ranged.withColumn("in_part", F.row_number().over(own) - 1).join(offsets, (F.col("part") == F.col("part2")) & F.col("source").eqNullSafe(F.col("s2")))
        placed = placed.withColumn("k", F.col("before") + F.col("in_part")).withColumn("g", F.pmod(F.xxhash64("tree", F.expr(f"k div {block}")), F.lit(max(1, -(-total // group)))))
        leaves = scratch.table(placed.select("g", "tree", "k", "n", F.lit(n_sources).cast("long").alias("sources"), "doc_id", "leaf", "tampered"), instead=ranged)
        levels = _levels(scratch, leaves.select("tree", F.lit(0).cast("long").alias("level"), "k", "n", F.col("leaf").alias("digest")), most, arity)
        tops = levels[0].where("n = 1")
        for x in levels[1:]:
            tops = tops.union(x.where("n = 1"))
        tops = scratch.table(tops.select(F.lit(TOP).cast("long").alias("tree"), F.lit(0).cast("long").alias("level"), F.col("tree").alias("k"), F.lit(n_sources).cast("long").alias("n"), "digest"))
        over = _levels(scratch, tops, n_sources, arity)
        root = over[-1].select("digest").first()
        root = root[0] if root else ""
        nodes = None
        for x in [*(levels[1:] if block % arity == 0 else levels), *over]:  # blocks of whole runs lack no leaves
            nodes = x if nodes is None else nodes.union(x)
        wanted = leaves.select("g", "tree", "k", "n", "sources").groupBy("g").applyInArrow(_needed(arity), "g long, tree long, level long, k long")
        fetched = wanted.join(nodes.select("tree", "level", "k", "digest"), ["tree", "level", "k"]).select("g", "tree", "level", "k", "digest")
        schema = f"doc_id {kind}, leaf string, subroot string, root string, proof_sha256 string, folded_root string, verified boolean" + ", proof array<string>" * proofs
        return cut(leaves.groupBy("g").cogroup(fetched.groupBy("g")).applyInArrow(_expand(arity, root, proofs), schema))


def op13_merkle(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return manifest(docs, tampered=F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 0)
