"""Embedding near-dedup by a forest of random-projection trees.

Each tree splits by random directions at the median, and vectors near the median (a share ``SPILL`` on
either side, by rank) go both ways. The upper part of a tree is fitted on a bounded sample (at most
``SAMPLE`` vectors) and sends every vector to its groups; in a group the recursion goes on over the
group's own vectors down to ``LEAF`` of them, which are compared in blocks, in double precision. A leaf
gives the links of a spanning forest, the union of all leaves of all trees is closed by connected
components, and the links of each vector are then counted exactly among the members of its component,
in blocks of bounded size, so that a large group of near copies is never one task nor a list of pairs.

Equal vectors are one vector with a weight until the end. Defined cases: a null, zero or non-finite
vector links with nothing and is kept; vectors of different lengths do not link; of rows that share a vec_id the
least vector counts and one row is returned; an empty table gives no rows.
"""

from __future__ import annotations

import functools
import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tickforge.llm._common import Shared, materialize, parallelism, read
from tickforge.llm.components import components
from tickforge.llm.vectors import by_length, each_group, matrix, usable

THRESHOLD, TREES, SPILL, GROUP, LEAF, SAMPLE, BLOCK = 0.9, 12, 0.06, 2048, 160, 65_536, 512


class Tree:
    """The upper part: per node a direction and the projections between which a vector goes both ways."""

    def __init__(self, sample: np.ndarray, depth: int, rng: np.random.Generator):
        self.depth, self.nodes = depth, {}
        self._grow(sample, 0, 1, rng)

    def _grow(self, x, level, node, rng):
        if level == self.depth:
            return
        w = rng.standard_normal(x.shape[1] if x.ndim == 2 else 1)
        if len(x):
            p = x @ w
            low, high = np.quantile(p, [0.5 - SPILL, 0.5 + SPILL])
        else:
            p, low, high = np.zeros(0), 0.0, 0.0
        self.nodes[node] = (w, low, high)
        self._grow(x[p <= high], level + 1, 2 * node, rng)
        self._grow(x[p >= low], level + 1, 2 * node + 1, rng)

    def leaves(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(row, leaf) of every leaf that a row of x reaches."""
        rows, at = np.arange(len(x)), np.ones(len(x), np.int64)
        for _ in range(self.depth):
            left, right = np.zeros(len(rows), bool), np.zeros(len(rows), bool)
            for node in np.unique(at):
                w, low, high = self.nodes[int(node)]
                here = at == node
                p = x[rows[here]] @ w
                left[here], right[here] = p <= high, (p >= low) & ((p > high) | (p >= low))
            rows, at = np.concatenate([rows[left], rows[right]]), np.concatenate([2 * at[left], 2 * at[right] + 1])
        return rows, at


def _root(parent: np.ndarray, k: int) -> int:
    while parent[k] != k:
        parent[k] = parent[parent[k]]
        k = parent[k]
    return k


def _leaf(x: np.ndarray, rows: np.ndarray, threshold: float, parent: np.ndarray) -> None:
    """Unites the rows of x that are linked. All pairs are compared, a block of them at a time."""
    for at in range(0, len(rows), BLOCK):
        a = rows[at:at + BLOCK]
        for other in range(at, len(rows), BLOCK):
            b = rows[other:other + BLOCK]
            i, j = np.nonzero(x[a] @ x[b].T >= threshold)
            for p, q in zip(a[i].tolist(), b[j].tolist()):
                if p != q:
                    p, q = _root(parent, p), _root(parent, q)
                    if p != q:
                        parent[max(p, q)] = min(p, q)


def _split(x: np.ndarray, rows: np.ndarray, threshold: float, parent: np.ndarray, rng: np.random.Generator) -> None:
    stack = [rows]
    while stack:
        rows = stack.pop()
        if len(rows) <= LEAF:
            _leaf(x, rows, threshold, parent)
            continue
        p = x[rows] @ rng.standard_normal(x.shape[1])
        order = np.argsort(p, kind="stable")  # by rank, so that a split always halves
        spill = int(SPILL * len(rows))
        half = len(rows) // 2
        stack += [rows[order[:half + spill]], rows[order[half - spill:]]]


def _unit(x: np.ndarray) -> np.ndarray:
    x = x / np.abs(x).max(1, keepdims=True)  # against overflow
    return x / np.sqrt((x * x).sum(1, keepdims=True))


def forest_links(vectors: DataFrame, total: int, threshold: float = THRESHOLD, trees: int = TREES, seed: int = 0) -> DataFrame:
    """a, b: links that connect what the forest's leaves connect. vectors(vec_id, vec), ``total`` of them."""
    spark = vectors.sparkSession
    depth = max(0, math.ceil(math.log2(max(1, total / GROUP))))
    share = min(1.0, SAMPLE / max(1, total))
    picked = vectors if share == 1 else vectors.where(F.pmod(F.xxhash64("vec_id", F.lit(seed)), F.lit(1 << 30)) < int(share * (1 << 30)))
    sample = _unit(matrix(picked.select("vec").toArrow().column(0))) if depth else np.zeros((0, 1))
    shared = Shared(spark, [Tree(sample, depth, np.random.default_rng([seed, k])) for k in range(trees)])

    def route(batches):
        forest = shared.get()
        for b in batches:
            if not b.num_rows:
                continue
            x = _unit(matrix(b.column(1)))
            for k, tree in enumerate(forest):
                rows, leaf = tree.leaves(x)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(leaf * trees + k), b.column(0).take(pa.array(rows)), b.column(1).take(pa.array(rows))], names=["leaf", "vec_id", "vec"]
                )

    def compare(batches):
        def one(group):
            ids, x = group.column(1).to_numpy(), _unit(matrix(group.column(2)))
            order = np.argsort(ids)
            ids, x = ids[order], x[order]
            parent = np.arange(len(ids))
            _split(x, np.arange(len(ids)), threshold, parent, np.random.default_rng([seed, int(group.column(0)[0].as_py())]))
            root = np.array([_root(parent, k) for k in range(len(ids))], np.int64)
            far = np.flatnonzero(root != np.arange(len(ids)))
            yield pa.RecordBatch.from_arrays([pa.array(ids[root[far]]), pa.array(ids[far])], names=["a", "b"])

        return each_group(batches, 1, one)

    parts = max(parallelism(spark), trees * 2**depth // 8)
    routed = vectors.mapInArrow(route, "leaf long, vec_id long, vec binary").repartition(parts, "leaf").sortWithinPartitions("leaf")
    return routed.mapInArrow(compare, "a long, b long").distinct()


def count_links(members: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """vec_id, n: the weights of the other members of its component linked to each.
    members(component, n_members, vec_id, weight, vec). A component is cut into blocks, and each pair of
    blocks is a group of its own."""
    per = 2 * BLOCK
    blocks = F.ceil(F.col("n_members") / per).cast("int")
    m = members.withColumn("block", F.pmod(F.xxhash64("vec_id"), blocks).cast("int"))
    m = m.withColumn("other", F.explode(F.sequence(F.lit(0), blocks - 1)))
    m = m.select("component", F.least("block", "other").alias("i"), F.greatest("block", "other").alias("j"), "block", "vec_id", "weight", "vec")

    def count(batches):
        def one(group):
            first, block = group.column(1)[0].as_py(), group.column(3).to_numpy()
            same = first == group.column(2)[0].as_py()
            ids, weight, x = group.column(4).to_numpy(), group.column(5).to_numpy(), _unit(matrix(group.column(6)))
            a, b = np.flatnonzero(block == first), np.flatnonzero(block != first)
            b = a if same else b
            n = np.zeros(len(ids), np.int64)
            for at in range(0, len(a), BLOCK):
                rows = a[at:at + BLOCK]
                near = x[rows] @ x[b].T >= threshold
                if same:
                    near[np.arange(len(rows)), at + np.arange(len(rows))] = False
                else:
                    n[b] += weight[rows] @ near
                n[rows] += near @ weight[b]
            yield pa.RecordBatch.from_arrays([pa.array(ids), pa.array(n)], names=["vec_id", "n"])

        return each_group(batches, 3, one)

    parts = parallelism(members.sparkSession)
    m = m.repartition(parts, "component", "i", "j").sortWithinPartitions("component", "i", "j")
    return m.mapInArrow(count, "vec_id long, n long").groupBy("vec_id").agg(F.sum("n").alias("n"))


def dedup_vectors(table: DataFrame, threshold: float = THRESHOLD, trees: int = TREES) -> DataFrame:
    """vec_id, n_links, component_id, kept for each vec_id of ``table`` (vec_id, embedding)."""
    every = table.select(F.col("vec_id").cast("long").alias("vec_id")).distinct()
    vectors = materialize(usable(table))
    # Equal vectors are compared once.
    classes = materialize(vectors.groupBy("vec").agg(F.min("vec_id").alias("rep"), F.count(F.lit(1)).alias("weight")))
    links = [forest_links(v, total, threshold, trees) for v, total in by_length(classes.select(F.col("rep").alias("vec_id"), "vec"))]
    none = table.sparkSession.createDataFrame([], "a long, b long")
    found = materialize(components(functools.reduce(DataFrame.unionByName, links, none)))
    sizes = materialize(found.groupBy("component").agg(F.count(F.lit(1)).alias("n_members")))
    members = found.join(sizes, "component").join(classes.withColumnRenamed("rep", "id"), "id")
    counted = count_links(members.select("component", "n_members", F.col("id").alias("vec_id"), "weight", "vec"), threshold)
    whole = (
        classes.join(found.withColumnRenamed("id", "rep"), "rep", "left").join(counted.withColumnRenamed("vec_id", "rep"), "rep", "left")
        .select("vec", (F.col("weight") - 1 + F.coalesce("n", F.lit(0))).alias("n_links"), F.coalesce("component", "rep").alias("component_id"))
    )
    linked = vectors.join(materialize(whole), "vec").select("vec_id", "n_links", "component_id")
    return (
        every.join(linked, every["vec_id"].eqNullSafe(linked["vec_id"]), "left").drop(linked["vec_id"])
        .withColumns({"n_links": F.coalesce("n_links", F.lit(0).cast("long")), "component_id": F.coalesce("component_id", "vec_id")})
        .withColumn("kept", F.col("component_id").eqNullSafe(F.col("vec_id")))
    )


def op1_embedding_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dedup_vectors(read(spark, sf_dir, "embeddings"))


#: Exact: on small tables the forest's leaves hold every linked pair.
ORACLE = """
with recursive v as (
  select vec_id, min(embedding::double[]) as e from embeddings where vec_id is not null group by vec_id),
good as (
  select vec_id, e from v where e is not null and len(e) > 0
    and len(list_filter(e, lambda x: x is null or isnan(x) or isinf(x))) = 0 and len(list_filter(e, lambda x: x <> 0)) > 0),
links as (
  select a.vec_id as a, b.vec_id as b from good a join good b on a.vec_id <> b.vec_id and len(a.e) = len(b.e)
  where list_cosine_similarity(a.e, b.e) >= 0.9),
reach(id, other) as (
  select vec_id, vec_id from v union select r.id, l.b from reach r join links l on l.a = r.other),
least as (select id, min(other) as component_id from reach group by id),
counts as (select a, count(*) as n from links group by a)
select l.id as vec_id, coalesce(c.n, 0)::bigint as n_links, l.component_id, l.component_id = l.id as kept
from least l left join counts c on c.a = l.id
"""
