"""Approximate nearest neighbours: a hierarchical navigable small-world graph per shard.

Vectors are dealt to shards of bounded size by a hash of vec_id. Each shard's graph is built in one
task and written as flat neighbour arrays, one per layer. Inner products are searched by the usual
lift: every vector gets one more component that makes the norms of its shard equal, so that nearness
and inner product agree. A layer holds the nodes whose hashed level reaches it; a node's links are its
nearest of the layer, thinned to diverse directions, and the links back. Every query visits every
shard: groups of (shard, query group) descend greedily through the layers and then keep a beam of
``EF`` nodes, all queries of a block in step. Shard results carry exact double-precision products and
are merged by query.

Defined cases: a null, zero or non-finite vector takes no part on either side; a query's candidates are
the vectors of its length; of rows that share a vec_id the least vector counts; a query never finds its own vec_id;
with fewer than k candidates all are returned; ties go to the smaller vec_id; an empty table gives no rows.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tickforge.llm._common import materialize, read
from tickforge.llm.vectors import by_length, matrix, usable

SHARDS, SHARD_ROWS, QUERY_ROWS = 8, 16_384, 20_000
LINKS, CANDIDATES, EF, BLOCK = 16, 48, 128, 256
GRAPH = "shard int, ids binary, vectors binary, levels binary, layers array<binary>"


def levels(ids: np.ndarray) -> np.ndarray:
    """A geometric level per id, from a hash of the id."""
    h = ids.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    h = (h ^ (h >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
    u = ((h >> np.uint64(11)).astype(float) + 0.5) / 2.0**53
    return np.floor(-np.log(u) / math.log(LINKS)).astype(np.int32)


def lifted(x: np.ndarray) -> np.ndarray:
    """One more component, so that all norms are the largest."""
    square = (x * x).sum(1)
    return np.concatenate([x, np.sqrt(np.maximum(0, square.max() - square))[:, None]], 1)


def layer(x: np.ndarray, nodes: np.ndarray, links: int) -> np.ndarray:
    """The flat neighbour array of a layer: for each node, up to 2 * links others of ``nodes``, else -1."""
    n, c = len(nodes), min(CANDIDATES, len(nodes) - 1)
    out = np.full((n, 2 * links), -1, np.int32)
    if c < 1:
        return out
    y = x[nodes]
    forward, near = np.full((n, links), -1, np.int64), np.zeros((n, links))
    for at in range(0, n, BLOCK):
        rows = np.arange(at, min(n, at + BLOCK))
        sims = y[rows] @ y.T
        sims[np.arange(len(rows)), rows] = -np.inf
        top = np.argpartition(-sims, c - 1, 1)[:, :c]
        s = np.take_along_axis(sims, top, 1)
        order = np.argsort(-s, 1, kind="stable")
        top, s = np.take_along_axis(top, order, 1), np.take_along_axis(s, order, 1)
        among = np.einsum("rid,rjd->rij", y[top], y[top])
        keep = np.zeros((len(rows), c), bool)
        for j in range(c):  # a candidate stays if it is nearer to the node than to all that stayed
            rival = np.where(keep[:, :j], among[:, j, :j], -np.inf).max(1) if j else np.full(len(rows), -np.inf)
            keep[:, j] = (rival < s[:, j]) & (keep.sum(1) < links)
        rank = np.argsort(~keep, 1, kind="stable")[:, :links]  # those that stayed, then the nearest others
        width = rank.shape[1]
        forward[rows, :width], near[rows, :width] = np.take_along_axis(top, rank, 1), np.take_along_axis(s, rank, 1)
    a, b, s = np.repeat(np.arange(n), links), forward.ravel(), near.ravel()
    a, b, s = a[b >= 0], b[b >= 0], s[b >= 0]
    first = np.concatenate([np.zeros(len(a)), np.ones(len(a))])  # own links come before links back
    a, b, s = np.concatenate([a, b]), np.concatenate([b, a]), np.concatenate([s, s])
    _, unique = np.unique(a * n + b, return_index=True)
    a, b, s, first = a[unique], b[unique], s[unique], first[unique]
    order = np.lexsort((b, -s, first, a))
    a, b = a[order], b[order]
    place = np.arange(len(a)) - np.searchsorted(a, a)
    fits = place < 2 * links
    out[a[fits], place[fits]] = nodes[b[fits]]
    return out


def build(group: pa.Table) -> pa.Table:
    """A shard's graph, from its rows (shard, vec_id, vec)."""
    order = np.argsort(group.column("vec_id").to_numpy())
    ids, x = group.column("vec_id").to_numpy()[order], matrix(group.column("vec"))[order]
    lev, up = levels(ids), lifted(x)
    layers = []
    for k in range(int(lev.max()) + 1):
        nodes = np.flatnonzero(lev >= k)
        flat = np.full((len(ids), 2 * LINKS), -1, np.int32) if k == 0 else None
        made = layer(up, nodes, LINKS)
        if k == 0:
            flat[nodes] = made
            layers.append(flat.tobytes())
        else:
            layers.append(np.concatenate([nodes.astype(np.int32)[:, None], made], 1).tobytes())
    return pa.table({
        "shard": pa.array([group.column("shard")[0].as_py()], pa.int32()), "ids": pa.array([ids.tobytes()], pa.binary()),
        "vectors": pa.array([x.tobytes()], pa.binary()), "levels": pa.array([lev.tobytes()], pa.binary()), "layers": pa.array([layers], pa.list_(pa.binary())),
    })


class Graph:
    """A shard's graph, read from its row."""

    def __init__(self, row: dict):
        self.ids = np.frombuffer(row["ids"], np.int64)
        self.x = np.frombuffer(row["vectors"], np.float64).reshape(len(self.ids), -1)
        self.lev = np.frombuffer(row["levels"], np.int32)
        self.links = []
        for k, raw in enumerate(row["layers"]):
            flat = np.frombuffer(raw, np.int32)
            if k:
                flat, some = np.full((len(self.ids), 2 * LINKS), -1, np.int32), flat.reshape(-1, 2 * LINKS + 1)
                flat[some[:, 0]] = some[:, 1:]
            self.links.append(flat.reshape(len(self.ids), 2 * LINKS))

    def search(self, q: np.ndarray, ef: int) -> tuple[np.ndarray, np.ndarray]:
        """The nodes and products of a beam of ef for each query, nearest first; -1 where there are fewer."""
        top = len(self.links) - 1
        at = np.full((len(q), 1), int(np.flatnonzero(self.lev == top)[0]))
        for k in range(top, 0, -1):
            at = self._beam(q, at, k, 8)[0][:, :4]
        return self._beam(q, at, 0, ef)

    def _beam(self, q, entry, k, ef, at_once=4):
        n, rows = len(self.ids), np.arange(len(q))[:, None]
        seen = np.zeros((len(q), n + 1), bool)  # the last column takes the missing neighbours
        seen[:, n] = True
        ids = np.full((len(q), ef), n)
        sims = np.full((len(q), ef), -np.inf)
        done = np.ones((len(q), ef), bool)
        new = entry
        while True:
            new = np.where(new < 0, n, new)
            fresh = ~seen[rows, new]
            seen[rows, new] = True
            near = np.where(fresh, np.einsum("qd,qmd->qm", q, self.x[np.where(fresh, new, 0)]), -np.inf)
            ids, sims = np.concatenate([ids, np.where(fresh, new, n)], 1), np.concatenate([sims, near], 1)
            done = np.concatenate([done, ~fresh], 1)
            best = np.argsort(-sims, 1, kind="stable")[:, :ef]
            ids, sims, done = (np.take_along_axis(v, best, 1) for v in (ids, sims, done))
            if done.all():
                return np.where(ids == n, -1, ids), sims
            ahead = np.argsort(done, 1, kind="stable")[:, :at_once]  # the nearest not yet expanded
            wait = ~np.take_along_axis(done, ahead, 1)
            np.put_along_axis(done, ahead, True, 1)
            nodes = np.where(wait, np.take_along_axis(ids, ahead, 1), 0)
            found = np.where(wait[:, :, None], self.links[k][nodes], -1).reshape(len(q), -1)
            found.sort(1)
            found[:, 1:][found[:, 1:] == found[:, :-1]] = -1  # the same neighbour of two nodes
            new = found


def index(vectors: DataFrame, shards: int) -> DataFrame:
    """GRAPH, a row per shard, written to the scratch folder. vectors(vec_id, vec)."""
    dealt = vectors.select(F.pmod(F.xxhash64("vec_id"), F.lit(shards)).cast("int").alias("shard"), "vec_id", "vec")
    return materialize(dealt.groupBy("shard").applyInArrow(build, GRAPH))


def search(graphs: DataFrame, shards: int, queries: DataFrame, n_queries: int, k: int, ef: int = EF) -> DataFrame:
    """query_id, rank, vec_id, score: the k nearest found. queries(query_id, vec)."""
    groups = max(1, math.ceil(n_queries / QUERY_ROWS))
    asked = queries.withColumn("part", F.pmod(F.xxhash64("query_id"), F.lit(groups)).cast("int"))
    asked = asked.withColumn("shard", F.explode(F.sequence(F.lit(0), F.lit(shards - 1)))).select("shard", "part", "query_id", "vec")
    held = graphs.withColumn("part", F.explode(F.sequence(F.lit(0), F.lit(groups - 1)))).select("shard", "part", "ids", "vectors", "levels", "layers")

    def find(left: pa.Table, right: pa.Table) -> pa.Table:
        out = [[], [], []]
        if left.num_rows and right.num_rows:
            graph = Graph(left.slice(0, 1).to_pylist()[0])
            own, q = right.column("query_id").to_numpy(), matrix(right.column("vec"))
            for at in range(0, len(q), BLOCK):
                nodes, sims = graph.search(q[at:at + BLOCK], max(ef, k + 1))
                ids = np.where(nodes >= 0, graph.ids[nodes], -1)
                sims = np.where((nodes < 0) | (ids == own[at:at + BLOCK, None]), -np.inf, sims)
                order = np.lexsort((ids, -sims), axis=1)[:, :k]
                ids, sims = np.take_along_axis(ids, order, 1), np.take_along_axis(sims, order, 1)
                some = sims > -np.inf
                for column, v in zip(out, (np.broadcast_to(own[at:at + BLOCK, None], ids.shape)[some], ids[some], sims[some])):
                    column.append(v)
        found = [np.concatenate(c) if c else np.zeros(0) for c in out]
        return pa.table({"query_id": pa.array(found[0].astype(np.int64)), "vec_id": pa.array(found[1].astype(np.int64)), "score": pa.array(found[2].astype(float))})

    found = held.groupBy("shard", "part").cogroup(asked.groupBy("shard", "part")).applyInArrow(find, "query_id long, vec_id long, score double")
    nearest = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(nearest)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def nearest(table: DataFrame, every: int, k: int) -> DataFrame:
    """query_id, rank, vec_id, score: the k nearest found of each vector whose id is divisible by ``every``."""
    out = table.sparkSession.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    for vectors, total in by_length(materialize(usable(table))):
        queries = vectors.where(F.col("vec_id") % every == 0).select(F.col("vec_id").alias("query_id"), "vec")
        shards = max(SHARDS, math.ceil(total / SHARD_ROWS))
        out = out.unionByName(search(index(vectors, shards), shards, queries, queries.count(), k))
    return out


def op2_nearest_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nearest(read(spark, sf_dir, "embeddings"), 20, 20)
