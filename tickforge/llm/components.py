"""Connected components of a distributed list of links, by alternating large and small stars."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tickforge.llm._common import bounded, counted, lean, materialize

#: At most this many links are closed in one task; the labels are the same either way.
FEW = 200_000


def _closed_in_one(batches):
    """The components of all links of one task: every id takes the least label of its links until none changes."""
    u, v = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
    for b in batches:
        u.append(b.column(0).to_numpy())
        v.append(b.column(1).to_numpy())
    u, v = np.concatenate(u), np.concatenate(v)
    ids, at = np.unique(np.concatenate([u, v]), return_inverse=True)
    u, v = at[:len(u)], at[len(u):]
    label = np.arange(len(ids))
    while True:
        least = np.minimum(label[u], label[v])
        new = label.copy()
        np.minimum.at(new, label[u], least)  # the roots move, and with them what hangs on them
        np.minimum.at(new, label[v], least)
        while (new[new] != new).any():
            new = new[new]
        if (new == label).all():
            break
        label = new
    yield pa.RecordBatch.from_arrays([pa.array(ids), pa.array(ids[label])], names=["id", "component"])


def components(links: DataFrame) -> DataFrame:
    """links(a, b) -> id, component: the least id reachable, for every id that has a link.

    A large star hangs the larger neighbours of each node on the least of its neighbourhood, a small
    star the smaller ones; the rounds are logarithmic in the size of a component. Minima are taken
    with map-side combining and joined back from a written table, so that a node with very many links
    is a skewed join that can be split, never a group in one task. At most FEW links are closed at once.
    """
    edges, number = counted(links.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct())
    if number <= FEW:
        return edges.repartition(1).mapInArrow(lean(_closed_in_one), "id long, component long")
    while True:
        for large in (True, False):
            both = edges.select("u", "v")
            if large:
                both = both.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
            least, n = counted(both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m")))
            hung = both.join(bounded(least, n), "u")
            if large:
                new = hung.where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
            else:
                new = hung.where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(least.select("u", F.col("m").alias("v")))
            edges = materialize(new.where("u <> v").distinct())
        # Done when every node hangs on one root, and no root hangs on another.
        tops = edges.groupBy("u").agg(F.count(F.lit(1)).alias("n"), F.min("v").alias("v"))
        roots = edges.select(F.col("v").alias("u")).distinct()
        if tops.where("n > 1").limit(1).count() == 0 and edges.join(roots, "u", "left_semi").limit(1).count() == 0:
            break
    return edges.select(F.col("u").alias("id"), F.col("v").alias("component")).unionByName(
        roots.select(F.col("u").alias("id"), F.col("u").alias("component"))
    )
