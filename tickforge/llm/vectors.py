"""What the two vector operators share: which vectors take part, and groups out of sorted batches."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

VECTORS = "vec_id long, vec binary"


def usable(table: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding") -> DataFrame:
    """vec_id and vec, the float64 bytes of each vector that takes part; one row per vec_id.

    Null and zero vectors and those with null or non-finite components take no part; of rows that share
    a vec_id the least vector counts. Vectors may differ in length; see by_length.
    """
    v = table.select(F.col(id_col).cast("long").alias("vec_id"), F.col(vec_col).cast("array<double>").alias("v"))
    v = v.where(F.col("vec_id").isNotNull()).groupBy("vec_id").agg(F.min("v").alias("v"))
    bad = F.exists("v", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    v = v.where(F.col("v").isNotNull() & ~bad & F.exists("v", lambda x: x != 0))

    def packed(batches):
        for b in batches:
            flat = b.column(1).flatten().to_numpy(zero_copy_only=False)
            ends = np.cumsum(b.column(1).value_lengths().to_numpy(zero_copy_only=False).astype(np.int64))
            rows = [r.tobytes() for r in np.split(flat, ends[:-1])] if b.num_rows else []
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(rows, pa.binary())], names=["vec_id", "vec"])

    return v.mapInArrow(packed, VECTORS)


def by_length(vectors: DataFrame) -> list[tuple[DataFrame, int]]:
    """The vectors of each length and their number: only vectors of one length are compared. A pass for each length."""
    sizes = vectors.groupBy(F.octet_length("vec").alias("n")).count().orderBy("n").collect()
    return [(vectors.where(F.octet_length("vec") == r["n"]), r["count"]) for r in sizes]


def matrix(column) -> np.ndarray:
    """The float64 rows of a column of packed vectors."""
    items = column.to_pylist()
    return np.frombuffer(b"".join(items), np.float64).reshape(len(items), -1) if items else np.zeros((0, 0))


def each_group(batches: Iterator[pa.RecordBatch], keys: int, use: Callable[[pa.Table], Iterator[pa.RecordBatch]]):
    """Calls ``use`` with each run of equal leading ``keys`` columns of batches sorted by them."""
    held: list[pa.RecordBatch] = []
    last = None
    for b in batches:
        if not b.num_rows:
            continue
        change = np.zeros(b.num_rows, bool)
        for k in range(keys):
            c = b.column(k).to_numpy(zero_copy_only=False)
            change[1:] |= c[1:] != c[:-1]
        first = tuple(b.column(k)[0].as_py() for k in range(keys))
        change[0] = last is not None and first != last
        cuts = [*np.flatnonzero(change).tolist(), b.num_rows]
        at = 0
        for cut in cuts:
            if cut in cuts[:-1] or cut != b.num_rows:
                if cut > at:
                    held.append(b.slice(at, cut - at))
                yield from use(pa.Table.from_batches(held))
                held, at = [], cut
        if at < b.num_rows:
            held.append(b.slice(at))
        last = tuple(b.column(k)[b.num_rows - 1].as_py() for k in range(keys))
    if held:
        yield from use(pa.Table.from_batches(held))
