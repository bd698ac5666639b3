"""Shared helpers of the corpus operators: scratch tables, distributed ranks, word counts.

Nothing outside ``tickforge.llm`` imports this subpackage.
"""

from __future__ import annotations

import gc
import math
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, Observation, SparkSession, Window
from pyspark.sql import functions as F

#: A word is a maximal run of bytes other than these ASCII white-space characters.
WORD = r"[^\x20\x09-\x0D]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

#: A table of at most this many rows may be broadcast.
BROADCAST_ROWS = 20_000


def scratch_root(spark: SparkSession) -> str:
    """The shared folder named by ``spark.checkpoint.dir``; a fresh local one only in local mode."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        root = f"file://{tempfile.mkdtemp(prefix='tickforge-')}"
        spark.conf.set("spark.checkpoint.dir", root)
    return root.rstrip("/")


#: Batches that Python workers are sent while a table is written: in bytes, and in rows.
BATCH = {"spark.sql.execution.arrow.maxBytesPerBatch": str(4 << 20), "spark.sql.execution.arrow.maxRecordsPerBatch": "2000"}


def materialize(df: DataFrame) -> DataFrame:
    """Writes ``df`` once to the shared scratch folder and reads it back, which cuts its lineage.

    Python workers get small batches meanwhile; the session's settings are put back.
    """
    spark = df.sparkSession
    path = f"{scratch_root(spark)}/{uuid.uuid4().hex}"
    before = {k: spark.conf.get(k, None) for k in BATCH}
    try:
        for k, v in BATCH.items():
            spark.conf.set(k, v)
        df.write.parquet(path)
    finally:
        for k, v in before.items():
            spark.conf.set(k, v) if v is not None else spark.conf.unset(k)
    return spark.read.schema(df.schema).parquet(path)


def counted(df: DataFrame) -> tuple[DataFrame, int]:
    """materialize(df) and its number of rows, which the write itself counts."""
    seen = Observation()
    out = materialize(df.observe(seen, F.count(F.lit(1)).alias("rows")))
    return out, seen.get["rows"]


def release(spark: SparkSession) -> None:
    """Has Spark delete the shuffle files and broadcasts of plans that nothing refers to any more, and executors give free heap back.

    It deletes only after the driver has collected its garbage, which by itself may be after the whole job. An executor's
    heap stays as large as an earlier stage made it, beside the Python workers of the next one, until it is collected in full.
    """
    gc.collect()
    spark.sparkContext._jvm.System.gc()
    slots = spark.sparkContext.defaultParallelism
    spark.range(0, slots, 1, slots).select(F.reflect(F.lit("java.lang.System"), F.lit("gc"))).write.format("noop").mode("overwrite").save()


def lean(work):
    """``work`` (batches -> batches), after which its Python worker gives free memory back to the system.

    Workers stay for later tasks and stages, and an executor's memory holds all that they have kept.
    """
    def run(batches):
        try:
            yield from work(batches)
        finally:
            import ctypes

            import pyarrow

            pyarrow.default_memory_pool().release_unused()
            trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # glibc's
            if trim:
                trim(0)

    return run


def parallelism(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def bounded(df: DataFrame, rows: int) -> DataFrame:
    """Marks ``df`` for broadcast if ``rows``, its counted size, is within the bound."""
    return F.broadcast(df) if rows <= BROADCAST_ROWS else df


def spread(*cols: Column | str) -> Column:
    """An even hash of ``cols`` in [0, 2**32), used to order and to subdivide."""
    return F.xxhash64(*cols).bitwiseAND(F.lit(0xFFFFFFFF))


def cell_of(h: Column | str, cells: Column | int) -> Column:
    """The ``cells``-th part of [0, 2**32) that holds ``h``; monotone in ``h``."""
    h = F.col(h) if isinstance(h, str) else h
    return F.shiftright(h * cells, 32)


def ranked(df: DataFrame, keys: list[str], h: str, order: list[str], out: str, total: int) -> DataFrame:
    """Adds ``out``: the row's place from 0 among the rows of its ``keys``, ordered by ``h``, then ``order``.

    No task holds a whole key: a key's rows are cut into cells of ``h`` (a hash in [0, 2**32)) of
    bounded size, ranked within cells, and shifted by the prefix sum of the counts of the cells before.
    ``df`` must be cheap to read twice (materialised), its ``keys`` not null; ``total`` is its row count.
    """
    parts = parallelism(df.sparkSession)
    per = min(50_000, max(64, total // (4 * parts)))
    sizes = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n"))
    sizes = materialize(sizes.select(*keys, F.ceil(F.col("_n") / per).cast("long").alias("_cells")))
    df = df.join(bounded(sizes, sizes.count()), keys).withColumn("_cell", cell_of(h, F.col("_cells"))).drop("_cells")
    before = Window.partitionBy(*keys).orderBy("_cell").rowsBetween(Window.unboundedPreceding, -1)
    cells = df.groupBy(*keys, "_cell").agg(F.count(F.lit(1)).alias("_n"))
    cells = materialize(cells.select(*keys, "_cell", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_from")))
    within = Window.partitionBy(*keys, "_cell").orderBy(h, *order)
    df = df.withColumn("_row", F.row_number().over(within))
    return (
        df.join(bounded(cells, cells.count()), [*keys, "_cell"])
        .withColumn(out, F.col("_from") + F.col("_row") - 1)
        .drop("_from", "_row", "_cell")
    )


def powers_of_two(n: int) -> int:
    return 1 << max(0, math.ceil(math.log2(max(1, n))))


def lower_ascii(c: Column) -> Column:
    """Lower-cases A to Z alone."""
    return F.translate(c, UPPER, LOWER)


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


class Shared:
    """A broadcast of one object or a list of objects of this package, as plain attributes, for executors that cannot import it."""

    def __init__(self, spark: SparkSession, value):
        self.many = isinstance(value, list)
        self.kind = None if value is None else type(value[0]) if self.many else type(value)
        held = None if value is None else [v.__dict__ for v in (value if self.many else [value])]
        self.held = spark.sparkContext.broadcast(held)

    def get(self):
        if self.kind is None:
            return None
        out = []
        for attributes in self.held.value:
            x = self.kind.__new__(self.kind)
            x.__dict__.update(attributes)
            out.append(x)
        return out if self.many else out[0]
