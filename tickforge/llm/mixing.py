"""Mixing sources to target weights by systematic sampling.

Sources, in code-point order with null last, weigh ``weights`` in turn and share ``volume`` times all
words; a target stops at ``cap`` times its source's words and the excess goes to the others by weight
until none is above. Within a source every document expects target / source_size copies. Documents are
ordered by size class (an eighth of an octave), then by a hash of doc_id; prefix sums of the expected
copies start at one random offset per source, and a copy is emitted at each integer crossed. Ordering
by size makes the words taken follow the target closely, and no document has over ceil(cap) copies.
Every step is deterministic in (doc_id, text, seed).

Defined cases: a null text has no words; a null source is a source of its own; a source without words
has target 0 and takes nothing; repeated rows are separate documents; an empty table gives no rows;
further columns are passed through by ``mix`` whatever their names, and not read. ``mix`` gives each row its own
copies; among rows equal in doc_id, source and text, which the copies do not tell apart, it shares their
sum evenly, the first by their columns as text ahead (such rows meet in one sort).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tickforge.llm._common import WORD, bounded, materialize, ranked, read

WEIGHTS, VOLUME, CAP, SEED = (3.0, 1.0, 2.0), 1.5, 2.0, "mix-0"


def word_count(text):
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def size_class(size):
    """The leading four bits and the bit length: eight classes an octave, monotone in size."""
    bits = F.char_length(F.bin(size)).cast("long")
    return bits * 16 + F.expr("shiftright(size, cast(greatest(char_length(bin(size)) - 4, 0) as int))")


def source_targets(sizes: DataFrame, weights=WEIGHTS, volume=VOLUME, cap=CAP) -> DataFrame:
    """sizes(source, source_size) with a row per source, to src (0, 1, ...), source, source_size, target.

    Water filling in closed form: ordered by size over weight, a source is capped while the level of
    those not yet placed would lift it above its cap. One task holds one row per source.
    """
    by_name = Window.orderBy(F.col("source").isNull(), F.col("source"))
    s = sizes.withColumn("src", F.row_number().over(by_name) - 1)
    s = s.withColumn("w", F.element_at(F.array(*map(F.lit, weights)), (F.col("src") % len(weights) + 1).cast("int")))
    fill = Window.orderBy(F.col("source_size") / F.col("w"), "src")
    everything = fill.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    s = s.withColumn("placed", F.coalesce(F.sum("source_size").over(fill.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    s = s.withColumn("open", F.sum("w").over(fill.rowsBetween(0, Window.unboundedFollowing)))
    s = s.withColumn("all", F.sum("source_size").over(everything))
    s = s.withColumn("level", (volume * F.col("all") - cap * F.col("placed")) / F.col("open"))
    s = s.withColumn("capped", F.col("level") * F.col("w") > cap * F.col("source_size"))
    s = s.withColumn("final", F.min(F.when(~F.col("capped"), F.struct(F.col("source_size") / F.col("w"), "src", "level"))).over(everything))
    target = F.when(F.col("capped"), cap * F.col("source_size")).otherwise(F.col("final.level") * F.col("w"))
    return s.select("src", "source", "source_size", target.alias("target"))


def copies(docs: DataFrame, weights=WEIGHTS, volume=VOLUME, cap=CAP, seed=SEED) -> DataFrame:
    """doc_id, source, size, source_size, target, copies (long), x (a hash of the text) for each row of ``docs``."""
    base = materialize(docs.select(
        "doc_id", "source", F.xxhash64("text").alias("x"), word_count(F.col("text")).alias("size"),
        F.conv(F.substring(F.md5(F.coalesce(F.col("doc_id").cast("string"), F.lit(""))), 1, 8), 16, 10).cast("long").alias("h"),
    ))
    sums = base.groupBy("source").agg(F.sum("size").alias("source_size"), F.count(F.lit(1)).alias("n"))
    sums = materialize(sums)
    total = sums.agg(F.sum("n")).first()[0] or 0
    targets = materialize(source_targets(sums.drop("n"), weights, volume, cap))
    targets = bounded(targets, targets.count())
    base = base.withColumn("cls", size_class(F.col("size")))
    base = materialize(
        base.alias("b").join(targets.alias("t"), F.col("b.source").eqNullSafe(F.col("t.source")))
        .select("b.doc_id", "b.source", "b.x", "b.size", "b.h", "b.cls", "t.src", "t.source_size", "t.target")
    )
    classes = base.groupBy("src", "cls").agg(F.count(F.lit(1)).alias("n"))
    below = Window.partitionBy("src").orderBy("cls").rowsBetween(Window.unboundedPreceding, -1)
    classes = materialize(classes.select("src", "cls", F.coalesce(F.sum("n").over(below), F.lit(0)).alias("smaller")))
    base = ranked(base, ["src", "cls"], "h", ["doc_id", "size"], "place", total)
    base = base.join(bounded(classes, classes.count()), ["src", "cls"])
    place = F.col("smaller") + F.col("place")
    name = F.concat(F.lit(f"{seed}:"), F.coalesce("source", F.lit("\u0000")))
    offset = F.conv(F.substring(F.md5(name), 1, 8), 16, 10).cast("long") / F.lit(4294967296.0)
    each = F.coalesce(F.try_divide(F.col("target"), F.col("source_size").cast("double")), F.lit(0.0))
    crossed = F.floor(offset + (place + 1) * each) - F.floor(offset + place * each)
    return base.select("doc_id", "source", "size", "source_size", "target", crossed.cast("long").alias("copies"), "x")


def mix(docs: DataFrame, **how) -> DataFrame:
    """The rows of ``docs``, each repeated as often as the mix takes it."""
    key = ["_i", "_s", "_x"]
    taken = copies(docs, **how).groupBy(F.col("doc_id").alias("_i"), F.col("source").alias("_s"), F.col("x").alias("_x"))
    taken = taken.agg(F.sum("copies").alias("_sum"), F.count(F.lit(1)).alias("_rows")).where("_sum > 0")
    taken = taken.select(*[F.col(c).alias(f"{c}t") for c in key], "_sum", "_rows")
    same = F.lit(True)
    for c in key:
        same = same & F.col(c).eqNullSafe(F.col(f"{c}t"))
    rows = docs.select(F.struct(*[docs[c] for c in docs.columns]).alias("_row"), docs["doc_id"].alias("_i"), docs["source"].alias("_s"), F.xxhash64(docs["text"]).alias("_x"))
    rows = rows.join(taken, same)
    alone = rows.where("_rows = 1").select("_row", F.col("_sum").alias("_n"))
    number = F.row_number().over(Window.partitionBy(*key).orderBy(F.to_json("_row")))
    again = rows.where("_rows > 1").withColumn("_k", number)
    again = again.select("_row", F.expr("_sum div _rows + cast(_k <= _sum % _rows as int)").alias("_n")).where("_n > 0")
    out = alone.unionByName(again).select("_row", F.explode(F.sequence(F.lit(1), F.col("_n").cast("int"))))
    return out.select(*[F.col("_row").getField(c).alias(c) for c in docs.columns])


def op7_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = copies(read(spark, sf_dir, "documents"))
    return c.select("doc_id", "size", "source_size", "target", (F.col("copies") * F.col("size")).alias("taken"), "copies")


ORACLE = r"""
with base as (
  select doc_id, source,
    len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::bigint as size,
    ('0x' || substr(md5(coalesce(doc_id::varchar, '')), 1, 8))::bigint as h
  from documents),
sums as (select source, sum(size)::bigint as source_size from base group by source),
named as (select *, row_number() over (order by source is null, encode(source)) - 1 as src from sums),
weighed as (select *, [3.0::double, 1.0::double, 2.0::double][src % 3 + 1] as w from named),
filled as (
  select *, source_size / w as r,
    coalesce(sum(source_size) over (order by source_size / w, src rows between unbounded preceding and 1 preceding), 0)::bigint as placed,
    sum(w) over (order by source_size / w, src rows between current row and unbounded following) as open,
    sum(source_size) over ()::bigint as everything
  from weighed),
levels as (select *, (1.5::double * everything - 2.0::double * placed) / open as level from filled),
marked as (select *, level * w > 2.0::double * source_size as capped from levels),
targets as (
  select src, source, source_size,
    case when capped then 2.0::double * source_size
      else w * first_value(level) over (order by capped, r, src) end as target
  from marked),
joined as (
  select b.doc_id, b.source, b.size, b.h, t.src, t.source_size, t.target,
    length(bin(b.size)) * 16 + (b.size >> greatest(length(bin(b.size)) - 4, 0)::bigint) as cls
  from base b join targets t on b.source is not distinct from t.source),
placed as (select *, row_number() over (partition by src order by cls, h, doc_id, size) - 1 as place from joined),
aimed as (
  select *, ('0x' || substr(md5('mix-0:' || coalesce(source, chr(0))), 1, 8))::bigint / 4294967296.0::double as u,
    coalesce(target / nullif(source_size, 0)::double, 0) as each
  from placed),
crossed as (select *, (floor(u + (place + 1) * each) - floor(u + place * each))::bigint as copies from aimed)
select doc_id, size, source_size, target, copies * size as taken, copies from crossed
"""
