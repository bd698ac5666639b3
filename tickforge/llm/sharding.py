"""Sharding by minimax contiguous partition: shards of near equal bytes that keep equal texts together.

Groups of equal texts are atomic and ordered by a hash of the text. The smallest capacity for which a
greedy sweep needs at most ``shards`` shards is found by binary search, and the cuts are made there.
The search never sees all groups: it runs over cells, ranges of the hash with their summed sizes.
Two sweeps bound every cut, one with cells as atoms and one with cells divided at will; cells between
the bounds are split by further hash bits and fetched again, until each cut lies between two single
groups. Cells outside the bounds stay whole, so the driver holds a number of cells that depends on
the number of shards, and the result equals the search over all groups.

Defined cases: a null text counts 8 bytes, has a null checksum, and null texts are one group; a group
larger than the mean share fills a shard of its own and later shards may be empty; repeated rows keep
a slot each; an empty table gives no rows; further columns are not read.
"""

from __future__ import annotations

import bisect
from itertools import accumulate

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tickforge.llm._common import materialize, ranked, read, spread

#: Cells of the first look at the groups, and subcells of a cell that is split, as powers of two.
FIRST_BITS, MORE_BITS = 13, 8


def _sweep(ends: list[int], single: list[bool], capacity: int, shards: int, fluid: bool) -> list[int] | None:
    """Byte positions of the cuts of a greedy sweep. fluid: cells of several groups can be cut anywhere.
    None if a cell does not fit or more than ``shards`` shards are needed (not when fluid)."""
    cuts, at, total = [], 0, ends[-1] if ends else 0
    while at + capacity < total:
        k = bisect.bisect_right(ends, at + capacity)  # the first cell that does not fit whole
        start = ends[k - 1] if k else 0
        to = at + capacity if fluid and not single[k] else start
        if to <= at or len(cuts) == shards - 1:
            return cuts if fluid else None
        cuts.append(to)
        at = to
    return cuts


def _smallest(ends: list[int], single: list[bool], low: int, shards: int) -> int:
    high = max(ends[-1], low)
    while low < high:
        middle = (low + high) // 2
        if _sweep(ends, single, middle, shards, fluid=False) is None:
            low = middle + 1
        else:
            high = middle
    return low


def cut_points(groups: DataFrame, shards: int) -> list[int]:
    """The least hash of each shard but the first. groups(g long, bytes long): a row per atomic group."""
    def fetch(bits: int, ranges: list[tuple[int, int]] | None) -> list[list[int]]:
        found = groups
        if ranges is not None:
            hit = F.lit(False)
            for lo, hi in ranges:
                hit = hit | F.col("g").between(lo, hi)
            found = found.where(hit)
        cell = F.shiftright("g", 64 - bits) if bits < 64 else F.col("g")
        rows = found.groupBy(cell.alias("cell")).agg(F.sum("bytes"), F.count(F.lit(1)), F.max("bytes")).collect()
        return sorted([r[0] << (64 - bits), bits, r[1], r[2], r[3]] for r in rows)

    cells = fetch(FIRST_BITS, None)
    if not cells:
        return []
    total = sum(c[2] for c in cells)
    low = max(-(-total // shards), max(c[4] for c in cells))
    while True:
        ends, single = list(accumulate(c[2] for c in cells)), [c[3] == 1 for c in cells]
        split = {k for k, c in enumerate(cells) if c[3] > 1 and c[2] > low}
        if not split:
            high = _smallest(ends, single, low, shards)
            at, first = 0, []
            while at + low < total and len(first) < shards:  # the earliest cuts: cells as atoms, smallest capacity
                k = bisect.bisect_right(ends, at + low)
                first.append(at := ends[k - 1] if k else 0)
            last = _sweep(ends, single, high, shards, fluid=True)
            for j, begin in enumerate(first):
                end = last[j] if j < len(last) else total
                if begin >= total:
                    break
                span = range(bisect.bisect_right(ends, begin), min(len(cells) - 1, bisect.bisect_left(ends, end)) + 1)
                split.update(k for k in span if not single[k])
        if not split:
            cuts = _sweep(ends, single, high, shards, fluid=False)
            return [cells[bisect.bisect_right(ends, c)][0] if c < total else 2**63 - 1 for c in cuts]
        by_bits: dict[int, list[tuple[int, int]]] = {}
        for k in sorted(split):
            lo, bits = cells[k][:2]
            ranges, hi = by_bits.setdefault(bits, []), lo + (1 << (64 - bits)) - 1
            if ranges and ranges[-1][1] == lo - 1:
                ranges[-1] = (ranges[-1][0], hi)
            else:
                ranges.append((lo, hi))
        kept = [c for k, c in enumerate(cells) if k not in split]
        for bits, ranges in by_bits.items():
            kept += fetch(min(64, bits + MORE_BITS), ranges)
        cells = sorted(kept)


def shard(docs: DataFrame, shards: int = 24) -> DataFrame:
    """doc_id, size, text_crc32, shard, slot for each row of ``docs`` (doc_id, text)."""
    base = materialize(docs.select(
        "doc_id",
        (F.coalesce(F.octet_length("text"), F.lit(0)) + 8).cast("long").alias("size"),
        F.crc32(F.col("text").cast("binary")).alias("text_crc32"),
        F.xxhash64("text").alias("g"),
    ))
    groups = materialize(base.groupBy("g").agg(F.sum("size").alias("bytes"), F.count(F.lit(1)).alias("n")))
    total = groups.agg(F.sum("n")).first()[0] or 0
    number = F.lit(0)
    for cut in cut_points(groups, shards):
        number = number + (F.col("g") >= F.lit(cut)).cast("int")
    base = base.select("doc_id", "size", "text_crc32", number.alias("shard"), spread("doc_id").alias("h"))
    placed = ranked(base, ["shard"], "h", ["doc_id", "size", "text_crc32"], "slot", total)
    return placed.select("doc_id", "size", "text_crc32", "shard", "slot")


def op9_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    placed = shard(read(spark, sf_dir, "documents"))
    return placed.withColumns({"law": F.lit("bytes"), "grown_shard": F.lit(None).cast("int")}).select(
        "doc_id", "size", "text_crc32", "law", "shard", "slot", "grown_shard"
    )
