"""Best-fit packing of token pieces: a configuration linear program over the length histogram.

Documents become token ids plus an end id; those longer than ``capacity`` are cut from their end into
full pieces, so that only the first piece can be shorter. The histogram of piece lengths (at most
``capacity`` entries, whatever the input) goes to the driver. There the configuration LP (least number
of sequences whose contents cover the histogram) is solved by multiplicative weights: each length has
a weight that decays as it is covered, an unbounded-knapsack dynamic program prices the fullest
configurations under these weights, and the mix of configurations is scaled to what the histogram
holds and rounded down. What is left is priced again, and the last few pieces go by best fit
decreasing. The plan is a table of rank ranges for each length; pieces are ranked in parallel and
joined to it, so no task sees more than a bounded share of them.

Defined cases: a null text is an empty one, and its document is the end id alone; an empty table gives
no rows; repeated rows are packed each; further columns are not read. ``<|endoftext|>`` in a text is
read by the tokenizer's own rule, as its special id.
"""

from __future__ import annotations

import base64
import functools
import json
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tickforge.llm._common import BROADCAST_ROWS, lean, materialize, ranked, read, spread

CAPACITY, END_ID, TOKENIZER = 1024, 2, "byte_bpe_50k.json"
PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long"


def encoder(path: str):
    """texts -> lists of ids, as ``tokenizers`` gives them with add_special_tokens=False.

    The same merges are run by tiktoken, three to four times as fast, where the file's twin with
    ranks lies beside it; a text that spells the special token is left to ``tokenizers`` itself.
    """
    @functools.cache
    def whole():  # only where it is needed: it takes much of a worker's memory
        from tokenizers import Tokenizer

        return Tokenizer.from_file(path)

    twin = path.removesuffix(".json") + ".tiktoken"
    try:
        import public_tokenizers
        import tiktoken

        with open(twin, "rb") as lines:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
        fast = tiktoken.Encoding("twin", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    except (ImportError, FileNotFoundError):
        return lambda texts: [e.ids for e in whole().encode_batch(texts, add_special_tokens=False)]
    with open(path, encoding="utf-8") as file:
        special = [t["content"] for t in json.load(file).get("added_tokens") or []]
    return lambda texts: [
        whole().encode(t, add_special_tokens=False).ids if any(s in t for s in special) else fast.encode_ordinary(t) for t in texts
    ]


def cut(docs: DataFrame, tokenizer: str, capacity: int = CAPACITY, end_id: int = END_ID) -> DataFrame:
    """The pieces of ``docs`` (doc_id, text): PIECES. tokenizer: a path that every executor can read."""
    def pieces(batches):
        encode = encoder(tokenizer)
        for batch in batches:
            for at in range(0, batch.num_rows, 512):
                part = batch.slice(at, 512)
                out = [[], [], [], [], []]
                for doc, ids in zip(part.column(0).to_pylist(), encode([t or "" for t in part.column(1).to_pylist()])):
                    raw = np.array([*ids, end_id], "<u4")
                    start = 0
                    for k, end in enumerate(range((len(raw) - 1) % capacity + 1, len(raw) + 1, capacity)):
                        for column, x in zip(out, (doc, k, start, end - start, zlib.crc32(raw[start:end].tobytes()))):
                            column.append(x)
                        start = end
                yield pa.RecordBatch.from_arrays(
                    [pa.array(c, t) for c, t in zip(out, (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64()))],
                    names=["doc_id", "piece", "start", "length", "ids_crc32"],
                )

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(lean(pieces), PIECES)


def _knapsack(lengths: np.ndarray, weights: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray]:
    """best[c]: the largest weight of a multiset of lengths of sum <= c; took[c]: an item of it, -1: none."""
    best, took = np.zeros(capacity + 1), np.full(capacity + 1, -1)
    for c in range(1, capacity + 1):
        best[c], took[c] = best[c - 1], -2  # -2: leave a token of room
        fits = int(np.searchsorted(lengths, c, "right"))
        if fits:
            values = best[c - lengths[:fits]] + weights[:fits]
            k = int(values.argmax())
            if values[k] > best[c]:
                best[c], took[c] = values[k], k
    return best, took


def _best_fit(counts: dict[int, int], capacity: int) -> Counter:
    """Best fit decreasing over a histogram; equal bins are handled together."""
    spaces: dict[int, Counter] = {}
    for length in sorted(counts, reverse=True):
        left = counts[length]
        for space in range(length, capacity):
            while left and spaces.get(space):
                held, n = spaces[space].popitem()
                each = space // length
                full, rest = divmod(left, each)
                if full >= n:
                    full, rest = n, 0
                elif rest:
                    n -= 1
                if n > full:
                    spaces[space][held] += n - full
                for bins, k in ((full, each), (1 if rest else 0, rest)):
                    if bins:
                        spaces.setdefault(space - k * length, Counter())[held + ((length, k),)] += bins
                left -= full * each + rest
        each = capacity // length
        for bins, k in ((left // each, each), (1 if left % each else 0, left % each)):
            if bins:
                spaces.setdefault(capacity - k * length, Counter())[((length, k),)] += bins
    return sum(spaces.values(), Counter())


def plan(histogram: dict[int, int], capacity: int = CAPACITY, rounds: int = 6, steps: int = 24, each: int = 24) -> Counter:
    """configuration ((length, copies), ...) -> number of sequences, covering the histogram exactly."""
    found = Counter()
    if n := histogram.get(capacity):
        found[((capacity, 1),)] = n
    left = {k: n for k, n in histogram.items() if n and k < capacity}
    for _ in range(rounds):
        if sum(left.values()) < 4 * len(left) or not left:
            break
        lengths = np.array(sorted(left))
        demand = np.array([left[k] for k in lengths], float)
        covered, used = np.zeros(len(lengths)), Counter()
        for _ in range(steps):
            weights = lengths / capacity * np.exp(-2.0 * covered)  # the multiplicative weights
            best, took = _knapsack(lengths, weights, capacity)
            for forced in np.lexsort((-lengths, covered))[:each]:  # the least covered lengths, each in its best company
                config, room = Counter([int(forced)]), capacity - int(lengths[forced])
                while room > 0 and took[room] != -1:
                    if took[room] == -2:
                        room -= 1
                    else:
                        config[int(took[room])] += 1
                        room -= int(lengths[took[room]])
                items = np.array(list(config))
                copies = np.array(list(config.values()), float)
                size = 0.25 * (demand[items] / copies).min()
                used[tuple(sorted(config.items()))] += size
                covered[items] += size * copies / demand[items]
        scale = 1 / covered.max()
        for config, x in used.items():
            if n := int(x * scale):
                found[tuple((int(lengths[k]), c) for k, c in config)] += n
                for k, c in config:
                    left[int(lengths[k])] -= n * c
        left = {k: n for k, n in left.items() if n > 0}
    return found + _best_fit(left, capacity)


def slots(planned: Counter) -> list[tuple]:
    """(length, first rank, end rank, copies in a sequence, first sequence, offset of the first copy)."""
    ranks, sequence, out = Counter(), 0, []
    for config, n in sorted(planned.items()):
        offset = 0
        for length, copies in config:
            out.append((length, ranks[length], ranks[length] + n * copies, copies, sequence, offset))
            ranks[length] += n * copies
            offset += length * copies
        sequence += n
    return out


def pack(pieces: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """Adds sequence_id and offset to ``pieces`` (doc_id, piece, length), which must be cheap to reread."""
    histogram = {r["length"]: r["count"] for r in pieces.groupBy("length").count().collect()}  # at most capacity rows
    rows = slots(plan(histogram, capacity))
    table = pieces.sparkSession.createDataFrame(rows, "length long, first long, end long, copies long, sequence long, base long")
    placed = ranked(
        pieces.withColumn("_h", spread("doc_id", "piece")), ["length"], "_h", ["doc_id", "piece"], "_rank", sum(histogram.values())
    )
    table = F.broadcast(table) if len(rows) <= BROADCAST_ROWS else table
    nth = F.col("_rank") - F.col("first")
    return (
        placed.join(table, "length").where("_rank >= first and _rank < end")
        .withColumn("sequence_id", (F.col("sequence") + F.floor(nth / F.col("copies"))).cast("long"))
        .withColumn("offset", (F.col("base") + nth % F.col("copies") * F.col("length")).cast("long"))
        .drop("first", "end", "copies", "sequence", "base", "_rank", "_h")
    )


def tokenizer_path() -> str:
    import public_tokenizers

    return public_tokenizers.path(TOKENIZER)


def op3_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    pieces = materialize(cut(read(spark, sf_dir, "documents"), tokenizer_path()))
    return pack(pieces).select("doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset")
