"""Language identification by prediction by partial matching (PPM, escape method C, with exclusion).

Each language has a byte context tree of variable order up to ``ORDER``. A text's exact code length
under a language is the sum over its bytes of -log2 P(byte | longest context seen), where each escape
to the next shorter context costs d / (n + d) for d distinct of n occurrences, and symbols of longer
contexts are excluded from shorter ones; the last resort is uniform over the bytes not excluded. The
statistics are frozen after training, so the code length of every (context, byte) is computed once,
into one table that the executors look up for each byte: whole texts of any length, bounded memory.

Training takes a bounded sample: per language the ``sample`` documents (SAMPLE) with the smallest hash
of doc_id, among those with a text and a language whose crc32(doc_id as text) mod 5 is not 0. Bytes
that the sample never has behave alike and share one column.

Prediction: the language of the shortest code; ties go to the first in order. score: its posterior
under equal priors. Defined cases: a null text, one without a letter, and any text when nothing could
be learned are ``und`` with score 0; a null doc_id counts as held out; an empty table gives no rows;
repeated rows are predicted alike; further columns are not read by ``identify``.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tickforge.llm._common import Shared, lean, read

ORDER, SAMPLE, FOLDS = 3, 250, 5
PAD = b"\n" * ORDER
BLOCK = 1 << 20
UNKNOWN = "und"


def fold():
    """crc32(doc_id as text) mod 5; 0 is held out."""
    return F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary")) % FOLDS


def _grams(text: bytes) -> np.ndarray:
    """Each byte with the ORDER bytes before it, as one integer."""
    b = np.frombuffer(PAD + text, np.uint8).astype(np.int64)
    out = np.zeros(len(text), np.int64)
    for k in range(ORDER + 1):
        out = out << 8 | b[k:k + len(text)]
    return out


def _count(batches):
    for batch in batches:
        by: dict[str, list] = {}
        for lang, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            by.setdefault(lang, []).append(_grams(text.encode("utf-8", "replace")))
        for lang, found in by.items():
            gram, n = np.unique(np.concatenate(found), return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array([lang] * len(gram), pa.string()), pa.array(gram), pa.array(n.astype(np.int64))], names=["lang", "gram", "n"])


def sample_counts(docs: DataFrame, sample: int = SAMPLE) -> DataFrame:
    """lang, gram, n: the n-grams of the training sample."""
    ids = docs.where((fold() != 0) & F.col("lang").isNotNull() & F.col("text").isNotNull()).select("lang", "doc_id").distinct()
    # Only ids whose hash is low enough to be among some times ``sample`` of their language are ordered.
    many = ids.groupBy("lang").agg(F.count(F.lit(1)).alias("_n"))
    bound = F.lit(-(2.0**63)) + F.lit(2.0**64) * F.least(F.lit(1.0), F.lit(4.0 * sample + 100) / F.col("_n"))
    ids = ids.join(many, "lang").where(F.xxhash64("doc_id").cast("double") <= bound).drop("_n")
    order = Window.partitionBy("lang").orderBy(F.xxhash64("doc_id"), "doc_id")
    chosen = ids.withColumn("_k", F.row_number().over(order)).where(F.col("_k") <= sample).select("lang", "doc_id")
    # At most ``sample`` rows a language.
    texts = docs.where(F.col("text").isNotNull()).select("doc_id", "lang", "text").join(F.broadcast(chosen), ["doc_id", "lang"], "left_semi")
    texts = texts.groupBy("lang", "doc_id").agg(F.min("text").alias("text"))  # of rows that share a doc_id, one
    # A language's sample is bounded, and is counted in one task.
    return texts.select("lang", "text").repartition("lang").mapInArrow(lean(_count), "lang string, gram long, n long").groupBy("lang", "gram").agg(F.sum("n").alias("n"))


class Model:
    """Frozen code lengths. ``table[row * width + class]``: bits of a byte class after a context, per language."""

    def __init__(self, counts: dict[str, dict[int, int]]):
        self.langs = sorted(counts)
        grams = {lang: (np.array(list(c), np.int64), np.array(list(c.values()), np.int64)) for lang, c in counts.items()}
        seen = np.zeros(256, bool)
        for g, _ in grams.values():
            for k in range(ORDER + 1):
                seen[np.unique(g >> 8 * k & 255)] = True
        seen[10] = True  # the padding
        self.classes = np.zeros(256, np.int32)
        self.classes[seen] = np.arange(1, seen.sum() + 1)
        self.width = w = int(seen.sum()) + 1
        # Contexts of order k as integers in base w, the nearest byte last; a row for each that any language has.
        contexts, each = [], {}
        for lang, (g, n) in grams.items():
            digits = [self.classes[g >> 8 * k & 255].astype(np.int64) for k in range(ORDER + 1)]
            each[lang] = []
            for k in range(ORDER + 1):
                c = sum((digits[j + 1] * w**j for j in range(k)), np.zeros(len(g), np.int64))
                each[lang].append((c, digits[0], n))
        for k in range(ORDER + 1):
            contexts.append(np.unique(np.concatenate([each[lang][k][0] for lang in self.langs])))
        first = np.cumsum([0, *map(len, contexts)])
        tables = []
        for lang in self.langs:
            tally = []
            for k in range(ORDER + 1):
                c, s, n = each[lang][k]
                t = np.zeros((len(contexts[k]), w))
                np.add.at(t, (np.searchsorted(contexts[k], c), s), n)
                tally.append(t)
            tables.append(np.concatenate([self._bits(contexts, tally, k, w) for k in range(ORDER + 1)]))
        self.table = np.ascontiguousarray(np.stack(tables, -1).reshape(-1, len(self.langs)), np.float32)
        # The row of the longest context seen by any language, for each full context.
        rows = np.zeros(1, np.int32)
        for k in range(1, ORDER + 1):
            rows = np.tile(rows, w)  # a longer context starts as its suffix
            rows[contexts[k]] = first[k] + np.arange(len(contexts[k]))
        self.rows = rows

    @staticmethod
    def _bits(contexts, tally, order, w):
        """Code lengths of every class after each context of ``order``, by escapes down to order -1."""
        n = len(contexts[order])
        p, mass, excluded = np.zeros((n, w)), np.ones((n, 1)), np.zeros((n, w), bool)
        for k in range(order, -1, -1):
            suffix = contexts[order] % w**k
            at = np.searchsorted(contexts[k], suffix)
            c = np.where(excluded, 0.0, tally[k][at])
            total, distinct = c.sum(1, keepdims=True), (c > 0).sum(1, keepdims=True)
            some = total > 0
            p += np.where(c > 0, mass * c / np.where(some, total + distinct, 1), 0)
            mass = np.where(some, mass * distinct / np.where(some, total + distinct, 1), mass)
            excluded |= c > 0
        uniform = mass / np.maximum(1, 256 - excluded.sum(1, keepdims=True))
        return -np.log2(np.where(excluded, p, uniform))

    def code_lengths(self, texts: list[bytes]) -> np.ndarray:
        """Bits of each text under each language."""
        out = np.zeros((len(texts), len(self.langs)))
        parts, owners, size = [], [], 0
        for k, text in enumerate(texts):
            for at in range(0, len(text), BLOCK):
                parts.append((PAD + text[:BLOCK]) if at == 0 else text[at - ORDER:at + BLOCK])
                owners.append(k)
                size += len(parts[-1])
                if size >= BLOCK:
                    self._add(parts, owners, out)
                    parts, owners, size = [], [], 0
        if parts:
            self._add(parts, owners, out)
        return out

    def _add(self, parts, owners, out):
        c = self.classes[np.frombuffer(b"".join(parts), np.uint8)]
        key = c[:-ORDER].copy()
        for k in range(1, ORDER):
            key *= self.width
            key += c[k:k - ORDER]
        at = self.rows[key].astype(np.int64)
        at *= self.width
        at += c[ORDER:]
        ends = np.cumsum([len(p) for p in parts]) - ORDER
        starts = np.concatenate([[0], ends[:-1] + ORDER])
        cuts = np.stack([starts, ends], 1).ravel()[:-1]  # parts, and the places that look across two parts
        for j in range(len(self.langs)):
            sums = np.add.reduceat(self.table[:, j][at], cuts, dtype=np.float64)[::2]
            np.add.at(out[:, j], owners, sums)


def train(docs: DataFrame, sample: int = SAMPLE) -> Model | None:
    counts: dict[str, dict[int, int]] = {}
    for lang, gram, n in sample_counts(docs, sample).collect():  # bounded by the sample
        counts.setdefault(lang, {})[gram] = n
    return Model(counts) if counts else None


def has_letter(text: str) -> bool:
    return any(map(str.isalpha, text))


def identify(docs: DataFrame, model: Model | None) -> DataFrame:
    """doc_id, lang_pred, score, bits (per byte, under the language predicted)."""
    shared = Shared(docs.sparkSession, model)

    def predict(batches):
        model = shared.get()
        for batch in batches:
            for at in range(0, batch.num_rows, 1000):
                part = batch.slice(at, 1000)
                texts = part.column(1).to_pylist()
                known = [k for k, t in enumerate(texts) if model and t and has_letter(t)]
                langs, scores, bits = [UNKNOWN] * len(texts), np.zeros(len(texts)), [None] * len(texts)
                if known:
                    raw = [texts[k].encode("utf-8", "replace") for k in known]
                    cost = model.code_lengths(raw)
                    best = cost.argmin(1)
                    least = cost.min(1, keepdims=True)
                    scores[known] = 1 / np.exp2(np.maximum(least - cost, -1000)).sum(1)
                    for k, j, x, r in zip(known, best, least[:, 0], raw):
                        langs[k], bits[k] = model.langs[j], float(x) / len(r)
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), pa.array(langs, pa.string()), pa.array(scores), pa.array(bits, pa.float64())],
                    names=["doc_id", "lang_pred", "score", "bits"],
                )

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(lean(predict), "doc_id long, lang_pred string, score double, bits double")


def keep_identified(docs: DataFrame, model: Model | None, min_score: float = 0.5) -> DataFrame:
    """The rows of ``docs`` whose text has a language with a posterior of at least min_score."""
    shared = Shared(docs.sparkSession, model)
    place = docs.columns.index("text")

    def kept(batches):
        model = shared.get()
        for batch in batches:
            for at in range(0, batch.num_rows, 1000):
                part = batch.slice(at, 1000)
                texts = part.column(place).to_pylist()
                known = [k for k, t in enumerate(texts) if model and t and has_letter(t)]
                stays = np.zeros(len(texts), bool)
                if known:
                    cost = model.code_lengths([texts[k].encode("utf-8", "replace") for k in known])
                    least = cost.min(1, keepdims=True)
                    stays[known] = 1 / np.exp2(np.maximum(least - cost, -1000)).sum(1) >= min_score
                yield part.filter(pa.array(stays))

    return docs.mapInArrow(lean(kept), docs.schema)


def op5_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    model = train(docs)
    return identify(docs, model).withColumn("held_out", fold() == 0).select("doc_id", "held_out", "lang_pred", "score", "bits")
