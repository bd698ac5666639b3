"""N-gram Jaccard join by T-occurrence search (MergeSkip's short lists, DivideSkip's long ones).

A text's set holds its distinct 5-word shingles as 64-bit hashes; two texts link when 100 * common >=
75 * union. Equal sets are one class. For a set of n shingles at most e = n - ceil(0.75 n) may be
missing from a partner, so two linked sets share at least k of their e + k smallest hashes: these
prefixes are posted to an inverted index that is dealt by hash and handled as arrays, not rows.

* Short lists (at most SHORT classes) are merged: each pair on one is counted.
* Long lists are skipped: of their first members, the two that a set shares most with are tried, which
  ties large groups of copies together at the cost of two pairs a set. A pair of different components
  is a candidate when short lists count it k times, less the long lists that its sets lie on. All are
  verified on whole sets by binary search.
* The links found so far are closed. A long list whose members are now one component is settled. A set
  that lies on k or more unsettled long lists may still have missed a partner of the same kind: all
  such sets are searched again among themselves with their whole sets in the index (k is then the
  required overlap T), and those for which even that does not leave one short list are searched
  directly, in groups of sets that may link: short lists merged, candidates kept that can still
  reach T, long lists probed for these by binary search.

So no list is ever expanded into its pairs and no candidate is dropped. Tables of tokens travel as
packed arrays. A shingle that a sample finds on very many texts is a list in pieces, dealt by a hash of
the member: each piece has its first, the firsts of all pieces are tried with the least of them, and the
list is settled when all pieces together are. Which shingles these are changes no result.

Defined cases: a null text, or one without a word, has an empty set and links with nothing; under five
words the whole sequence is the one shingle; rows are documents, and those that share a doc_id form
their components by their texts; rows with a null doc_id link like others but name no component, so
that component_id is null where no row of a component has a doc_id; repeated rows are linked; an empty
table gives no rows; further columns are not read.
"""

from __future__ import annotations

import functools
import heapq
import itertools
import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tickforge.llm._common import BROADCAST_ROWS, counted, lean, materialize, parallelism, read
from tickforge.llm.components import components
from tickforge.llm.vectors import each_group

WIDTH, PERCENT, SHORT = 5, 75, 8
SLACK = 20  # k is 1 + n // SLACK
#: Items of a list from which it is probed rather than read.
PROBE = 4096
CHUNK, PART_POSTINGS, SEARCH_TOKENS = 1 << 20, 500_000, 1 << 16
#: One class in so many is looked at to find shingles of very many texts, and how many of these make one heavy.
SAMPLED, HEAVY = 64, 64

_LOWER = bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))
_SPACE = np.zeros(256, bool)
_SPACE[[32, *range(9, 14)]] = True
_ODD = np.random.default_rng(5).integers(1 << 62, size=WIDTH + 2, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_BYTE = np.random.default_rng(7).integers(1 << 63, size=256, dtype=np.uint64)


def mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


class Shingler:
    """texts -> their shingle sets, all words of a chunk at once by prefix sums of a polynomial hash."""

    def __init__(self):
        self.power = self.inverse = np.zeros(0, np.uint64)

    def _powers(self, n):
        if len(self.power) < n:
            n = max(n, CHUNK + (CHUNK >> 2))
            base = int(_ODD[-1])
            for name, b in (("power", base), ("inverse", pow(base, -1, 1 << 64))):
                steps = np.full(n, b, np.uint64)
                steps[0] = 1
                setattr(self, name, np.multiply.accumulate(steps))

    def sets(self, texts: list[bytes | None]):
        """Yields (tokens, lengths) for runs of texts: each text's sorted distinct tokens, one after another."""
        at = 0
        while at < len(texts):
            end, size = at, 0
            while end < len(texts) and (end == at or size + len(texts[end] or b"") < CHUNK):
                size += len(texts[end] or b"") + 1
                end += 1
            yield self._chunk([t or b"" for t in texts[at:end]])
            at = end

    def _chunk(self, texts):
        b = np.frombuffer(b" ".join([b"", *texts, b""]).translate(_LOWER), np.uint8)
        self._powers(len(b))
        space = _SPACE[b]
        start = np.flatnonzero(space[:-1] & ~space[1:]) + 1
        end = np.flatnonzero(~space[:-1] & space[1:]) + 1
        sums = np.zeros(len(b) + 1, np.uint64)
        np.cumsum(_BYTE[b] * self.power[:len(b)], out=sums[1:])
        word = mixed((sums[end] - sums[start]) * self.inverse[start])
        limits = np.cumsum([1, *[len(t) + 1 for t in texts]])
        first = np.searchsorted(start, limits)
        words = np.diff(first)
        doc = np.repeat(np.arange(len(texts)), words)
        whole = len(word) - WIDTH + 1
        token, owner = np.zeros(0, np.uint64), np.zeros(0, np.int64)
        if whole > 0:
            inside = doc[:whole] == doc[WIDTH - 1:]
            total = np.zeros(whole, np.uint64)
            for k in range(WIDTH):
                total += word[k:k + whole] * _ODD[k]
            token, owner = mixed(total[inside]), doc[:whole][inside]
        few = np.flatnonzero((words > 0) & (words < WIDTH))
        if len(few):
            each = [np.uint64((int((word[first[d]:first[d] + words[d]] * _ODD[:words[d]]).sum(dtype=np.uint64)) + int(_ODD[WIDTH]) * int(words[d])) & (1 << 64) - 1) for d in few]
            token, owner = np.concatenate([token, mixed(np.array(each, np.uint64))]), np.concatenate([owner, few])
        order = np.lexsort((token, owner))
        token, owner = token[order], owner[order]
        new = np.ones(len(token), bool)
        new[1:] = (token[1:] != token[:-1]) | (owner[1:] != owner[:-1])
        return token[new], np.bincount(owner[new], minlength=len(texts))


def classes_of(tokens: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """A 64-bit name of each set, from its tokens; an empty set's is 0."""
    out = np.zeros(len(lengths), np.uint64)
    some = np.flatnonzero(lengths)
    if len(some):
        starts = (np.cumsum(lengths) - lengths)[some]
        out[some] = mixed(np.add.reduceat(mixed(tokens), starts) + lengths[some].astype(np.uint64) * _ODD[0])
    return out.view(np.int64)


def required(n):
    """T: the least overlap of a set of n with a partner."""
    return -(-n * PERCENT // 100)


def threshold(n: np.ndarray, whole: bool) -> np.ndarray:
    """k: how many of their posted tokens two linked sets, the smaller of n, share."""
    return required(n) if whole else np.minimum(required(n), 1 + n // SLACK)


def _arrow(**columns):
    return pa.RecordBatch.from_arrays([pa.array(v) if not isinstance(v, pa.Array) else v for v in columns.values()], names=list(columns))


def _texts(column):
    return column.cast(pa.binary()).to_pylist()


def text_key():
    """What a row's text is known by: with null as a text of its own."""
    return F.xxhash64("text")


def document_sets(docs: DataFrame) -> DataFrame:
    """doc_id, x, n, c for each row of ``docs`` (doc_id, text): its text's key, the size and the class of its set."""
    def sizes(batches):
        shingler = Shingler()
        for batch in batches:
            n, c = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
            for tokens, lengths in shingler.sets(_texts(batch.column(2))):
                n.append(lengths)
                c.append(classes_of(tokens, lengths))
            yield _arrow(doc_id=batch.column(0), x=batch.column(1), n=np.concatenate(n).astype(np.int64), c=np.concatenate(c))

    return docs.select(F.col("doc_id").cast("long"), text_key().alias("x"), "text").mapInArrow(lean(sizes), "doc_id long, x long, n long, c long")


def whole_sets(docs: DataFrame, wanted: DataFrame) -> DataFrame:
    """c, n, tokens (packed) for the classes of ``wanted`` (x, c), each from one of its texts."""
    def packed(batches):
        shingler = Shingler()
        for batch in batches:
            out, at, wanted_names = ([], [], []), 0, batch.column(1).to_numpy()
            for tokens, lengths in shingler.sets(_texts(batch.column(0))):
                ends, names = np.cumsum(lengths), classes_of(tokens, lengths)
                for k in np.flatnonzero(names == wanted_names[at:at + len(lengths)]):  # but for texts whose keys collide
                    out[0].append(names[k])
                    out[1].append(int(lengths[k]))
                    out[2].append(tokens[ends[k] - lengths[k]:ends[k]].tobytes())
                at += len(lengths)
            yield _arrow(c=pa.array(out[0], pa.int64()), n=pa.array(out[1], pa.int64()), tokens=pa.array(out[2], pa.binary()))

    wanted, number = counted(wanted)
    wanted = F.broadcast(wanted) if number <= 10 * BROADCAST_ROWS else wanted  # rows of two longs
    texts = docs.select(text_key().alias("x"), "text").join(wanted, "x")
    sets = texts.select("text", "c").mapInArrow(lean(packed), "c long, n long, tokens binary")
    return sets.groupBy("c").agg(F.min("n").alias("n"), F.min("tokens").alias("tokens"))


def _prefixes(tokens, lengths, names, whole: bool):
    """(token, owner) of the posted tokens of a run, of equal sets in it but one."""
    starts = np.cumsum(lengths) - lengths
    once = np.zeros(len(lengths), bool)
    once[np.unique(names, return_index=True)[1]] = True
    posted = np.where(once, lengths if whole else np.minimum(lengths, lengths - required(lengths) + threshold(lengths, whole)), 0)
    owner = np.repeat(np.arange(len(lengths)), posted)
    at = np.arange(len(owner)) - np.repeat(np.cumsum(posted) - posted, posted) + np.repeat(starts, posted)
    return tokens[at], owner


def _posted(sets, parts: int, whole: bool, heavy: np.ndarray):
    """Packs the posted tokens of (tokens, lengths, classes) runs by the part of the index they belong to.

    Heavy tokens (sorted) are dealt by their members instead, the same for all of them.
    """
    width = (1 << 64) // parts + 1
    for tokens, lengths, names in sets:
        token, owner = _prefixes(tokens, lengths, names, whole)
        if not len(token):
            continue
        by = np.where(_among(token, heavy), names[owner].view(np.uint64), token)
        part = (mixed(by) // np.uint64(width)).astype(np.int64)
        order = np.argsort(part, kind="stable")
        part, token, owner = part[order], token[order], owner[order].astype(np.int64)
        cuts = np.flatnonzero(np.diff(part, prepend=-1))
        for a, b in zip(cuts, [*cuts[1:], len(part)]):
            own, member = np.unique(owner[a:b], return_inverse=True)
            yield int(part[a]), token[a:b].tobytes(), member.astype(np.uint32).tobytes(), names[own].tobytes(), lengths[own].astype(np.uint32).tobytes()


def _among(token: np.ndarray, heavy: np.ndarray) -> np.ndarray:
    if not len(heavy):
        return np.zeros(len(token), bool)
    return heavy[np.minimum(np.searchsorted(heavy, token), len(heavy) - 1)] == token


POSTINGS = "part int, token binary, member binary, name binary, size binary"


def _postings(rows):
    found = list(rows)
    if found:
        part, token, member, name, size = zip(*found)
        blob = lambda x: pa.array(x, pa.binary())
        yield _arrow(part=pa.array(part, pa.int32()), token=blob(token), member=blob(member), name=blob(name), size=blob(size))


#: kind 0: the classes a, b are together on v short lists. kind 1: class a lies on v long lists of members b.
#: kind 2: class a is the first of v long lists that hold b. kind 3: class a is the first of a piece of the heavy list b.
FOUND = "kind int, a long, b long, na long, nb long, v long"


def _lists(batches, heavy: np.ndarray):
    """The lists of one part of the index: pairs of short lists, counted; stars of long lists, counted; the long lists."""
    token, name, size = [], [], []
    for batch in batches:
        for row in batch.to_pylist():
            member = np.frombuffer(row["member"], np.uint32)
            token.append(np.frombuffer(row["token"], np.uint64))
            name.append(np.frombuffer(row["name"], np.int64)[member])
            size.append(np.frombuffer(row["size"], np.uint32)[member])
    if not token:
        return
    token, name, size = np.concatenate(token), np.concatenate(name), np.concatenate(size).astype(np.int64)
    order = np.lexsort((name, token))
    token, name, size = token[order], name[order], size[order]
    new = np.ones(len(token), bool)
    new[1:] = (token[1:] != token[:-1]) | (name[1:] != name[:-1])
    token, name, size = token[new], name[new], size[new]
    start = np.flatnonzero(np.r_[True, token[1:] != token[:-1]]) if len(token) else np.zeros(0, np.int64)
    length = np.diff(np.r_[start, len(token)])
    pieces = _among(token[start], heavy)
    pairs = []  # places of a and b
    for m in range(2, SHORT + 1):
        rows = start[(length == m) & ~pieces]
        pairs += [(rows + i, rows + j) for i in range(m) for j in range(i + 1, m)]
    far = np.flatnonzero((length > SHORT) | pieces)
    begin = np.repeat(start[far], length[far])
    inside = np.arange(len(begin)) - np.repeat(np.cumsum(length[far]) - length[far], length[far]) + begin
    short = tuple(np.concatenate(x) for x in zip(*pairs))
    for kind, (a, b) in ((0, short), (2, (begin[inside != begin], inside[inside != begin]))):
        na, nb = size[a], size[b]
        near = np.minimum(na, nb) * 100 >= np.maximum(na, nb) * PERCENT
        if near.any():
            both = np.stack([name[a][near], name[b][near], na[near], nb[near]], 1)
            both = both[np.lexsort((both[:, 1], both[:, 0]))]
            cut = np.flatnonzero(np.r_[True, (both[1:, :2] != both[:-1, :2]).any(1)])
            count = np.diff(np.r_[cut, len(both)]).astype(np.int64)
            a, b, na, nb = both[cut].T.copy()
            yield _arrow(kind=np.full(len(cut), kind, np.int32), a=a, b=b, na=na, nb=nb, v=count)
    if len(far):
        # Lists of the same members are one list that counts several times; a piece goes by its token.
        mark = mixed(name[inside].view(np.uint64))
        cut = np.cumsum(length[far]) - length[far]
        sign = mixed(np.add.reduceat(mark, cut) + length[far].astype(np.uint64))
        sign = np.where(pieces[far], token[start[far]], sign).view(np.int64)
        own = far[pieces[far]]
        if len(own):
            zero = np.zeros(len(own), np.int64)
            yield _arrow(kind=np.full(len(own), 3, np.int32), a=name[start[own]], b=token[start[own]].view(np.int64), na=size[start[own]], nb=zero, v=zero)
        sign, first, times = np.unique(sign, return_index=True, return_counts=True)
        for k in range(0, len(sign), 1000):
            at = np.concatenate([start[far[f]] + np.arange(length[far[f]]) for f in first[k:k + 1000]])
            n = length[far[first[k:k + 1000]]]
            zero = np.zeros(len(at), np.int64)
            yield _arrow(kind=np.ones(len(at), np.int32), a=name[at], b=np.repeat(sign[k:k + 1000], n), na=size[at], nb=zero, v=np.repeat(times[k:k + 1000], n).astype(np.int64))


def index_pass(source: DataFrame, postings: int, whole: bool) -> DataFrame:
    """FOUND, over an index of ``source``: (doc_id, text), or (c, n, tokens) when whole."""
    spark = source.sparkSession
    parts = max(parallelism(spark), math.ceil(postings / PART_POSTINGS))
    source = source.select("c", "n", "tokens") if whole else source.select("text")

    def runs_of(batches):
        shingler = Shingler()
        for batch in batches:
            if whole:
                tokens = np.frombuffer(b"".join(batch.column(2).to_pylist()), np.uint64)
                yield tokens, batch.column(1).to_numpy(), batch.column(0).to_numpy()
            else:
                for t, n in shingler.sets(_texts(batch.column(0))):
                    yield t, n, classes_of(t, n)

    def sampled(batches):
        for tokens, lengths, names in runs_of(batches):
            token, n = np.unique(_prefixes(tokens, lengths, names, whole)[0], return_counts=True)
            yield _arrow(token=token.view(np.int64), n=n.astype(np.int64))

    few = source.where(F.pmod(F.xxhash64("c" if whole else "text", F.lit(1)), F.lit(SAMPLED)) == 0)
    seen = few.mapInArrow(lean(sampled), "token long, n long").groupBy("token").agg(F.sum("n").alias("n")).where(F.col("n") > HEAVY)
    # At most BROADCAST_ROWS tokens can be this frequent.
    seen = materialize(seen)
    total = seen.agg(F.sum("n")).first()[0] or 0
    often = seen.where(F.col("n") > total // BROADCAST_ROWS).select("token").toArrow().column(0).to_numpy() if total else np.zeros(0, np.int64)
    heavy = spark.sparkContext.broadcast(np.sort(often.astype(np.int64).view(np.uint64)))

    dealt = source.mapInArrow(lean(lambda batches: _postings(_posted(runs_of(batches), parts, whole, heavy.value))), POSTINGS).repartition(parts, "part")
    return dealt.mapInArrow(lean(lambda batches: _lists(batches, heavy.value)), FOUND)


def _columns(n, whole):
    """threshold() as an expression."""
    need = F.ceil(n * PERCENT / 100).cast("long")
    return need if whole else F.least(need, F.floor(n / SLACK).cast("long") + 1)


def verified(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """a, b: the pairs that link. Each pair brings the set of b to the set of a."""
    left = sets.select(F.col("c").alias("a"), F.lit(0).cast("long").alias("b"), "tokens")
    right = pairs.join(sets, pairs["b"] == sets["c"]).select("a", "b", "tokens")
    # A class with very many partners is cut into groups that each get its set.
    salt = F.pmod(F.xxhash64("b"), F.col("groups")).cast("int")
    groups = pairs.groupBy("a").agg(F.ceil(F.count(F.lit(1)) / 256).cast("int").alias("groups"))
    groups = materialize(groups)
    right = right.join(groups, "a").select("a", salt.alias("salt"), F.lit(1).alias("side"), "b", "tokens")
    left = left.join(groups, "a").withColumn("salt", F.explode(F.sequence(F.lit(0), F.col("groups") - 1)))
    both = left.select("a", "salt", F.lit(0).alias("side"), "b", "tokens").unionByName(right)

    def check(batches):
        def one(group):
            side = group.column(2).to_numpy()
            rows = group.column(4).to_pylist()
            own = np.frombuffer(rows[int(np.flatnonzero(side == 0)[0])], np.uint64) if (side == 0).any() else np.zeros(0, np.uint64)
            hits = []
            for k in np.flatnonzero(side == 1) if len(own) else ():
                other = np.frombuffer(rows[k], np.uint64)
                at = np.searchsorted(own, other)
                common = int((own[np.minimum(at, len(own) - 1)] == other).sum())
                if 100 * common >= PERCENT * (len(own) + len(other) - common):
                    hits.append(k)
            t = group.take(pa.array(hits, pa.int64()))
            for b in t.select([0, 3]).combine_chunks().to_batches():
                yield pa.RecordBatch.from_arrays([b.column(0), b.column(1)], names=["a", "b"])

        return each_group(batches, 2, one)

    parts = parallelism(pairs.sparkSession)
    return both.repartition(parts, "a", "salt").sortWithinPartitions("a", "salt").mapInArrow(lean(check), "a long, b long")


def divide_skip(lists: list[np.ndarray], need: int, long_lists: int) -> tuple[np.ndarray, np.ndarray]:
    """(items, counts): every item on at least ``need`` of the sorted lists.

    All but the longest lists are merged, by a heap, or in bulk when they are large; an item seen there at
    least need - long_lists times is looked up in the long lists by binary search. Long lists of too few
    items for that to pay are counted in one pass.
    """
    lists = sorted(lists, key=len)
    cut = len(lists) - min(long_lists, need - 1, len(lists))
    short, far = lists[:cut], lists[cut:]
    if sum(map(len, short)) > 256:
        items, counts = tallied(np.concatenate(short))
    else:
        merged = [(item, sum(1 for _ in run)) for item, run in itertools.groupby(heapq.merge(*(x.tolist() for x in short)))]
        items, counts = (np.array(v, np.int64) for v in (zip(*merged) if merged else ((), ())))
    some = counts >= need - len(far)  # what can still reach the overlap
    items, counts = items[some], counts[some]
    if len(items) and far and sum(map(len, far)) < PROBE * len(far):
        seen, times = tallied(np.concatenate(far))
        at = np.minimum(np.searchsorted(seen, items), len(seen) - 1)
        counts, far = counts + np.where(seen[at] == items, times[at], 0), []
    left = len(far)
    for x in far:
        some = counts >= need - left
        items, counts = items[some], counts[some]
        if not len(items):
            break
        at = np.minimum(np.searchsorted(x, items), len(x) - 1)
        counts = counts + (x[at] == items)
        left -= 1
    return items[counts >= need], counts[counts >= need]


def tallied(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The distinct items of x in order, and how often each occurs; small items without a sort."""
    if len(x) and x.min() >= 0 and x.max() < 4 * len(x):
        counts = np.bincount(x)
        items = np.flatnonzero(counts)
        return items, counts[items]
    return np.unique(x, return_counts=True)


def direct_search(sets: DataFrame) -> DataFrame:
    """a, b: links that join different components among ``sets`` (c, component, n, tokens), by searches in groups.

    With all tokens in one order, two linked sets share one of the first n - T + 1 tokens of both. Tokens
    are ordered by the least set that has them, and sets meet in the groups of these: as the least of a
    family leads most of its tokens, a set comes to few groups. A large group is cut into blocks by its
    number of tokens, and each pair of blocks is a group. In a group all members but those of its largest component are
    queries, and links that join nothing new are left out.
    """
    def exploded(batches):
        for batch in batches:
            rows = batch.to_pylist()
            token = [np.frombuffer(r["tokens"], np.uint64).view(np.int64) for r in rows]
            size = [len(t) for t in token]
            yield _arrow(c=np.repeat([r["c"] for r in rows], size).astype(np.int64), n=np.repeat(size, size).astype(np.int64), token=np.concatenate(token) if token else np.zeros(0, np.int64))

    sets = materialize(sets.select("c", "component", "n", "tokens"))
    rows = materialize(sets.select("c", "n", "tokens").mapInArrow(lean(exploded), "c long, n long, token long"))
    firsts = rows.groupBy("token").agg(F.min("c").alias("first"))
    rows = rows.join(firsts, "token")
    leading = Window.partitionBy("c").orderBy("first", "token")
    rows = rows.withColumn("k", F.row_number().over(leading)).where(F.col("k") <= F.col("n") - F.ceil(F.col("n") * PERCENT / 100) + 1)
    rows = materialize(rows.select("first", "c", "n").distinct())
    sizes = materialize(rows.groupBy("first").agg(F.ceil(F.sum("n") / SEARCH_TOKENS).cast("int").alias("blocks"), F.count(F.lit(1)).alias("m")).where("m > 1"))
    rows = rows.drop("n").join(sizes, "first")
    blocks = F.col("blocks")
    rows = rows.withColumn("block", F.pmod(F.xxhash64("c"), blocks).cast("int")).withColumn("other", F.explode(F.sequence(F.lit(0), blocks - 1)))
    groups = rows.select("first", F.least("block", "other").alias("i"), F.greatest("block", "other").alias("j"), "block", "c").join(sets, "c")
    groups = groups.select("first", "i", "j", "block", "c", "component", "n", "tokens")

    def find(batches):
        def one(group):
            component = group.column("component").to_numpy()
            names, at, size = np.unique(component, return_inverse=True, return_counts=True)
            if len(names) < 2:
                return
            block, c, n = (group.column(x).to_numpy() for x in ("block", "c", "n"))
            raw = group.column("tokens").to_pylist()
            tokens = [np.frombuffer(x, np.uint64) for x in raw]
            owner = np.repeat(np.arange(len(tokens)), [len(t) for t in tokens])
            flat = np.concatenate(tokens)
            order = np.lexsort((owner, flat))
            flat, owner = flat[order], owner[order]
            split = group.column("i")[0].as_py() != group.column("j")[0].as_py()
            index = {None: (flat, owner)}
            if split:  # a set meets those of the other block alone
                index = {b: (flat[block[owner] != b], owner[block[owner] != b]) for b in np.unique(block)}
            parent = np.arange(len(names))
            out = [[], []]
            for q in np.flatnonzero(at != size.argmax()):
                flat, owner = index[block[q] if split else None]
                begin, end = np.searchsorted(flat, tokens[q]), np.searchsorted(flat, tokens[q], "right")
                need = int(required(int(n[q])))
                items, common = divide_skip([owner[x:y] for x, y in zip(begin, end)], need, need - 1)
                good = 100 * common >= PERCENT * (n[q] + n[items] - common)
                for k in items[good]:
                    x, y = root(parent, at[q]), root(parent, at[k])
                    if x != y:
                        parent[max(x, y)] = min(x, y)
                        out[0].append(int(c[q]))
                        out[1].append(int(c[k]))
            if out[0]:
                yield _arrow(a=pa.array(out[0], pa.int64()), b=pa.array(out[1], pa.int64()))

        return each_group(batches, 3, one)

    parts = parallelism(sets.sparkSession)
    return groups.repartition(parts, "first", "i", "j").sortWithinPartitions("first", "i", "j").mapInArrow(lean(find), "a long, b long")


def root(parent: np.ndarray, k: int) -> int:
    while parent[k] != k:
        parent[k] = parent[parent[k]]
        k = parent[k]
    return int(k)


def _closed(links: DataFrame) -> DataFrame:
    return materialize(components(links).select(F.col("id").alias("c"), "component"))


def _unsettled(found: DataFrame, labels: DataFrame, whole: bool) -> DataFrame:
    """c: the sets on at least k long lists whose members are not yet one component."""
    lies = found.where("kind = 1").select(F.col("a").alias("c"), F.col("b").alias("list"), "v", F.col("na").alias("n"))
    lies = lies.join(labels, "c", "left").withColumn("component", F.coalesce("component", "c"))
    lies = materialize(lies)
    open_lists = lies.groupBy("list").agg(F.min("component").alias("low"), F.max("component").alias("high")).where("low <> high")
    open_lists = materialize(open_lists.select("list"))
    number = open_lists.count()
    open_lists = F.broadcast(open_lists) if number <= 10 * BROADCAST_ROWS else open_lists
    on = lies.join(open_lists, "list", "left_semi").groupBy("c").agg(F.sum("v").alias("v"), F.min("n").alias("n"))
    return on.where(F.col("v") >= _columns(F.col("n"), whole)).select("c")


def _stars(found: DataFrame, whole: bool) -> DataFrame:
    """a, b: for each set, the two firsts of long lists it shares most with; for the firsts of pieces, the least of them.

    They only serve to settle lists early.
    """
    stars = found.where("kind = 2").groupBy("a", "b").agg(F.sum("v").alias("v"), F.min("na").alias("na"), F.min("nb").alias("nb"))
    stars = stars.where(2 * F.col("v") >= _columns(F.least("na", "nb"), whole))
    best = Window.partitionBy("b").orderBy(F.desc("v"), "a")
    stars = stars.withColumn("k", F.row_number().over(best)).where("k <= 2").select("a", "b")
    firsts = found.where("kind = 3").select(F.col("b").alias("list"), "a")
    least = firsts.groupBy("list").agg(F.min("a").alias("least"))
    pieces = firsts.join(least, "list").where("a <> least").select(F.col("least").alias("a"), F.col("a").alias("b"))
    return materialize(stars.unionByName(pieces).distinct())


def _candidates(found: DataFrame, labels: DataFrame, whole: bool) -> DataFrame:
    """a, b: pairs of different components that short lists count k times, less the long lists of the one that lies on fewer."""
    pairs = found.where("kind = 0").groupBy("a", "b").agg(F.sum("v").alias("v"), F.min("na").alias("na"), F.min("nb").alias("nb"))
    lies = materialize(found.where("kind = 1").groupBy(F.col("a").alias("c")).agg(F.sum("v").alias("w")))
    for side in ("a", "b"):
        pairs = pairs.join(lies.select(F.col("c").alias(side), F.col("w").alias(f"w{side}")), side, "left")
        pairs = pairs.join(labels.select(F.col("c").alias(side), F.col("component").alias(f"l{side}")), side, "left")
    skipped = F.least(F.coalesce("wa", F.lit(0)), F.coalesce("wb", F.lit(0)))
    need = F.greatest(F.lit(1), _columns(F.least("na", "nb"), whole) - skipped)
    apart = F.coalesce("la", "a") != F.coalesce("lb", "b")
    return materialize(pairs.where((F.col("v") >= need) & apart).select("a", "b"))


def joined(labels: DataFrame | None, links: DataFrame) -> DataFrame:
    """c, component after ``links`` (a, b) have been added to the components of ``labels``."""
    if labels is None:
        return _closed(links)
    for side in ("a", "b"):
        links = links.join(labels.select(F.col("c").alias(side), F.col("component").alias(f"l{side}")), side, "left")
    tops = materialize(links.select(F.coalesce("la", "a").alias("a"), F.coalesce("lb", "b").alias("b")).where("a <> b").distinct())
    if not tops.limit(1).count():
        return labels
    new = _closed(tops)
    moved = labels.join(new.select(F.col("c").alias("component"), F.col("component").alias("top")), "component", "left")
    moved = moved.select("c", F.coalesce("top", "component").alias("component"))
    return materialize(moved.unionByName(new.join(labels, "c", "left_anti")))


def link_classes(docs: DataFrame, sets: DataFrame) -> DataFrame:
    """c, component for the classes that link with another. sets: document_sets(docs), materialised."""
    classes = materialize(sets.where("n > 0").groupBy("c").agg(F.min("x").alias("x"), F.max("n").alias("n")))
    postings = classes.agg(F.sum("n")).first()[0] or 0
    reps = classes.select("x", "c")

    def sets_of(*pairs: DataFrame) -> DataFrame:
        names = [p.select(F.col(side).alias("c")) for p in pairs for side in p.columns]
        names = materialize(functools.reduce(DataFrame.union, names).distinct())
        names = F.broadcast(names) if names.count() <= 10 * BROADCAST_ROWS else names
        return materialize(whole_sets(docs, reps.join(names, "c", "left_semi")))

    def linked(found: DataFrame, labels: DataFrame | None, sets, whole: bool) -> DataFrame:
        stars = _stars(found, whole)
        labels = joined(labels, verified(stars, sets or sets_of(stars)))
        pairs = _candidates(found, labels, whole)
        return joined(labels, verified(pairs, sets or sets_of(pairs)))

    found = materialize(index_pass(docs, postings // 3, whole=False))
    labels = linked(found, None, None, False)
    again = materialize(_unsettled(found, labels, False))
    if again.limit(1).count():
        rest = sets_of(again)
        found = materialize(index_pass(rest, rest.agg(F.sum("n")).first()[0] or 0, whole=True))
        labels = linked(found, labels, rest, True)
        last = materialize(_unsettled(found, labels, True))
        if last.limit(1).count():
            named = last.join(labels, "c", "left").select("c", F.coalesce("component", "c").alias("component"))
            labels = joined(labels, direct_search(rest.join(named, "c")))
    return labels


def join_documents(docs: DataFrame) -> DataFrame:
    """doc_id, n_shingles, component_id, x (the key of its text) for each row of ``docs`` (doc_id, text)."""
    sets = materialize(document_sets(docs))
    labels = link_classes(docs, sets)
    classes = sets.where("n > 0").groupBy("c").agg(F.min("doc_id").alias("rep"))
    named = classes.join(labels, "c", "left").select("c", "rep", F.coalesce("component", "c").alias("component"))
    named = materialize(named)
    least = named.groupBy("component").agg(F.min("rep").alias("component_id"))
    named = materialize(named.join(least, "component").select("c", "component", "component_id"))
    shown = sets.where("n > 0").join(named, "c").select("doc_id", F.col("n").alias("n_shingles"), "component_id", "x", F.col("component").alias("group"))
    empty = sets.where("n = 0").select("doc_id", F.col("n").alias("n_shingles"), F.col("doc_id").alias("component_id"), "x", F.lit(None).cast("long").alias("group"))
    return shown.unionByName(empty)


def drop_copies(docs: DataFrame) -> DataFrame:
    """The rows of ``docs`` but for those whose component has another row before them, by doc_id (null last), then by the text's key.

    Of rows with one doc_id and one text the first by all their columns as text stays. Rows with an empty set all stay.
    """
    found = materialize(join_documents(docs).where("group is not null").select("group", "doc_id", "x"))
    place = F.struct(F.col("doc_id").isNull().alias("last"), F.coalesce("doc_id", F.lit(0).cast("long")).alias("id"), F.col("x"))
    sizes = found.groupBy("group").agg(F.min(place).alias("first"), F.count(F.lit(1)).alias("m")).where("m > 1")
    sizes = materialize(sizes)
    placed = found.select("group", place.alias("place")).groupBy("group", "place").agg(F.count(F.lit(1)).alias("rows")).join(sizes, "group")
    copies = placed.where("place <> first or rows > 1").select(
        F.col("place.last").alias("_last"), F.col("place.id").alias("_id"), F.col("place.x").alias("_x"), (F.col("place") == F.col("first")).alias("_first")
    )
    copies, number = counted(copies)
    copies = F.broadcast(copies) if number <= 10 * BROADCAST_ROWS else copies  # short rows
    row = F.struct(*[docs[c] for c in docs.columns]).alias("_row")
    keyed = docs.select(row, docs["doc_id"].isNull().alias("_last"), F.coalesce(docs["doc_id"].cast("long"), F.lit(0).cast("long")).alias("_id"), F.xxhash64(docs["text"]).alias("_x"))
    keyed = keyed.join(copies, ["_last", "_id", "_x"], "left")
    alone = keyed.where("_first is null").select("_row")
    repeated = keyed.where("_first").groupBy("_last", "_id", "_x").agg(F.min_by("_row", F.to_json("_row")).alias("_row")).select("_row")
    return alone.unionByName(repeated).select(*[F.col("_row").getField(c).alias(c) for c in docs.columns])


def op8_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return join_documents(read(spark, sf_dir, "documents")).select("doc_id", "n_shingles", "component_id")


ORACLE = r"""
with recursive w as (
  select doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[^\x20\x09-\x0D]+') as ws
  from documents),
sh as (
  select distinct doc_id, unnest(case when len(ws) >= 5
    then list_transform(range(1, len(ws) - 3), lambda i: array_to_string(ws[i:i + 4], ' '))
    when len(ws) > 0 then [array_to_string(ws, ' ')] else []::varchar[] end) as s
  from w),
n as (select doc_id, count(*) as n from sh group by doc_id),
common as (select a.doc_id as a, b.doc_id as b, count(*) as k from sh a join sh b on a.s = b.s and a.doc_id <> b.doc_id group by all),
links as (
  select c.a, c.b from common c join n x on x.doc_id = c.a join n y on y.doc_id = c.b where 100 * c.k >= 75 * (x.n + y.n - c.k)),
reach(id, other) as (
  select doc_id, doc_id from w union select r.id, l.b from reach r join links l on l.a = r.other)
select w.doc_id, coalesce(n.n, 0)::bigint as n_shingles, m.component_id
from w left join n using (doc_id) join (select id, min(other) as component_id from reach group by id) m on m.id = w.doc_id
"""
