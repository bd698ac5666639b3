"""The corpus operators on small tables with nulls, ties, repeats, long texts and clashing columns, against brute force."""

import re
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from tickforge.llm import catalog, chat, components, language_id, line_dedup, mixing, ngram_join, packing, sharding, url_filter, vector_dedup, vector_search

DOC = "doc_id long, text string, lang string, source string, n_chars long"


def words(n, seed, vocab=400):
    rng = np.random.default_rng(seed)
    return [f"w{k}" for k in rng.integers(vocab, size=n)]


def documents(spark, texts, **more):
    rows = [(k, t, "en", f"s{k % 3}", None if t is None else len(t)) for k, t in enumerate(texts)]
    return spark.createDataFrame(rows, DOC)


@pytest.mark.parametrize("name", sorted(catalog.ORACLES))
def test_query_equals_sql(name, spark, sf, same_as_sql):
    same_as_sql(catalog.QUERIES[name](spark, sf).toPandas(), catalog.ORACLES[name])


# URL filter ------------------------------------------------------------------------------------------


def test_url_filter_against_brute_force(spark):
    urls = [
        None, "", "no scheme", "http://", "http://Example.COM/en/x?q#f", "https://a.b.example.com/en/", "https://www.example.com/en/1", "ftp://com/",
        "http://xcom/", "http://example.net/es/1", "http://example.net/es", "http://net/fr/", "a://b://c.com/x", "http://example.com?x/en/", "http://example.com#/en/",
        "http://com./en/", "http://.com/", "http://exam\nple.com/en/", "http://example.com/en/" + "y" * 50_000, "http://example.com/en/x?q#f",
    ]
    pages = spark.createDataFrame([(k, u, "clash", 1) for k, u in enumerate(urls + urls[:3])], "page_id long, url string, rule string, verdict int")
    rules = url_filter.RULES + [("example.com", "/en", "allow"), ("example.com", "/en", "block"), (None, "/", "block"), ("b.example.com", None, "block")]
    table = spark.createDataFrame(rules, "host string, path string, verdict string")
    got = url_filter.filter_urls(pages, table).toPandas().sort_values("page_id")
    for url, host, path, rule, verdict in zip(urls + urls[:3], got["host"], got["path"], got["rule"], got["verdict"]):
        m = re.match(r"(?s).*?://([^/?#]*)([^?#]*)", url or "")
        want_host, want_path = ("".join(c.lower() if "A" <= c <= "Z" else c for c in m[1]), m[2]) if m else ("", "")
        assert (host, path) == (want_host, want_path)
        fits = [(len(h + (p or "")), len(h), h + (p or ""), v) for h, p, v in rules if h is not None and (want_host == h or want_host.endswith("." + h)) and want_path.startswith(p or "")]
        assert (rule if isinstance(rule, str) else None, verdict) == (max(fits)[2:] if fits else (None, "allow"))


def test_url_filter_keeps_clashing_columns(spark):
    pages = spark.createDataFrame([(1, "http://a.com/", 7, 8, 9, "x"), (1, "http://a.com/", 7, 8, 9, "x")], "page_id long, url string, _row int, rule_verdict int, _u int, short string")
    table = spark.createDataFrame(url_filter.RULES, "host string, path string, verdict string")
    got = url_filter.filter_urls(pages, table)
    assert [tuple(r) for r in got.collect()] == [(1, "http://a.com/", 7, 8, 9, "x", "a.com", "/", "com/", "allow")] * 2


def test_url_filter_joins_on_the_short_prefix_and_confirms(spark):
    """With 4 bits nearly all expressions meet wrong rules, and none of these may count."""
    urls = [f"http://h{k}.{d}.example.{e}/{p}/{k}" for k in range(40) for d in ("a", "www") for e in ("com", "net") for p in ("en", "es", "x")]
    pages = spark.createDataFrame(list(enumerate(urls)), "page_id long, url string")
    table = spark.createDataFrame(url_filter.RULES + [(f"h{k}.a.example.com", "/x/", "block") for k in range(20)], "host string, path string, verdict string")
    few, all_bits = (sorted(map(tuple, url_filter.filter_urls(pages, table, prefix_bits=n).collect())) for n in (4, 32))
    assert few == all_bits
    plan = url_filter.filter_urls(pages, table)._jdf.queryExecution().executedPlan().toString()
    keys = re.findall(r"Join \[([^\]]*)\]", plan)
    assert any(k.startswith("short#") for k in keys) and not any("asked" in k or "digest" in k for k in keys)


def test_url_filter_empty(spark):
    none = spark.createDataFrame([], "page_id long, url string")
    rules = spark.createDataFrame([], "host string, path string, verdict string")
    assert url_filter.filter_urls(none, rules).count() == 0
    one = spark.createDataFrame([(1, "http://a.com/")], "page_id long, url string")
    assert url_filter.filter_urls(one, rules).first()["verdict"] == "allow"


# Mixing ----------------------------------------------------------------------------------------------


def test_mixing_targets_and_totals(spark):
    rng = np.random.default_rng(1)
    rows = [(k, " ".join(words(int(rng.integers(1, 60)), k)), None if k % 7 == 0 else "abc"[min(2, k % 11)], k) for k in range(900)] + [(900, None, "a", 0), (901, "", "z", 0), (5, "one two", "a", 0), (5, "one two", "a", 0)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string, size long")
    got = mixing.copies(docs).toPandas()
    assert len(got) == len(rows) and got["copies"].between(0, 2).all()
    for _, g in got.groupby("source", dropna=False):
        target = g["target"].iloc[0]
        assert target <= 2 * g["source_size"].iloc[0] + 1e-9
        assert abs((g["copies"] * g["size"]).sum() - target) <= 2 * g["size"].max() + 1
    assert sum(g["target"].iloc[0] for _, g in got.groupby("source", dropna=False)) == pytest.approx(1.5 * got["size"].sum())
    again = mixing.copies(docs.repartition(5)).toPandas()
    key = ["doc_id", "source", "size", "copies"]
    assert sorted(map(str, got[key].values.tolist())) == sorted(map(str, again[key].values.tolist()))
    assert mixing.mix(docs).columns == docs.columns


def test_mix_repeats_each_row_as_often_as_it_is_taken(spark):
    rows = [(1, "one two three", "a", k, 1) for k in range(4)] + [(1, "other text of its own", "a", 9, 1), (None, "x y", None, 5, 2), (None, "x y", None, 6, 2), (7, "long " * 200_000, "b", 7, 3)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string, _copies long, size long")
    got = mixing.mix(docs)
    assert got.columns == docs.columns
    taken = mixing.copies(docs).groupBy("doc_id", "source", "x").agg(F.sum("copies").alias("n")).collect()
    assert got.count() == sum(r["n"] for r in taken)
    assert got.groupBy(*docs.columns).count().agg(F.max("count")).first()[0] <= 2


def test_mixing_empty(spark):
    assert mixing.copies(documents(spark, [])).count() == 0
    assert mixing.copies(documents(spark, [None, ""])).agg(F.sum("copies")).first()[0] == 0


# Sharding --------------------------------------------------------------------------------------------


def brute_capacity(sizes, shards):
    low, high = max(sizes), sum(sizes)

    def need(c):
        n, room = 1, c
        for s in sizes:
            if s > room:
                n, room = n + 1, c
            room -= s
        return n

    while low < high:
        middle = (low + high) // 2
        low, high = (low, middle) if need(middle) <= shards else (middle + 1, high)
    return low


@pytest.mark.parametrize("hot", [0, 1, 400])
@pytest.mark.parametrize("shards", [1, 3, 24])
def test_sharding_is_minimax(spark, hot, shards):
    rng = np.random.default_rng(hot)
    texts = ["x" * int(rng.integers(0, 3000)) + str(k) for k in range(700)] + ["same text " * 20] * hot + [None, None, "é" * 10]
    got = sharding.shard(documents(spark, texts), shards).toPandas()
    raw = [None if t is None else t.encode() for t in texts]
    got = got.sort_values("doc_id").reset_index(drop=True)
    assert got["size"].tolist() == [8 + len(r or b"") for r in raw]
    assert [None if np.isnan(c) else int(c) for c in got["text_crc32"].astype(float)] == [None if r is None else zlib.crc32(r) for r in raw]
    assert all(sorted(g["slot"]) == list(range(len(g))) for _, g in got.groupby("shard"))
    assert got.assign(t=[str(t) for t in texts]).groupby("t")["shard"].nunique().max() == 1
    order = documents(spark, texts).groupBy(F.xxhash64("text").alias("g")).agg(F.sum(F.coalesce(F.octet_length("text"), F.lit(0)) + 8).alias("s")).orderBy("g").toPandas()
    assert got.groupby("shard")["size"].sum().max() == brute_capacity(order["s"].tolist(), shards)


def test_sharding_splits_cells_until_exact(spark, monkeypatch):
    monkeypatch.setattr(sharding, "FIRST_BITS", 2)
    monkeypatch.setattr(sharding, "MORE_BITS", 2)
    test_sharding_is_minimax(spark, 400, 3)


def test_sharding_empty(spark):
    assert sharding.shard(documents(spark, [])).count() == 0


# Packing ---------------------------------------------------------------------------------------------


def test_packing_ids_and_places(spark):
    from tokenizers import Tokenizer

    path = packing.tokenizer_path()
    texts = ["", None, "hello world", "a <|endoftext|> b", "é" * 3000, " ".join(words(900, 1)), "x", *[" ".join(words(n, n)) for n in range(1, 150)], "  \n\n tab\t"]
    whole = Tokenizer.from_file(path)
    got = packing.pack(packing.cut(documents(spark, texts), path).cache()).toPandas()
    for doc, g in got.groupby("doc_id"):
        raw = np.array([*whole.encode(texts[doc] or "", add_special_tokens=False).ids, 2], "<u4")
        g = g.sort_values("piece")
        assert g["piece"].tolist() == list(range(len(g))) and g["length"].sum() == len(raw) and (g["length"].iloc[1:] == 1024).all()
        assert g["start"].tolist() == [0, *g["length"].cumsum().tolist()[:-1]]
        assert g["ids_crc32"].tolist() == [zlib.crc32(raw[s:s + n].tobytes()) for s, n in zip(g["start"], g["length"])]
    assert got["doc_id"].nunique() == len(texts)
    g = got.sort_values(["sequence_id", "offset"])
    assert (g.groupby("sequence_id")["length"].cumsum() - g["length"] == g["offset"]).all()
    assert g.groupby("sequence_id")["length"].sum().max() <= 1024


@pytest.mark.parametrize("seed", range(4))
def test_packing_plan_covers_and_is_tight(seed):
    rng = np.random.default_rng(seed)
    lengths = rng.integers(1, 1025, 5000) if seed else np.full(999, 400)
    hist = Counter(lengths.tolist())
    plan = packing.plan(hist)
    used = Counter()
    for config, n in plan.items():
        assert sum(length * c for length, c in config) <= 1024
        for length, c in config:
            used[length] += c * n
    assert used == hist
    low = -(-int(lengths.sum()) // 1024) if seed else 500
    assert sum(plan.values()) <= min(1.02 * low + 2, sum(packing._best_fit(hist, 1024).values()) + 2)


def test_packing_empty(spark):
    assert packing.pack(packing.cut(documents(spark, []), packing.tokenizer_path())).count() == 0


# Language ID -----------------------------------------------------------------------------------------


def test_language_codes_are_exact(spark):
    texts = {"en": "the cat sat on the mat and the dog", "de": "die katze saß auf der matte und der hund", "xx": "é\x00ß€"}
    rows = [(k, texts[lang] * (1 + k % 3), lang) for k, lang in enumerate(["en", "de", "xx"] * 20)] + [(99, "only null lang", None), (100, None, "en")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    counts = {}
    for lang, gram, n in language_id.sample_counts(docs).collect():
        counts.setdefault(lang, {})[gram] = n
    model = language_id.Model(counts)
    tree = {lang: {} for lang in counts}
    for lang, grams in counts.items():
        for gram, n in grams.items():
            b = gram.to_bytes(4, "big")
            for k in range(4):
                c = tree[lang].setdefault(b[3 - k:3], Counter())
                c[b[3]] += n

    def cost(lang, text):
        b, total = language_id.PAD + text, 0.0
        for i in range(3, len(b)):
            excluded, p = set(), 1.0
            for k in (3, 2, 1, 0):
                c = {s: n for s, n in tree[lang].get(b[i - k:i], {}).items() if s not in excluded}
                n, d = sum(c.values()), len(c)
                if not n:
                    continue
                if b[i] in c:
                    p *= c[b[i]] / (n + d)
                    break
                p, excluded = p * d / (n + d), excluded | set(c)
            else:
                p /= max(1, 256 - len(excluded))
            total -= np.log2(p)
        return total

    probe = [b"the hund", "ß€ katze é".encode(), b"zzz", b"\xf0\x9f\x98\x80 q", b"the cat " * 10]
    got = model.code_lengths(probe)
    assert np.allclose(got, [[cost(lang, t) for lang in model.langs] for t in probe], rtol=1e-5)
    # A text longer than a block costs what a byte by byte sum gives: halves share the block's border context.
    long = b"the cat sat \n" * 100_000
    whole = model.code_lengths([long])[0]
    period = model.code_lengths([long[:130], long[:117]])
    assert np.allclose(whole, period[1] + (period[0] - period[1]) * (len(long) // 13 - 9), rtol=1e-6)


def test_language_query_is_accurate(spark, sf):
    got = language_id.op5_language_id(spark, sf).toPandas().set_index("doc_id")
    docs = spark.read.parquet(f"{sf}/documents.parquet").toPandas().set_index("doc_id")
    assert set(got.index) == set(docs.index) and got["score"].between(0, 1).all()
    assert (got["held_out"] == [zlib.crc32(str(k).encode()) % 5 == 0 for k in got.index]).all()
    held = got[got["held_out"]].join(docs["lang"]).dropna(subset=["lang"])
    assert (held["lang"] == held["lang_pred"]).mean() > 0.95


def test_language_edges(spark):
    docs = spark.createDataFrame([(1, None, "en"), (2, "", "en"), (3, "12 34 !?", None), (4, "abc", None), (None, "abc", "en"), (4, "abc", None)], "doc_id long, text string, lang string")
    got = language_id.identify(docs, language_id.train(docs)).toPandas()
    assert len(got) == 6
    none = language_id.identify(docs, None).toPandas()
    assert set(none["lang_pred"]) == {"und"} and (none["score"] == 0).all()
    assert language_id.keep_identified(docs, None).columns == docs.columns


# Line dedup ------------------------------------------------------------------------------------------


def levenshtein(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        row, left = [i, *row[1:]], row
        for j, y in enumerate(b, 1):
            row[j] = min(left[j] + 1, row[j - 1] + 1, left[j - 1] + (x != y))
    return row[-1]


def edited(line, k, rng):
    c = list(line)
    for _ in range(k):
        at, how = int(rng.integers(len(c))), rng.integers(3)
        if how == 0:
            c[at] = "é"
        elif how == 1 and len(c) > 21:
            del c[at]
        else:
            c.insert(at, "ß")
    return "".join(c)


def brute_lines(texts, most=4, scale=5):
    seen, out = [], []
    for text in texts:
        keep = []
        for x in (text or "").split("\n"):
            near = any(x == y or abs(len(x) - len(y)) <= (m := min(most, len(x) // scale, len(y) // scale)) and levenshtein(x, y) <= m for y in seen)
            if not x.strip() or not near:
                keep.append(x)
            if x.strip():
                seen.append(x)
        out.append(None if text is None else "\n".join(keep))
    return out


@pytest.mark.parametrize("most,scale,hot", [(4, 5, 1), (4, 5, 16), (4, 5, 0), (1, 20, 2), (2, 10, 1), (3, 3, 3)])
def test_line_dedup_against_brute_force(spark, most, scale, hot, monkeypatch):
    monkeypatch.setattr(line_dedup, "HOT", hot)
    rng = np.random.default_rng(hot + most)
    base = [" ".join(words(int(rng.integers(4, 40)), k)) for k in range(12)] + ["Les.", "And ornd.", "Erheed. Tit", "Erheed. Titionly", "a line of 20 letters", "a rather longer line of 40 letters, here"]
    base += [" ".join(words(20, 77) + words(6, 200 + k)) for k in range(8)]  # a common beginning
    base += [" ".join(words(6, 300 + k) + words(30, 78) + words(3, 400 + k)) for k in range(8)]  # a common middle
    texts = [None, "", "  \n\n  ", "Les.\nLes.", "Les."]
    for _ in range(70):
        texts.append("\n".join(edited(base[int(rng.integers(len(base)))], int(rng.integers(0, 7)) if rng.integers(3) else 0, rng) for _ in range(int(rng.integers(1, 4)))))
    got = line_dedup.dedup_lines(documents(spark, texts), most, scale).toPandas().sort_values("doc_id")
    assert got["text"].tolist() == brute_lines(texts, most, scale)
    assert list(got.columns) == ["doc_id", "text", "lang", "source", "n_chars", "_lines", "_dropped"]


@pytest.mark.parametrize("t", range(5))
def test_listed_substrings_meet(t):
    """Any two strings within t edits list a common substring, whatever the class border."""
    def listed(s, t):
        out = set()
        for n in {len(s), max(0, len(s) - t)}:
            w = n // (t + 1)
            w -= w % (1 << max(0, w.bit_length() - 3))
            w = n if t == 0 else w if w > t // 2 else 0
            if not w:
                out.add((0, 2, 0, ""))
                continue
            for side, i, m in line_dedup.zones(t):
                size = w - i
                start = len(s) - i * w - m - size if side else i * w + m
                out.add((w, side, i, s[start:start + size]))
        return out

    rng = np.random.default_rng(t)
    for _ in range(3000):
        a = "".join(rng.choice(list("abc"), int(rng.integers(5 * t, 5 * t + 60))))
        b = list(a)
        for _ in range(t):
            at, how = int(rng.integers(len(b) + 1)), rng.integers(3)
            if how == 0 and at < len(b):
                b[at] = "x"
            elif how == 1 and at < len(b):
                del b[at]
            else:
                b.insert(at, "y")
        assert listed(a, t) & listed("".join(b), t), (a, b)


def test_line_dedup_edges(spark):
    lines = ["the first line of a text that is long enough", "a second line, quite different from the first one"]
    rows = [(1, lines[0], 1, 2), (1, lines[1] + "\n" + lines[0], 1, 3), (None, lines[1], 5, 6), (3, "x" * 300_000 + "\n" + lines[0] + "!", 7, 8), (4, "x" * 299_998 + "yy", 9, 9)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, _d long, _lines long")
    got = {(r["doc_id"], r["_d"]): r for r in line_dedup.dedup_lines(docs).collect()}
    assert len(got) == 4 or len(got) == 5
    assert got[None, 5]["text"] == lines[1] and got[3, 7]["text"] == "x" * 300_000 and got[4, 9]["text"] == ""
    kept = [r["text"] for r in line_dedup.dedup_lines(docs).where("doc_id = 1").collect()]
    assert sorted(kept) in (["", lines[0]], ["", lines[0]][::-1]) and got[3, 7]["_lines"] == 2 and got[3, 7]["_dropped"] == 1


@pytest.mark.parametrize("long", [0, 40])
def test_line_dedup_of_long_lines_along_the_band(spark, long, monkeypatch):
    monkeypatch.setattr(line_dedup, "LONG", long)
    rng = np.random.default_rng(long)
    base = [" ".join(words(int(rng.integers(2, 30)), k)) for k in range(6)]
    texts = [edited(base[int(rng.integers(len(base)))], int(rng.integers(0, 7)), rng) for _ in range(60)]
    got = line_dedup.dedup_lines(documents(spark, texts)).toPandas().sort_values("doc_id")
    assert got["text"].tolist() == brute_lines(texts)


def test_line_dedup_makes_no_rows_of_far_copies(spark, monkeypatch):
    """Copies of one line that are more than four edits apart meet on many keys, but are no pairs to be looked up."""
    rng = np.random.default_rng(6)
    base, copies = " ".join(words(24, 5)), []
    for _ in range(30):
        c = list(base)
        for at in rng.choice(len(c) // 2 - 1, 4, replace=False):  # swaps leave all tallies as they are
            c[2 * at], c[2 * at + 1] = c[2 * at + 1], c[2 * at]
        copies.append("".join(c))
    handed, near = [], line_dedup.near
    monkeypatch.setattr(line_dedup, "HOT", 4)
    monkeypatch.setattr(line_dedup, "near", lambda found, *rest: handed.append(found.count()) or near(found, *rest))
    got = line_dedup.dedup_lines(documents(spark, copies)).toPandas().sort_values("doc_id")
    assert got["text"].tolist() == brute_lines(copies)
    assert sum(handed) < 200, handed  # of 435 pairs


def test_line_dedup_keeps_many_lines_and_repeated_rows(spark):
    text = "\n".join(f"line number {k} of a long document {k * k}" for k in range(0, 3000, 37))
    docs = documents(spark, [text, text]).unionByName(documents(spark, [text]))
    got = line_dedup.dedup_lines(docs).toPandas().sort_values("doc_id")
    assert got["text"].tolist()[0] == got["text"].tolist()[1] and got["text"].tolist()[2] == ""
    assert line_dedup.dedup_lines(documents(spark, [])).count() == 0


# N-gram join -----------------------------------------------------------------------------------------


def shingles(text):
    w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    return frozenset(tuple(w[i:i + 5]) for i in range(len(w) - 4)) if len(w) >= 5 else frozenset([tuple(w)] if w else [])


def brute_components(texts):
    sets, label = [shingles(t) for t in texts], list(range(len(texts)))
    for i, a in enumerate(sets):
        for j in range(i):
            b = sets[j]
            if a and b and 100 * len(a & b) >= 75 * len(a | b):
                x, y = label[i], label[j]
                label = [min(x, y) if v in (x, y) else v for v in label]
    return sets, label


def corpus(seed, short):
    """Near copies around the threshold, big families, shared passages, tiny and empty texts."""
    rng, texts = np.random.default_rng(seed), []
    passage = words(60, 10_000 + seed, 5000)
    for f in range(12):
        base = words(int(rng.integers(20, 160)), 100 * seed + f, 5000)
        for _ in range(int(rng.integers(1, 14))):
            w = list(base)
            for _ in range(int(rng.integers(0, 6))):
                w[int(rng.integers(len(w)))] = f"e{rng.integers(10**6)}"
            texts.append(" ".join(w))
    for k in range(40):
        tail = words(int(rng.integers(2, short)), 9000 + 50 * seed + k, 5000)
        texts.append(" ".join(passage + tail))
    return texts + [None, "", " \t\n", "one", "One", "a b c", "A  b\tc", "a b c d e", "passage", texts[0], texts[0].upper(), " ".join(passage)]


@pytest.mark.parametrize("seed,short", [(1, 12), (2, 40), (3, 200)])
def test_ngram_join_against_brute_force(spark, seed, short):
    texts = corpus(seed, short)
    got = ngram_join.join_documents(documents(spark, texts)).toPandas().sort_values("doc_id")
    sets, label = brute_components(texts)
    assert got["n_shingles"].tolist() == [len(s) for s in sets]
    assert got["component_id"].tolist() == label


def test_ngram_join_with_lists_that_are_all_long(spark, monkeypatch):
    monkeypatch.setattr(ngram_join, "SHORT", 2)
    monkeypatch.setattr(ngram_join, "SEARCH_TOKENS", 800)
    test_ngram_join_against_brute_force(spark, 4, 10)


@pytest.mark.parametrize("seed,short", [(1, 12), (4, 10)])
def test_ngram_join_with_lists_in_pieces(spark, monkeypatch, seed, short):
    monkeypatch.setattr(ngram_join, "SAMPLED", 1)
    monkeypatch.setattr(ngram_join, "HEAVY", 4)
    test_ngram_join_against_brute_force(spark, seed, short)


def test_ngram_join_nulls_repeats_and_long_texts(spark, monkeypatch):
    monkeypatch.setattr(ngram_join, "CHUNK", 1 << 14)
    long = words(30_000, 5, 10**6)  # far over CHUNK
    near = " ".join(long[:-50] + words(50, 6))
    rows = [(None, " ".join(long), 1), (3, near, 1), (3, near, 2), (3, "three other words", 3), (None, "quite alone in here", 4), (5, "Three other WORDS", 5), (6, None, 6), (6, None, 6)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, component_id long")
    got = sorted(((r["doc_id"] or 0, r["n_shingles"], r["component_id"]) for r in ngram_join.join_documents(docs).collect()), key=str)
    n = len(shingles(near))
    assert got == sorted([(0, len(shingles(" ".join(long))), 3), (3, n, 3), (3, n, 3), (3, 1, 3), (0, 1, None), (5, 1, 3), (6, 0, 6), (6, 0, 6)], key=str)
    kept = ngram_join.drop_copies(docs)
    assert kept.columns == docs.columns
    assert sorted(r["component_id"] for r in kept.collect()) == [1, 3, 4, 6, 6]


def test_divide_skip():
    rng = np.random.default_rng(0)
    for _ in range(50):
        lists = [np.unique(rng.integers(30, size=rng.integers(1, 25))) for _ in range(12)]
        need = int(rng.integers(1, 9))
        count = Counter(int(v) for x in lists for v in x)
        for long_lists in (0, 3, 20):
            items, counts = ngram_join.divide_skip(lists, need, long_lists)
            assert sorted(zip(items.tolist(), counts.tolist())) == sorted((k, n) for k, n in count.items() if n >= need)


def test_ngram_join_empty(spark):
    assert ngram_join.join_documents(documents(spark, [])).count() == 0
    assert ngram_join.join_documents(documents(spark, [None, ""])).count() == 2


# Vectors ---------------------------------------------------------------------------------------------


def vectors(spark, n=1500, d=16, seed=0):
    rng = np.random.default_rng(seed)
    x = rng.normal(size=(n, d))
    for k in range(200):
        x[int(rng.integers(n))] = x[int(rng.integers(n))] + rng.normal(size=d) * rng.uniform(0, 0.5)
    x[50:90] = x[50] + rng.normal(size=(40, d)) * 0.1
    x[10] = x[11]
    rows = [(k, v.tolist(), 1) for k, v in enumerate(x)]
    bad = [(n, None, 0), (n + 1, [0.0] * d, 0), (n + 2, [None] + [1.0] * (d - 1), 0), (n + 3, [float("nan")] * d, 0), (n + 4, [float("inf")] + [1.0] * (d - 1), 0), (n + 5, [1.0] + [-1.0] * (d - 2), 0), (n + 6, [], 0)]
    return x, spark.createDataFrame(rows + bad + rows[:3], "vec_id long, embedding array<double>, component_id int")


def test_vector_dedup_against_brute_force(spark, monkeypatch):
    monkeypatch.setattr(vector_dedup, "GROUP", 200)
    monkeypatch.setattr(vector_dedup, "LEAF", 60)
    x, table = vectors(spark)
    got = vector_dedup.dedup_vectors(table).toPandas().sort_values("vec_id")
    u = x / np.linalg.norm(x, axis=1, keepdims=True)
    near = u @ u.T >= 0.9
    np.fill_diagonal(near, False)
    label = np.arange(len(x))
    for i, j in zip(*np.nonzero(near)):
        a, b = sorted((label[i], label[j]))
        label[label == b] = a
    good = got[got["vec_id"] < len(x)]
    assert len(good) == len(x) and (got[got["vec_id"] >= len(x)]["n_links"] == 0).all() and len(got) == len(x) + 7
    assert (good["component_id"].to_numpy() == label).mean() > 0.99
    right = good["component_id"].to_numpy() == label
    assert (good["n_links"].to_numpy()[right] == near.sum(1)[right]).mean() > 0.99
    assert (got["kept"] == (got["vec_id"] == got["component_id"])).all()


def test_vector_search_recall(spark):
    x, table = vectors(spark)
    clean = max(vector_search.by_length(vector_search.usable(table).cache()), key=lambda v: v[1])[0]
    q = clean.where("vec_id % 20 = 0").select(F.col("vec_id").alias("query_id"), "vec")
    got = vector_search.search(vector_search.index(clean, 3), 3, q, q.count(), 20).toPandas()
    hits = 0
    for k, g in got.groupby("query_id"):
        s = x @ x[k]
        s[k] = -np.inf
        best = np.lexsort((np.arange(len(x)), -s))[:20]
        g = g.sort_values("rank")
        assert g["rank"].tolist() == list(range(1, 21)) and np.allclose(g["score"], s[g["vec_id"]])
        assert g["score"].is_monotonic_decreasing
        hits += len(set(best) & set(g["vec_id"]))
    assert hits / (20 * got["query_id"].nunique()) >= 0.9


def test_vectors_of_other_lengths_are_groups_of_their_own(spark):
    rows = [(k, [1.0, float(k), 0.0, 2.0]) for k in range(6)] + [(20, [1.0, 0.0]), (40, [1.0, 0.0]), (60, [0.0, 3.0]), (61, [5.0]), (61, [5.0])]
    table = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = {r["vec_id"]: tuple(r)[1:] for r in vector_dedup.dedup_vectors(table).collect()}
    assert got[20] == (1, 20, True) and got[40] == (1, 20, False) and got[60] == (0, 60, True) and got[61] == (0, 61, True)
    found = sorted(map(tuple, vector_search.nearest(table, 20, 2).collect()))
    assert [f for f in found if f[0] == 20] == [(20, 1, 40, 1.0), (20, 2, 60, 0.0)] and [f for f in found if f[0] == 60] == [(60, 1, 20, 0.0), (60, 2, 40, 0.0)]
    assert len([f for f in found if f[0] == 0]) == 2 and {f[0] for f in found} == {0, 20, 40, 60}


def test_vector_search_query_against_brute_force(spark, sf):
    rows = spark.read.parquet(f"{sf}/embeddings.parquet").select("vec_id", "embedding").collect()
    ids, x = np.array([r[0] for r in rows]), np.array([r[1] for r in rows], float)
    got = vector_search.op2_nearest_neighbours(spark, sf).toPandas()
    hits = total = 0
    for q in ids[ids % 20 == 0]:
        s = x @ x[ids == q][0]
        s[ids == q] = -np.inf
        best = np.lexsort((ids, -s))[:20]
        g = got[got["query_id"] == q].sort_values("rank")
        assert g["rank"].tolist() == list(range(1, len(g) + 1))
        hits, total = hits + len(set(ids[best]) & set(g["vec_id"])), total + min(20, len(ids) - 1)
    assert hits / total >= 0.99


def test_vector_search_with_few_candidates(spark):
    _, table = vectors(spark, 1500)
    few = vector_search.usable(table).where("vec_id < 5").cache()
    q = few.select(F.col("vec_id").alias("query_id"), "vec")
    got = vector_search.search(vector_search.index(few, 2), 2, q, 5, 20).toPandas()
    assert got.groupby("query_id").size().tolist() == [4] * 5
    none = few.where("vec_id < 0")
    assert vector_dedup.dedup_vectors(table.where("vec_id < 0")).count() == 0
    assert vector_search.search(vector_search.index(none, 2), 2, q.where("query_id < 0"), 0, 20).count() == 0


# Chat ------------------------------------------------------------------------------------------------


def test_chat_edges(spark):
    turns = [
        (1, 0, "user", "hi"), (1, 1, "assistant", "yes <|im_end|> é"), (2, 0, "user", "hi"), (2, 1, "assistant", "no"), (2, 2, "user", None),
        (3, 0, None, None), (4, 0, "user", "same"), (5, 0, "user", "same"), (6, None, "system", "x"), (None, 0, "user", "lost"),
    ]
    df = spark.createDataFrame([(*t, "clash") for t in turns], "conv_id long, turn long, role string, text string, prompt string")
    convs = chat.conversations(df)
    pairs = spark.createDataFrame([(1, 2, True), (4, 5, True), (3, None, False), (6, None, True)], "chosen_id long, rejected_id long, paired boolean")
    got = {r["chosen_id"]: r for r in chat.format_preferences(pairs, convs).collect()}
    r = got[1]
    assert r["n_common"] == 1 and r["prompt"] == "<|im_start|>user\nhi<|im_end|>\n"
    assert r["chosen"] == "<|im_start|>assistant\nyes < |im_end|> é<|im_end|>\n"
    s = r["chosen_mask"][0]
    assert r["chosen"][s["begin"]:s["end"]] == "yes < |im_end|> é<|im_end|>"
    assert r["rejected"].endswith("<|im_start|>user\n<|im_end|>\n") and len(r["rejected_mask"]) == 1
    assert got[4]["chosen"] == "" and got[4]["n_common"] == 1 and got[4]["chosen_mask"] == []
    assert got[3]["rejected"] is None and got[3]["prompt"] == "" and got[3]["chosen"] == "<|im_start|>\n<|im_end|>\n"
    assert got[6]["rejected"] == "<|im_start|>user\nlost<|im_end|>\n"
    made = chat.pairs_by_opening(convs).toPandas()
    ids = Counter(made["chosen_id"].fillna(-1).astype(int).tolist() + made[made["paired"]]["rejected_id"].fillna(-1).astype(int).tolist())
    assert ids == Counter([1, 2, 3, 4, 5, 6, -1])
    assert chat.pairs_by_opening(chat.conversations(df.where("conv_id > 100"))).count() == 0


# Components ------------------------------------------------------------------------------------------


@pytest.mark.parametrize("few", [0, 10**6])
def test_components(spark, monkeypatch, few):
    monkeypatch.setattr(components, "FEW", few)
    rng = np.random.default_rng(few % 7)
    links = [(int(a), int(b)) for a, b in rng.integers(300, size=(150, 2))] + [(k, k + 1) for k in range(1000, 1060)] + [(2000, k) for k in range(2001, 2050)] + [(7, 7), (5, 5), (5, 5)]
    label = {}
    for a, b in links:
        if a != b:
            label.setdefault(a, a), label.setdefault(b, b)
    changed = True
    while changed:
        changed = False
        for a, b in links:
            if a != b and label[a] != label[b]:
                label[a] = label[b] = min(label[a], label[b])
                changed = True
    got = components.components(spark.createDataFrame(links, "a long, b long")).collect()
    assert sorted((r["id"], r["component"]) for r in got) == sorted(label.items())
    assert components.components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_divide_skip_reads_short_long_lists_at_once(monkeypatch):
    rng = np.random.default_rng(3)
    lists = [np.unique(rng.integers(0, 300, rng.integers(1, 260))) for _ in range(200)]
    probes, probe = [], np.searchsorted
    monkeypatch.setattr(np, "searchsorted", lambda *a, **b: probes.append(1) or probe(*a, **b))
    for need in (60, 90, 120):
        probes.clear()
        items, counts = ngram_join.divide_skip(lists, need, need - 1)
        times = np.bincount(np.concatenate(lists), minlength=300)
        assert items.tolist() == np.flatnonzero(times >= need).tolist()
        assert counts.tolist() == times[times >= need].tolist()
        assert len(probes) <= 1  # it was one for each of the long lists


def test_workers_give_memory_back(monkeypatch):
    import pyarrow as pa

    from tickforge.llm import _common

    freed = []
    monkeypatch.setattr(pa, "default_memory_pool", lambda: type("Pool", (), {"release_unused": lambda self: freed.append(1)})())
    assert list(_common.lean(lambda batches: (2 * b for b in batches))([1, 2])) == [2, 4]
    assert freed


def test_line_dedup_makes_one_row_of_a_lost_line_of_a_large_list(spark):
    lines = [f"{'a common start of all of these lines, with number '}{k:02d}" for k in range(40)]
    once = spark.createDataFrame([(1000 * k + len(x), k, len(x), x, {"_d": k, "_x": k, "_p": 0}) for k, x in enumerate(lines)], "_h long, _h2 int, _n int, _line string, _first struct<_d:long,_x:long,_p:int>")
    signs = line_dedup.signed(line_dedup.tallied(once))
    rows = once.select(F.explode(F.array(F.lit(1), F.lit(2)).cast("array<long>")).alias("_k"), "_h", F.lit(True).alias("_live"))
    lost, far = line_dedup.alike(rows, signs, 4, 5)
    assert sorted(r["_h2"] for r in lost.collect()) == list(range(1, 40)) and far is None


def test_line_dedup_compares_a_list_or_its_refined_lists_whichever_is_less(spark):
    lists = spark.createDataFrame([(k, h) for k in (1, 2, 3) for h in range(20)], "_k long, _h long")
    below = [(10 + h % 4, h, 1) for h in range(20)] + [(20 + c, h, 2) for h in range(20) for c in range(9)]
    found = line_dedup.finer(lists, spark.createDataFrame(below, "_k long, _h long, _key long"))
    assert sorted(r["_k"] for r in found.collect()) == [1, 3]


def test_line_dedup_screens_pairs_by_tallies_before_it_attaches_texts(spark):
    rng = np.random.default_rng(0)
    rows = []
    for k in range(300):  # pairs within four edits
        a = "".join(rng.choice(list("etaoinshrdlucmfpgwyb0 .é"), int(rng.integers(20, 600))))
        b = list(a)
        for _ in range(4):
            at = int(rng.integers(len(b)))
            b[at:at + int(rng.integers(2))] = rng.choice(list("eta0 é"), int(rng.integers(2)))
        rows.append((k, a, "".join(b)))
    rows.append((300, "e" * 700 + "t" * 300, "t" * 700 + "e" * 300))
    pairs = spark.createDataFrame(rows, "k long, a string, b string")
    side = lambda c: line_dedup.tallied(pairs.select("k", F.col(c).alias("_line"), F.char_length(c).alias("_n"))).toDF("k", *[f"{x}_{c}" for x in ("_line", "_n", *line_dedup.TALLIES)])
    kept = side("a").join(side("b"), "k").where(line_dedup.moved("_a", "_b", 4))
    assert sorted(r["k"] for r in kept.collect()) == list(range(300))


def test_line_dedup_shuffles_each_text_once(spark):
    plan = line_dedup.dedup_lines(documents(spark, ["a line", "a line\nanother", None]))._jdf.queryExecution().optimizedPlan().toString()
    assert "_text" not in plan
