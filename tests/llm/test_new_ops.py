"""Search, manifest and fingerprints against plain re-computations on awkward rows."""

import hashlib
import math
import re
import struct
import zlib
from collections import Counter

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from kinfold.llm import fingerprint, merkle, search
from kinfold.llm.common import numbered

LONG = " ".join(f"wörd{i % 4000} Filler{i % 7}" for i in range(90_000))  # over one chunk
ROWS = [
    (1, "The quick brown fox jumps over the lazy dog, again and again", "en", "a", 60),
    (2, "the QUICK brown fox jumped over a lazy dog", "en", "a", None),
    (3, None, "en", None, 0),
    (4, "", None, "b", 0),
    (5, " \t\n ", None, "b", 4),
    (6, "fox", "de", "b", 3),
    (7, "repeated row of text", "fr", "c", 20),
    (7, "repeated row of text", "fr", "c", 20),
    (7, "another text under this id", "fr", "c", 26),
    (None, "no id at all, fox and dog", "fr", "c", 25),
    (9, LONG, "de", "a", len(LONG)),
    (10, "ÉTÉ été ünïcode 😀 fox_dog 12 fox-fox", "é", "a", 30),
    *[(i, f"templated page {i} about the fox" + " dog" * (i % 5), "en" if i % 3 else "nl", "hot", i) for i in range(20, 120)],
]
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
ITEMS = [(1, "quick fox and lazy dog dog"), (2, None), (3, " "), (4, "nowhere"), (5, "FOX"), (5, "FOX"), (5, "the templated été"),
         (None, "wörd17 filler3 again"), (6, "the page about fox " * 30)]


@pytest.fixture(scope="module")
def docs(spark):
    rows = spark.createDataFrame(ROWS, SCHEMA)
    return rows.select("*", F.lit(1).alias("row_"), F.lit("x").alias("pos"), F.lit(2).alias("term"), F.lit(0).alias("tree"))


@pytest.fixture(scope="module")
def empty(docs):
    return docs.limit(0)


def words(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda c: c[0].lower(), text or ""))


def ranked(rows, items, k):
    held = [(i, Counter(words(t)), len(words(t))) for i, t, *_ in rows if words(t)]
    n, length = len(held), sum(x for _, _, x in held)
    out = []
    for item, text in dict.fromkeys(items):
        scores = []
        for doc, tf, size in held:
            m = 75 + 25 * size * n // length
            s = 0
            for t, q in Counter(words(text)).items():
                df = sum(t in c for _, c, _ in held)
                if tf[t]:
                    s += q * math.floor(1000 * math.log((2 * n + 2) / (2 * df + 1))) * (1000000000 * tf[t] // (1000 * tf[t] + 12 * m))
            if s:
                scores.append((-s, doc is not None, doc or 0, doc))
        out += [(item, r, d, -s) for r, (s, _, _, d) in enumerate(sorted(scores)[:k], 1)]
    return sorted(out, key=str)


@pytest.mark.parametrize("postings,stretch,terms", [(3_000_000, 2048, 200_000), (40, 4, 5), (1500, 16, 200_000)])
def test_search(spark, docs, postings, stretch, terms, monkeypatch):
    monkeypatch.setattr(search, "QUERY_TERMS", terms)
    items = spark.createDataFrame(ITEMS, "item_id long, text string").withColumn("item", F.lit(0)).withColumn("score", F.lit(0))
    found = search.search(docs, items, 20, postings, stretch)
    assert found.columns == ["item_id", "rank", "doc_id", "score"]
    assert sorted(map(tuple, found.collect()), key=str) == ranked(ROWS, ITEMS, 20)


def test_search_without_rows(spark, docs, empty):
    items = spark.createDataFrame(ITEMS, "item_id long, text string")
    assert search.search(empty, items).count() == 0 and search.search(docs, items.limit(0)).count() == 0


def test_max_score_against_all_scores():
    """Many shards of random lists, small stretches and blocks that stay packed."""
    rng = np.random.default_rng(3)
    n, opened, blocks = 5000, 0, 0
    ids, m = rng.permutation(n).astype(np.int64), rng.integers(80, 400, n)
    lists, total = [], np.zeros(n, np.int64)
    for share, weight in ((0.9, 3), (0.5, 40), (0.3, 60), (0.02, 4000), (0.004, 7000), (0.7, 5)):
        doc = np.flatnonzero(rng.random(n) < share)
        tf = rng.integers(1, 300, len(doc))
        rows = [r for b in search._shard(0, 0, ids, m, doc, np.full(len(doc), 5, np.uint64), tf) for r in b.to_pylist()]
        lists.append((weight, search.Postings(rows[1]["n"], rows[1]["top"], rows[1]["head"], rows[1]["data"], m)))
        total[doc] += weight * search.weightless(tf, m[doc])
    best = search.Best(20)
    search.max_score(lists, ids, best, stretch=100)
    order = np.lexsort((ids, -total))[:20]
    assert best.doc.tolist() == ids[order].tolist() and best.score.tolist() == total[order].tolist()
    for _, p in lists:
        opened, blocks = opened + int(p.open.sum()), blocks + len(p.open)
    assert opened < blocks  # some were rejected by their maxima
    for _, p in lists:  # and all unpack to what was packed
        p.need(0, len(p.open))
        assert (np.diff(p.doc) > 0).all() and (np.maximum.reduceat(p.score, np.arange(0, p.n, 128)) == p.most).all()


def test_packed_numbers():
    v = np.array([0, 1, 127, 128, 16383, 16384, 2**21, 2**28, 2**31 - 1] * 3)
    data, at = search.pack(v)
    assert search.unpack(data).tolist() == v.tolist() and at[-1] == len(data)


def H(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def manifest(rows):
    def leaf(doc_id, text, lang, source, n_chars):
        return H(*["-" if x is None else f"{len(str(x).encode())}:{x}" for x in (doc_id, source, lang, n_chars, text)])

    def grow(nodes):
        """Levels of hashes, bottom first."""
        levels = [nodes]
        while len(levels[-1]) > 1:
            levels.append([H(*levels[-1][i:i + 8]) for i in range(0, len(levels[-1]), 8)])
        return levels

    langs = sorted({r[2] for r in rows}, key=lambda x: (x is not None, (x or "").encode()))
    leaves = {x: sorted(((r, leaf(*r)) for r in rows if r[2] == x), key=lambda p: (p[0][0] is not None, p[0][0] or 0, p[1])) for x in langs}
    trees = {x: grow([h for _, h in leaves[x]]) for x in langs}
    top = grow([trees[x][-1][0] for x in langs])
    out = []
    for g, x in enumerate(langs):
        for i, (r, h) in enumerate(leaves[x]):
            acc = h
            if r[0] is not None and zlib.crc32(str(r[0]).encode()) % 3 == 0 and r[1] is not None:
                acc = leaf(r[0], re.sub("[A-Z]", lambda c: c[0].lower(), r[1]), *r[2:])
            siblings = []
            for levels, at in ((trees[x], i), (top, g)):
                for level in levels[:-1]:
                    run, k = level[at // 8 * 8:at // 8 * 8 + 8], at % 8
                    siblings += run[:k] + run[k + 1:]
                    acc = H(*run[:k], acc, *run[k + 1:])
                    at //= 8
            out.append((r[0], h, trees[x][-1][0], top[-1][0], H(*siblings), len(siblings), acc, acc == top[-1][0]))
    return sorted(out, key=str)


def test_manifest(spark, docs):
    got = merkle.report(docs)
    assert sorted(map(tuple, got.collect()), key=str) == manifest(ROWS)
    one = spark.createDataFrame([(1, "A", None, None, None)], SCHEMA)
    assert [tuple(r) for r in merkle.report(one).collect()] == manifest([(1, "A", None, None, None)])
    assert merkle.report(docs.limit(0)).count() == 0


def test_manifest_of_many_trees(spark, monkeypatch):
    """Subroots of several levels, and ancestors that come in several copies."""
    monkeypatch.setattr(merkle, "SPREAD", 3)
    rows = [(i, f"Text {i}", f"l{i * i % 71}" if i % 4 else "hot", "s", i) for i in range(700)]
    got = merkle.report(spark.createDataFrame(rows, SCHEMA)).collect()
    assert sorted(map(tuple, got), key=str) == manifest(rows)
    assert {r.verified for r in got} == {True, False}


def test_numbered_cuts_equal_rows(spark):
    rows = spark.range(1000).selectExpr("if(id < 700, 'hot', string(id % 5)) as g", "if(id < 600, 1, id) as k").repartition(7)
    got = sorted(map(tuple, numbered(rows, ["g"], ["k"]).select("g", "k", "group_no", "group_n", "pos").collect()))
    want, names = [], sorted({r[0] for r in got})
    for no, g in enumerate(names):
        own = sorted(r.k for r in rows.where(F.col("g") == g).collect())
        want += [(g, k, no, len(own), i) for i, k in enumerate(own)]
    assert got == sorted(want)


def signed(n):
    return n - (1 << 64) if n >= 1 << 63 else n


def chained(hashes):
    h = 42
    for x in hashes:
        h = xxhash.xxh64_intdigest(struct.pack("<q", x), seed=h)
    return signed(h)


def shingles(text):
    w = [signed(xxhash.xxh64_intdigest(x.encode(), seed=42)) for x in re.split(r"[\x20\x09-\x0D]+", text.lower()) if x]
    return {chained(w[i:i + 5]) for i in range(len(w) - 4)} if len(w) > 4 else {chained(w)} if w else set()


@pytest.mark.parametrize("k", [256, 16])
def test_fingerprints(spark, docs, k, monkeypatch):
    monkeypatch.setattr(fingerprint, "BLOCK", 8)
    tie = {r.text: r.tie for r in docs.select("text", F.xxhash64(F.coalesce("text", F.lit(""))).alias("tie")).collect()}
    order = sorted(ROWS, key=lambda r: (r[0] is not None, r[0] or 0, tie[r[1]]))
    want = []
    bottom = lambda s: sorted(s)[:k]
    show = lambda s: "".join(f"{h & (1 << 64) - 1:016X}" for h in s)
    for i, r in enumerate(order):
        text, after = r[1] or "", order[(i + 1) % len(order)][1] or ""
        half = len(text) // 2
        edited = text[:len(text) - half] + after[:half]
        a, b, c = (bottom(shingles(t)) for t in (text, edited, after))
        near = []
        for other in (b, c):
            u = bottom(set(a) | set(other))
            near.append(len(set(a) & set(other) & set(u)) / len(u) if u else 1.0)
        want.append((r[0], len(text), hashlib.sha256(edited.encode()).hexdigest(), show(a), show(b), *near))
    got = [tuple(r)[:7] for r in fingerprint.report(docs, k).collect()]
    assert sorted(got, key=str) == sorted(want, key=str)
    assert fingerprint.report(docs.limit(0)).count() == 0


def test_sketch_estimates(spark, sf_dir):
    text = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "lang", "text")
    held = text.withColumn("sketch", fingerprint.sketch(F.col("text")))
    for keys in (["lang"], []):
        whole = fingerprint.merge_groups(held, keys).collect()
        for r in whole:
            own = set().union(*(shingles(t.text or "") for t in text.collect() if not keys or t.lang == r.lang))
            assert r.sketch == sorted(own)[:256]
    n = fingerprint.merge_groups(held, []).select(fingerprint.distinct_count(F.col("sketch"))).first()[0]
    assert abs(n / len(own) - 1) < 0.2
    x = [f"w{i}" for i in range(3000)]
    two = spark.createDataFrame([(" ".join(x), " ".join(x[:2000]))], "a string, b string").select(
        *[fingerprint.sketch(F.col(c)).alias(c) for c in "ab"])
    near = fingerprint.resemblance(F.col("a"), F.col("b"))
    r = two.select(near.alias("near"), fingerprint.containment(F.col("b"), F.col("a"), near).alias("whole"),
                   fingerprint.containment(F.col("a"), F.col("b"), near).alias("part"), F.size(fingerprint.merged(F.col("a"), F.col("b"))).alias("n")).first()
    assert abs(r.near - 2 / 3) < 0.1 and r.whole > 0.85 and abs(r.part - 2 / 3) < 0.1 and r.n == 256


def test_stages_without_rows(spark, empty, sf_dir):
    """Empty documents, benchmark and conversations go through the stages and queries that had no such test."""
    from kinfold.llm import chat, decontaminate
    import corpus_pipeline

    items = spark.createDataFrame([], "item_id long, text string")
    some = spark.createDataFrame([(1, "a few words of a text")], "doc_id long, text string")
    r = decontaminate.report(some, items).first()
    assert (r.n_hit, r.n_items, r.contaminated) == (0, 0, False)
    talks = spark.createDataFrame([], "conv_id long, turn long, role string, text string")
    assert chat.chat_report(talks).count() == 0
    docs = empty.select("doc_id", "text", "lang", "source", "n_chars")
    for _, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, sf_dir)
    assert docs.count() == 0
