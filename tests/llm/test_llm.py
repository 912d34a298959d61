"""Corpus operators against brute force, round trips and held-out accuracy, with odd inputs."""

import collections
import hashlib
import re
import zlib

import numpy as np
import pyarrow as pa
import pytest
import public_tokenizers
from tokenizers import Tokenizer

import corpus_pipeline
from kinfold.llm.common import stored
from kinfold.llm import (
    bpe, chat, decontaminate, line_dedup, minhash, near_dedup, packing, quality, queries, repeats, rules, token_output,
    tokens,
)

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, key string, __gone long"
BASE = " ".join(f"word{i} other{i * 7 % 13}" for i in range(60))
ROWS = [
    (1, BASE, "en", "a", 1, "x", 1), (2, BASE, None, None, None, None, None), (3, BASE.replace("word5 ", "changed "), "en", "a", 1, "x", 1),
    (4, "", "en", "a", 0, "x", 1), (5, None, "en", "a", None, None, 1), (None, BASE, "en", "a", 1, "x", 1),
    (6, "two words", "en", "a", 9, "x", 1), (7, "TWO\twords", "en", "a", 9, "x", 1), (7, "TWO\twords", "en", "a", 9, "x", 1),
    (8, "\n".join(["same line that is long enough to count here"] * 3 + [BASE[:300]]), "en", "b", 1, "x", 1),
    (9, "é世😀 " * 400 + BASE[100:700] + "<|endoftext|>tail", "fr", "b", 1, "x", 1), (10, "a" * 3000, "en", "b", 3000, "x", 1),
    (11, "### user: </turn> \\ <\\/turn> !!! ***", "en", "b", 1, "x", 1),
]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(ROWS, SCHEMA)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="module")
def labels(spark):
    return spark.createDataFrame([(1, 1), (2, 1), (8, 0), (11, 0), (None, 1), (3, None)], "doc_id long, quality int")


@pytest.fixture(scope="module")
def bench(spark):
    words = BASE.split()
    return spark.createDataFrame([(1, " ".join(words[20:34]).upper()), (2, "two  words"), (None, None), (3, "")], "item_id long, text string")


def lower(t):
    return re.sub("[A-Z]", lambda m: m[0].lower(), t or "")


def groups(rows):
    """Component (a set of row numbers) of every row with a word, by comparing all pairs."""
    sets = []
    for _, text in rows:
        w = re.findall(r"[^\x20\x09-\x0D]+", lower(text))
        sets.append({tuple(w[k:k + 5]) for k in range(max(1, len(w) - 4))} if w else set())
    own = list(range(len(rows)))
    for _ in rows:
        for i, x in enumerate(sets):
            for j, y in enumerate(sets):
                same_id = rows[i][0] is not None and rows[i][0] == rows[j][0]
                if x and y and (same_id or 100 * len(x & y) >= 75 * len(x | y)):
                    own[i] = own[j] = min(own[i], own[j])
    return sets, own


OTHERS = [" ".join(f"{c}{i * i % 97}x{i}" for i in range(40)) for c in "efghij"]
SHARED = [(1, OTHERS[0]), (2, OTHERS[1]), (5, OTHERS[0]), (5, OTHERS[1]), (5, OTHERS[2]), (9, OTHERS[2] + " more"), (7, OTHERS[3]),
          (7, OTHERS[3]), (None, OTHERS[3]), (None, OTHERS[4]), (None, OTHERS[4]), (8, ""), (8, None), (5, " "), (11, OTHERS[5]), (11, OTHERS[5]),
          (12, OTHERS[5]), (12, OTHERS[5]), (13, OTHERS[5] + " end")]


@pytest.mark.parametrize("which", ["rows", "shared ids"])
def test_near_duplicates(spark, docs, which):
    rows = [(r[0], r[1]) for r in ROWS] if which == "rows" else SHARED
    df = docs if which == "rows" else spark.createDataFrame(SHARED, "doc_id long, text string").withColumn("tie", near_dedup.F.lit(1))
    sets, own = groups(rows)
    want, stay = [], collections.Counter()
    for i, (doc_id, text) in enumerate(rows):
        ids = [rows[j][0] for j in range(len(rows)) if own[j] == own[i] and rows[j][0] is not None]
        name = doc_id if not sets[i] else min(ids, default=None)
        want.append((doc_id, len(sets[i]), name, name is None or doc_id == name))
        if not sets[i]:
            stay[doc_id, text] += 1
    got = [tuple(r) for r in near_dedup.near_duplicates(df).collect()]
    assert sorted(got, key=str) == sorted(want, key=str)
    left = near_dedup.drop_near_duplicates(df)
    assert left.columns == df.columns
    kept = collections.Counter((r.doc_id, r.text) for r in left.collect())
    for c in {own[i] for i in range(len(rows)) if sets[i]}:
        members = [i for i in range(len(rows)) if own[i] == c]
        first = min((rows[i][0] for i in members if rows[i][0] is not None), default=None)
        mine = [k for k in kept.elements() if k in {rows[i] for i in members} and k not in stay]
        assert len(mine) == 1 and mine[0][0] == first  # one row of each component, of its least id
    assert all(kept[k] == n for k, n in stay.items())


def test_copies_given_twice(spark):
    rows = [(i, OTHERS[i]) for i in range(3)] * 2
    assert near_dedup.drop_near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).count() == 3


def test_superminhash_estimates_similarity():
    rng = np.random.default_rng(1)
    both, own = rng.integers(1, 2**63, 600).astype(np.uint64), rng.integers(1, 2**63, 400).astype(np.uint64)
    rows = np.repeat([0, 1, 2], [800, 800, 3])
    elements = np.concatenate([both, own[:200], both, own[200:], both[:3]])
    sig = minhash.superminhash(rows, elements, 3, 126)
    assert abs((sig[0] == sig[1]).mean() - 0.6) < 0.15
    again = minhash.superminhash(np.zeros(3, np.int64), both[:3], 1, 126)
    assert (again[0] == sig[2]).all()  # the same whatever shares the batch


def test_second_search_joins_components():
    import pyarrow as pa

    sets = [list(range(100)), list(range(10, 105)), list(range(60, 200))]
    load = [minhash.pack_set(np.array([v << 24 for v in s], np.uint64)) for s in sets]
    batch = pa.RecordBatch.from_arrays(
        [pa.array([1, 1, 1]), *[pa.array([0, 0, 0], pa.int32())] * 3, pa.array([7, 8, 9]), pa.array([7, 8, 9]), pa.array(load)],
        names=list("abcdefg"))
    out = [tuple(r.values()) for b in minhash._across(minhash.unpack_sets, 75, iter([batch])) for r in b.to_pylist()]
    assert out == [(7, 8)]


def test_quality(spark, docs, labels, empty):
    got = quality.score_quality(docs, labels).collect()
    assert len(got) == len(ROWS) and all(0 <= r.score <= 1 for r in got)
    for r in got:
        assert r.predicted == int(r.score >= 0.3)
        assert r.held_out == (r.doc_id is not None and zlib.crc32(str(r.doc_id).encode()) % 5 == 0)
    assert quality.score_quality(docs, labels.limit(0)).count() == len(ROWS)


def test_quality_held_out_accuracy(spark, sf_dir):
    sf = sf_dir.replace("sf0.001", "sf0.01")
    got = queries.op2_quality_classifier(spark, sf).where("held_out").join(spark.read.parquet(f"{sf}/labels.parquet"), "doc_id").collect()
    assert len(got) > 40 and sum(r.predicted == r.quality for r in got) / len(got) > 0.95


def test_chain_marginals_match_enumeration():
    rng = np.random.default_rng(2)
    u, pair, rows = rng.normal(size=5), rng.normal(size=(2, 2)), np.array([0, 0, 0, 1, 1])
    got, _ = quality.Chains(rows).marginals(u, pair)
    for lo, hi in ((0, 3), (3, 5)):
        n = hi - lo
        labels = np.array(list(np.ndindex(*[2] * n)))
        w = np.exp([(u[lo:hi] * y).sum() + sum(pair[y[i], y[i + 1]] for i in range(n - 1)) for y in labels])
        assert np.allclose(got[lo:hi], [(w * labels[:, i]).sum() / w.sum() for i in range(n)])


def test_rules(spark, docs):
    got = rules.score_rules(docs).collect()
    assert len(got) == len(ROWS)
    text = {r[0]: r[1] or "" for r in ROWS}
    for r in got:
        words = re.findall(r"[^\x20\x09-\x0D]+", text[r.doc_id])
        count = collections.Counter(tuple(words[i:i + 3]) for i in range(len(words) - 2))
        again = {j for i in range(len(words) - 2) if count[tuple(words[i:i + 3])] > 1 for j in range(i, i + 3)}
        lines = [x for x in text[r.doc_id].split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
        assert (r.n_words, r.word_chars, r.n_repeat_words) == (len(words), sum(map(len, words)), len(again))
        assert (r.n_symbols, r.n_dup_lines) == (len(re.findall(r"[#*$%&|<>]", text[r.doc_id])), len(lines) - len(set(lines)))
        assert not (r.kept and r.base_failed)
    kept = {r.doc_id for r in got if r.kept}
    assert {r.doc_id for r in rules.keep_good(docs).collect()} == kept and rules.keep_good(docs).columns == docs.columns


@pytest.fixture(scope="module")
def tokenizer():
    return Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))


def test_tokens_match_the_library(spark, docs, tokenizer):
    texts = [r[1] for r in ROWS] + ["it's we'll  x", " 's\n\n ''re", "Ᲊa1", "a b \t"]
    want = [tokenizer.encode(t or "", add_special_tokens=False).ids for t in texts]
    v = bpe.vocabulary(tokens.vocabulary_path())
    ids, off = v.encode(texts)
    assert [ids[a:b].tolist() for a, b in zip(off, off[1:])] == want
    assert v.count(texts).tolist() == [len(w) for w in want]
    got = sorted((r.n_bytes, r.n_tokens, r.over_limit) for r in tokens.token_counts(docs).collect())
    assert got == sorted((len((t or "").encode()), len(w), len(w) > 512) for t, w in zip(texts[:len(ROWS)], want))


def test_packing(spark, docs, tokenizer):
    rows = packing.pack(docs, keep_ids=True).collect()
    bins = collections.defaultdict(list)
    for r in rows:
        bins[r.sequence_id].append((r.offset, r.length))
        assert zlib.crc32(r.ids) == r.ids_crc32 and len(r.ids) == 4 * r.length
    for b in bins.values():
        at = 0
        for offset, length in sorted(b):
            assert offset == at
            at += length
        assert at <= 1024
    long = sorted((r.piece, r.start, r.length, r.ids) for r in rows if r.doc_id == 9)
    want = tokenizer.encode(ROWS[10][1], add_special_tokens=False).ids + [2]
    assert np.frombuffer(b"".join(x[3] for x in long), "<u4").tolist() == want
    assert all(x[2] == 1024 for x in long[1:])


def test_best_fit_closes_the_fullest():
    p = packing.BestFit(10, 2)
    assert [p.place(n) for n in (6, 5, 7, 3, 4)] == [(0, 0), (1, 0), (2, 0), (2, 7), (1, 5)]


def test_matrices_round_trip(spark, docs, tokenizer):
    back = collections.defaultdict(list)
    for r in token_output.packed_matrices(docs).collect():
        ids, place = np.frombuffer(r.input_ids, "<u4"), np.frombuffer(r.position_ids, "<u4")
        for k, (a, b) in enumerate(zip(r.cu_seqlens, r.cu_seqlens[1:])):
            back[r.doc_ids[k]].append((r.starts[k], ids[a:b].tolist()))
            assert place[a:b].tolist() == list(range(b - a))
    for i, t in {r[0]: r[1] for r in ROWS if r[0] not in (None, 7)}.items():
        assert sum((x for _, x in sorted(back[i])), []) == tokenizer.encode(t or "", add_special_tokens=False).ids + [50256]


def test_decontamination(spark, docs, bench):
    got = {r.doc_id: r for r in decontaminate.report(docs, bench).collect()}
    assert got[1].contaminated and got[1].n_hit == 14 and got[1].n_items == 1
    assert got[6].n_hit == 2 and got[6].items_sha256 == hashlib.sha256(b"2").hexdigest()
    assert not got[4].contaminated and got[5].n_words == 0
    many = decontaminate.scan(docs.select("doc_id", "text"), bench, block_bytes=20).select("doc_id", "__n_hit").collect()
    assert {r.doc_id: r["__n_hit"] for r in many} == {i: r.n_hit for i, r in got.items()}
    clean = decontaminate.decontaminate(docs, bench, mode="spans")
    assert clean.columns == docs.columns and decontaminate.report(clean, bench).where("contaminated").count() == 0


def test_repeated_items_lie_in_no_block_twice(spark, docs, bench):
    many = bench.unionByName(spark.createDataFrame([(9, "one row again and again")] * 50, bench.schema))
    parts = list(decontaminate.blocks(many, block_bytes=40))
    assert sorted(i for p in parts for i in p.ids if i == "9") == ["9"]
    columns = ["doc_id", "__n_hit"]
    once = decontaminate.scan(docs.select("doc_id", "text"), many.distinct()).select(*columns).collect()
    again = decontaminate.scan(docs.select("doc_id", "text"), many).select(*columns).collect()
    assert sorted(map(str, once)) == sorted(map(str, again))


@pytest.mark.parametrize("hot", [0, 2000])
def test_repeats(spark, docs, hot, monkeypatch):
    monkeypatch.setattr(repeats, "HOT", hot)
    one = docs.where("doc_id is not null").dropDuplicates(["doc_id"])
    got = {r.doc_id: r for r in repeats.remove_repeats(one).collect()}
    seen = set()
    for i, t in sorted((r.doc_id, r.text) for r in one.select("doc_id", "text").collect()):
        raw = (t or "").encode()
        gone = np.zeros(len(raw), bool)
        for s in range(len(raw) - 99):
            if raw[s:s + 100] in seen:
                gone[s:s + 100] = True
            seen.add(raw[s:s + 100])
        kept = bytes(b for b, g in zip(raw, gone) if not g)
        assert (got[i].n_removed, got[i].kept_sha256) == (gone.sum(), hashlib.sha256(kept).hexdigest())
    assert repeats.remove_repeats(docs).count() == len(ROWS)


@pytest.mark.parametrize("hot", [0, 2000])
def test_repeats_of_whole_rows(spark, docs, hot, monkeypatch):
    monkeypatch.setattr(repeats, "HOT", hot)
    own = [" ".join(f"{c}{i * i}" for i in range(80)) for c in "pqrs"]
    more = [(20, own[0]), (20, own[0]), (None, own[1]), (None, own[1]), (None, own[1] + own[0][:150]), (21, own[2] + own[1][50:250]),
            (21, own[2] + own[1][50:250]), (21, own[3]), (22, own[3] + own[3]), (22, own[3] + own[3]), (None, None), (None, None)]
    rows = docs.select("doc_id", "text").unionByName(spark.createDataFrame(more, "doc_id long, text string"))
    order = {(r.doc_id, r.text): (r.doc_id is not None, r.doc_id, r.tie)
             for r in rows.select("doc_id", "text", repeats.F.xxhash64("text").alias("tie")).collect()}
    seen, want = set(), {}
    for key in sorted(order, key=lambda k: (order[k][0], order[k][1] or 0, order[k][2])):
        raw = (key[1] or "").encode()
        gone = np.zeros(len(raw), bool)
        for s in range(len(raw) - 99):
            if raw[s:s + 100] in seen:
                gone[s:s + 100] = True
            seen.add(raw[s:s + 100])
        kept = bytes(b for b, g in zip(raw, gone) if not g)
        want[key] = (key[0], len(raw), int(gone.sum()), hashlib.sha256(kept).hexdigest())
    got = collections.Counter((r.doc_id, r.n_bytes, r.n_removed, r.kept_sha256) for r in repeats.remove_repeats(rows).collect())
    assert got == collections.Counter(want[r.doc_id, r.text] for r in rows.collect())


def test_longest_previous_factor():
    text = np.frombuffer(b"banana-bananas", np.uint8)
    view = np.lib.stride_tricks.sliding_window_view(text, 4)
    want = [max([0, *(next((k for k in range(4) if view[i][k] != view[j][k]), 4) for j in range(i))]) for i in range(len(view))]
    assert repeats.longest_previous(view).tolist() == want


def test_line_dedup(spark, docs):
    one = docs.where("doc_id is not null").dropDuplicates(["doc_id"])
    got = {r.doc_id: r for r in line_dedup.line_report(one).collect()}
    assert got[8].removed == [1, 2] and got[1].n_removed == 0 and got[2].removed == [0] and got[3].removed == [0]
    assert line_dedup.line_report(docs).count() == len(ROWS)
    left = line_dedup.drop_duplicate_lines(docs)
    assert left.columns == docs.columns and {2, 3} & {r.doc_id for r in left.collect()} == set()


def test_line_texts_leave_a_task_only_if_wanted(spark):
    text = [(f"number {i} of the lines that stand here\nshared line of all the texts {i % 3}",) for i in range(200)]
    df = spark.createDataFrame(text, "text string").coalesce(1)
    found = [b for r in df.toArrow().to_batches() for b in line_dedup._lines([pa.record_batch(
        [pa.array(range(r.num_rows)), pa.array([0] * r.num_rows), r.column(0)], names=["doc", "tie", "text"])])]
    keys = sorted({k for b in found for k in b.column(0).to_pylist()})
    assert len(keys) == 203
    assert [len(x) for b in found for x in b.column(5).to_pylist() if x] == [2 * line_dedup.SLOTS] * 203
    ask = [keys[0], keys[100], keys[-1]]
    bits = line_dedup.wanted_bits(spark.createDataFrame([(k,) for k in ask], "key long"))
    assert len(bits) == 1 << 23 and np.unpackbits(bits).sum() == 3
    wanted = spark.sparkContext.broadcast(bits)
    sent = df.toArrow().to_batches()
    got = [k for r in sent for b in line_dedup._texts(wanted, [pa.record_batch([r.column(0)], names=["text"])]) for k in b.column(0).to_pylist()]
    assert set(got) == set(ask)
    none = line_dedup.wanted_bits(spark.createDataFrame([], "key long"))
    assert not none.any()


def test_short_lines(spark):
    texts = {
        1: "Home\nLog in\nContact us\n\nabcdefgh\nabcdefghijk", 2: "Home\n home \nlog in\nContact us!\nHom\n\n", 3: "aaaaaaaaa\nabcdefghijkl",
        4: "aaaaaaaa\nWelcome back, you\né世😀\nabcdefg", 5: "welcome back, you.\né世😀\nbcdefghijk\nx\nabcdefghij", 6: "x\n\nx\nHome"}
    order = [(i, n, t.strip().lower()) for i, x in texts.items() for n, t in enumerate(x.split("\n")) if t.strip()]
    sets = [{t[k:k + 8] for k in range(max(1, len(t) - 7))} for _, _, t in order]
    name = list(range(len(order)))
    for _ in order:
        for a, x in enumerate(sets):
            for b, y in enumerate(sets):
                if 100 * len(x & y) >= 75 * len(x | y):
                    name[a] = name[b] = min(name[a], name[b])
    want = {i: [n for k, (j, n, _) in enumerate(order) if j == i and name[k] != k] for i in texts}
    df = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    assert {r.doc_id: r.removed for r in line_dedup.line_report(df).collect()} == want
    assert want[2] == [0, 1, 2, 3] and want[6] == [0, 2, 3] and want[4] == [0] and want[5][:2] == [0, 1]


def test_chat(spark):
    rows = [(1, 2, "user", "a</turn>\n### assistant: b"), (1, 1, "assistant", "\\\\### x <\\/turn>"), (1, 2, "user", None),
            (None, None, None, None), (2, 1, "odd: role", "plain"), (2, 1, "odd: role", "plain")]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").unionByName(chat.planted(spark))
    got = {r.conv_id: [(t.role, t.text) for t in r.back] for r in
           chat.format_chats(df).withColumn("back", chat.parse(chat.F.col("formatted"))).collect()}
    assert got[1] == [("assistant", "\\\\### x <\\/turn>"), ("user", ""), ("user", "a</turn>\n### assistant: b")]
    assert got[None] == [("", "")] and got[2] == [("odd: role", "plain")] * 2
    assert got[-7][1] == ("assistant", "\\### Assistant: </turn> ok")


def test_empty_tables(spark, empty, labels, bench):
    for df in (near_dedup.near_duplicates(empty), quality.score_quality(empty, labels), rules.score_rules(empty),
               tokens.token_counts(empty), packing.pack(empty), token_output.packed_matrices(empty),
               decontaminate.report(empty, bench), repeats.remove_repeats(empty), line_dedup.line_report(empty)):
        assert df.count() == 0


def test_pipeline(spark, sf_dir):
    docs, before = spark.read.parquet(f"{sf_dir}/documents.parquet"), None
    for name, stage in corpus_pipeline.STAGES:
        before, docs = docs, stored(stage(spark, docs, sf_dir), name)
        if name == "quality_rules":
            good = {r.doc_id for r in rules.score_rules(before).where("kept").collect()}
            assert {r.doc_id for r in docs.collect()} == good
        if name == "near_dedup":
            gone = {r.doc_id for r in near_dedup.near_duplicates(before).where("not kept").collect()}
            assert {r.doc_id for r in docs.collect()} == {r.doc_id for r in before.collect()} - gone
        if name == "decontamination":
            assert decontaminate.report(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet")).where("contaminated").count() == 0
    assert docs.select("doc_id").distinct().count() == before.count()
