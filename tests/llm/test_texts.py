"""Operators on texts against brute force, and their edge cases."""

from __future__ import annotations

import hashlib
import random
import re
from collections import Counter, defaultdict

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from varve.llm import components, decontaminate, quality, simhash, suffix_dedup, toxicity


def prose(rng, n, words=400):
    return " ".join(f"w{rng.randrange(words)}" for _ in range(n))


# --- Toxicity


def toxic_rows(rng, n):
    out = []
    for k in range(n):
        bad = k % 3 == 0
        parts = [prose(rng, 8) for _ in range(rng.randint(1, 6))]
        if bad:
            at = rng.randrange(len(parts))
            parts[at] += rng.choice([" scum", " vilest", " vilely***"])
        out.append((". ".join(parts) + ".", int(bad if rng.random() > 0.03 else not bad)))
    return out


def test_toxicity_learns_sentences_from_document_labels(spark):
    rng = random.Random(5)
    model = toxicity.fit(toxic_rows(rng, 1500))
    held = toxic_rows(rng, 300)
    right = [(toxicity.document_score(t, model) >= 0.5) == bool(re.search("scum|vile", t)) for t, _ in held]
    assert np.mean(right) > 0.98
    docs = spark.createDataFrame([(1, "w1 w2. w3 scum w4! w5"), (2, None), (3, ""), (None, "w1"), (1, "w1 w2. w3 scum w4! w5")], "doc_id long, text string")
    got = toxicity.score(docs, model).collect()
    assert [r.predicted for r in got] == [1, 0, 0, 0, 1] and all(0 <= r.score <= 1 for r in got) and got[3].held_out is False
    assert {(r.doc_id, r.number, r.sentence) for r in toxicity.locate(docs, model).collect()} == {(1, 1, "w3 scum w4")}


def test_scores_are_noisy_or_of_sentences(spark, documents):
    model = toxicity.Model({"bad": 3.0, "worse": 5.0, "ba-": 0.5, "fine": -1.0}, -4.0)

    def brute(text):
        clean = 1.0
        for s in re.split(r"[.!?\n]+", text or "") if (text or "").strip(" .!?\n") else [""]:
            if s.strip() or not (text or "").strip(" .!?\n"):
                z = -4.0
                for w in set(re.findall(r"[^\W\d_]+", s.lower())):
                    z += {"bad": 3.0, "worse": 5.0, "fine": -1.0}.get(w, 0.0) + 0.0
                clean *= 1 - 1 / (1 + np.exp(-z))
        return 1 - clean

    long = "fine day. " * 30_000 + "the worse bad. " + "ok "
    texts = [None, "", " . ", "Bad", "bad bad. Worse!\nfine fine", "a1bad_worse", long, "x" * 100_000]
    got = {r.doc_id: r for r in toxicity.score(documents(texts).withColumn("toxic", F.lit(1)), model).collect()}
    for k, t in enumerate(texts):
        assert abs(got[k].score - brute(t)) < 1e-9 and got[k].predicted == (got[k].score >= 0.5)
    assert [r.number for r in toxicity.locate(documents(texts), model).where("doc_id = 4").collect()] == [1]
    assert toxicity.score(documents([]), model).count() == 0


def test_held_out_labels_and_other_columns_teach_nothing(spark, documents):
    import zlib

    rows = toxic_rows(random.Random(3), 400)
    docs = documents([t for t, _ in rows])
    labels = [(k, y, "clash") for k, (_, y) in enumerate(rows)]
    out = [k for k in range(len(rows)) if zlib.crc32(str(k).encode()) % 5 == 0]
    assert {r.doc_id for r in toxicity.score(docs, toxicity.Model()).where("held_out").collect()} == set(out)
    table = lambda some: spark.createDataFrame(some, "doc_id long, toxic int, text string")
    first = toxicity.train(docs, table(labels))
    turned = toxicity.train(docs.withColumn("lang", F.lit("zz")).withColumn("source", F.col("doc_id").cast("string")), table([(k, 1 - y if k in out else y, "other") for k, y, _ in labels]))
    assert first.weights == turned.weights and first.bias == turned.bias and first.weights
    sampled = toxicity.sample(docs, table(labels + [(None, 1, ""), (1, None, ""), (2, 7, "")]), toxicity.Fitting(sample=100)).collect()
    assert len(sampled) == 100 and {r.text for r in sampled} <= {rows[k][0] for k in range(len(rows)) if k not in out}


def test_toxicity_without_labels_of_both_kinds(spark):
    model = toxicity.fit([("a b", 0)])
    assert not model.weights and 0 < toxicity.document_score("a b. c", model) < 0.5
    empty = spark.createDataFrame([], "doc_id long, text string")
    assert toxicity.score(empty, model).count() == 0
    labels = spark.createDataFrame([(1, None), (2, 1)], "doc_id long, toxic int")
    assert toxicity.train(empty, labels) == toxicity.Model()


# --- Quality rules


def brute_quality(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    windows = [tuple(words[k : k + 8]) for k in range(len(words) - 7)]
    times = Counter(windows)
    covered = {k + j for k, w in enumerate(windows) if times[w] > 1 for j in range(8)}
    lines = [x for x in (text or "").split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    n = len(words)
    return n, sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text or "")), len(lines) - len(set(lines)), len(covered), n < 20 or 100 * len(covered) > 30 * n


def test_quality_counts_match_brute_force(spark, documents):
    rng = random.Random(3)
    texts = [None, "", " \n\t ", "a\x0bb\x0cc d", "x # y * é 日本 <b> | $5 %", "one\ntwo\none\n \none "]
    texts += [prose(rng, n, v) + "\n" + prose(rng, n, v) for n in (5, 19, 20, 60) for v in (2, 5, 400)]
    texts += [" ".join(["the cat sat on"] * 50), prose(rng, 3000, 3000) + " " + prose(random.Random(9), 3000, 3000) * 2]
    texts += texts[-2:]
    got = [tuple(r) for r in quality.judge(documents(texts)).orderBy("doc_id").select("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed").collect()]
    assert got == [brute_quality(t) for t in texts]


def test_quality_rejects_what_is_far_from_its_language(spark, documents):
    rng = random.Random(4)
    common = "the of and to a in is that it for".split()
    clean = lambda: " ".join(rng.choice(common) if rng.random() < 0.5 else "".join(rng.choices("etaoinshr", k=6)) for _ in range(300))
    listed = " | ".join("".join(rng.choices("etaoinshr", k=8)) for _ in range(300))
    marked = " ".join(x + "$$$" for x in clean().split())
    docs = documents([clean() for _ in range(40)] + [listed, marked, None])
    kept = {r.doc_id for r in quality.keep(docs).collect()}
    assert kept == set(range(40)) and quality.keep(docs).columns == docs.columns
    assert quality.judge(documents([])).count() == 0 and quality.keep(documents([])).count() == 0


# --- SimHash


def brute_fingerprint(text, shingle=4):
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    if not words:
        return 0
    h = [xxhash.xxh64_intdigest(" ".join(words[k : k + shingle]).encode(), 42) for k in range(max(1, len(words) - shingle + 1))]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def brute_components(fps, distance=4):
    label = list(range(len(fps)))
    for _ in fps:
        for i, a in enumerate(fps):
            label[i] = min(label[j] for j, b in enumerate(fps) if (a ^ b).bit_count() <= distance)
    return label


def test_fingerprints(spark):
    for text in (None, "", " \n", "One", "a b", "A b C d", "ÀÉ b c d e", prose(random.Random(1), 500), "x y \x0bz"):
        assert simhash.fingerprint(text) == brute_fingerprint(text)


def test_more_fingerprints_take_more_blocks():
    assert [simhash.blocks_for(n, 4) for n in (0, 10**6, 10**9, 3 * 10**10, 10**11)] == [6, 6, 6, 7, 8]
    for blocks in (6, 7, 8):
        masks = [m % (1 << 64) for m in simhash._masks(4, blocks)]
        rng = random.Random(blocks)
        for _ in range(200):  # wherever four bits differ, some key has none of them
            differ = sum(1 << b for b in rng.sample(range(64), 4))
            assert any(not m & differ for m in masks)


@pytest.mark.parametrize(("chunk", "blocks"), [(simhash.CHUNK, None), (8, 6), (simhash.CHUNK, 8)])
def test_components_match_brute_force(spark, chunk, blocks, monkeypatch):
    monkeypatch.setattr(simhash, "CHUNK", chunk)
    rng = random.Random(7)
    fps = []
    for _ in range(8):
        at = rng.getrandbits(64)
        for _ in range(rng.randint(1, 30)):
            at ^= sum(1 << rng.randrange(64) for _ in range(rng.randint(0, 6)))
            fps.append(at)
    fps = sorted(set(fps), key=lambda _: rng.random())
    want = brute_components(fps)
    signed = [x - (1 << 64) if x >> 63 else x for x in fps]
    edges = simhash.links(spark.createDataFrame([(x,) for x in signed], "fp long"), 4, blocks)
    got = dict(components.components(edges).collect())
    groups = defaultdict(set)
    for k, x in enumerate(signed):
        groups[got.get(x, x)].add(k)
    expected = defaultdict(set)
    for k, x in enumerate(want):
        expected[x].add(k)
    assert sorted(map(sorted, groups.values())) == sorted(map(sorted, expected.values()))


def test_components_of_long_chains_in_rounds(spark, monkeypatch):
    monkeypatch.setattr(components, "REST", 5)
    rng = random.Random(2)
    names = rng.sample(range(1 << 40), 300)
    edges = [(names[k], names[k + 1]) for k in range(299) if k % 100 != 99] + [(names[0], names[0]), (names[1], names[0])]
    got = dict(components.components(spark.createDataFrame(edges, "a long, b long")).collect())
    assert [len({got[x] for x in names[k : k + 100]}) for k in (0, 100, 200)] == [1, 1, 1] and len(set(got.values())) == 3


def test_simhash_keeps_one_of_each_group(spark, documents):
    text = prose(random.Random(1), 300)
    near = text.replace("w7 ", "w8 ", 1)
    docs = documents([text, near, text, None, "", prose(random.Random(2), 300), text], [5, 6, 5, 9, 8, None, None])
    found = simhash.cluster(docs).collect()
    assert {(r.doc_id, r.component_id) for r in found if r.doc_id in (8, 9)} == {(8, 8), (9, 8)}
    assert {r.component_id for r in found if r.doc_id == 5} == {5}
    kept = simhash.deduplicate(docs)
    assert kept.columns == docs.columns and kept.count() == 3
    assert simhash.deduplicate(documents([])).count() == 0


# --- Suffix sorting


def brute_removed(texts, length=suffix_dedup.LENGTH, least_words=0):
    data = [(t or "").encode() for t in texts]
    seen = Counter(d[k : k + length] for d in data for k in range(len(d) - length + 1))
    out = []
    for d in data:
        covered = np.zeros(len(d), bool)
        for k in range(len(d) - length + 1):
            if seen[d[k : k + length]] > 1:
                covered[k : k + length] = True
        edges = np.diff(np.concatenate([[0], covered.astype(int), [0]]))
        if least_words:
            for a, z in zip(np.flatnonzero(edges == 1), np.flatnonzero(edges == -1), strict=True):
                covered[a:z] = z - a >= 400 or len(d[a:z].split()) >= least_words
            edges = np.diff(np.concatenate([[0], covered.astype(int), [0]]))
        kept = bytes(np.frombuffer(d, "u1")[~covered])
        out.append((len(d), int(covered.sum()), int((edges == 1).sum()), hashlib.sha256(kept).hexdigest(), kept.decode("utf-8", "ignore")))
    return out


@pytest.mark.parametrize(("chunk", "length", "words"), [(suffix_dedup.CHUNK, 400, 0), (3, 400, 0), (3, 160, 40), (3, 37, 0)])
def test_removed_bytes_match_brute_force(spark, documents, chunk, length, words, monkeypatch):
    monkeypatch.setattr(suffix_dedup, "CHUNK", chunk)
    rng = random.Random(11)
    shared, other = prose(rng, 150), prose(rng, 90)
    texts = [None, "", "short", "ab" * 600, "é" * 500, shared, shared[:399], shared[:400], shared[:401], shared[100:620]]
    texts += [prose(rng, rng.randint(0, 80)) + shared[rng.randint(0, 60) : 560 + rng.randint(0, 60)] + prose(rng, rng.randint(0, 80)) for _ in range(25)]
    texts += [prose(rng, 100) + other + prose(rng, 30) + other, "日本" + shared, shared]
    got = suffix_dedup.measure(documents(texts), suffix_dedup.Sizes(length, sorted=20_000), words).orderBy("doc_id").collect()
    assert [tuple(r)[1:] for r in got] == brute_removed(texts, length, words)


@pytest.mark.parametrize("chunk", [suffix_dedup.CHUNK, 3])
def test_op6_counts_passages_of_over_50_words(spark, documents, chunk, monkeypatch, tmp_path):
    from varve.llm import queries

    monkeypatch.setattr(suffix_dedup, "CHUNK", chunk)
    rng = random.Random(15)
    words = prose(rng, 55)
    assert 160 < len(words) < 400
    shared, other = prose(rng, 150), prose(rng, 40)
    texts = [None, "", prose(rng, 200), "ab" * 600, "日" * 300, shared, prose(rng, 30) + other, other + prose(rng, 60)]
    texts += [prose(rng, 70) + words + prose(rng, 70) for _ in range(6)]
    texts += [prose(rng, 20) + shared[rng.randint(0, 60) : 560] + prose(rng, 20) + words + prose(rng, 5) + words for _ in range(6)]
    ids = [None if k < 3 else k for k in range(len(texts) - 1)]
    texts, ids = [*texts[:-1], texts[8], texts[-1]], [*ids, 8, len(texts)]
    documents(texts, ids).coalesce(2).write.parquet(f"{tmp_path}/documents.parquet")
    rows = queries.op6_suffix_dedup(spark, str(tmp_path)).collect()
    whole, shorter = brute_removed(texts), brute_removed(texts, 160, 51)
    want = [(i, *a, b[2], b[1]) for i, a, b in zip(ids, whole, shorter, strict=True)]
    assert sorted(map(repr, map(tuple, rows))) == sorted(map(repr, want))
    assert [r.n_passages for r in rows if r.doc_id in range(9, 14)] == [1] * 5 and [r.n_removed for r in rows if r.doc_id in range(9, 14)] == [0] * 5


def test_texts_longer_than_a_block(spark, documents):
    rng = random.Random(12)
    long = prose(rng, 60_000, 90_000)
    texts = [long, prose(rng, 50) + long[200_000:200_900] + prose(rng, 50)]
    got = suffix_dedup.measure(documents(texts), suffix_dedup.Sizes(block=1 << 14)).orderBy("doc_id").collect()
    assert [tuple(r)[1:] for r in got] == brute_removed(texts)


def test_equal_rows_hold_their_spans_once(spark):
    rng = random.Random(14)
    shared = prose(rng, 120)
    texts = [shared + prose(rng, 60), prose(rng, 40) + shared + prose(rng, 50), prose(rng, 600)]
    rows = [(k, t) for k, t in enumerate(texts)] + [(7, texts[0] + texts[2])] * 3000 + [(None, texts[2])] * 2
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    spans = suffix_dedup._with_spans(docs, suffix_dedup.Sizes())
    assert spans.agg(F.max(F.size("spans"))).first()[0] < 200
    got = {(r.doc_id, r.n_bytes, r.n_removed): r.n for r in suffix_dedup.measure(docs).groupBy("doc_id", "n_bytes", "n_removed").agg(F.count("*").alias("n")).collect()}
    brute = brute_removed([*texts, *[texts[0] + texts[2]] * 2, *[texts[2]] * 2])
    want = {**{(k, *brute[k][:2]): 1 for k in range(3)}, (7, *brute[3][:2]): 3000, (None, *brute[5][:2]): 2}
    assert got == want


def test_remove_keeps_columns_and_rows(spark, documents):
    rng = random.Random(13)
    shared = prose(rng, 200)
    docs = documents(["é" + shared + "x", shared, None, "", "clean"], [1, None, None, 4, 5])
    out = suffix_dedup.remove(docs)
    assert out.columns == docs.columns
    got = [(r.doc_id, r.text, r.n_chars) for r in out.collect()]
    assert len(got) == 5 and set(got) == {(None, None, None), (None, "", 0), (1, "éx", 2), (4, "", 0), (5, "clean", 5)}
    assert suffix_dedup.measure(documents([])).count() == 0


# --- Decontamination


def brute_hits(text, items, window=10):
    words = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
    ws, hit, named = words(text), set(), set()
    for name, t in items:
        item = words(t)
        for k in range(max(1, len(item) - window + 1) if item else 0):
            w = item[k : k + window]
            for at in range(len(ws) - len(w) + 1):
                if ws[at : at + len(w)] == w:
                    hit.update(range(at, at + len(w)))
                    named.add(name)
    named = sorted(str(n) for n in named if n is not None)
    return len(ws), len(hit), len(named), hashlib.sha256(",".join(named).encode()).hexdigest(), bool(hit)


@pytest.mark.parametrize(("block_bytes", "shard_bytes"), [(1 << 20, 1 << 20), (1 << 20, 100), (200, 1)])
def test_hits_match_brute_force(spark, documents, block_bytes, shard_bytes):
    rng = random.Random(21)
    items = [(1, prose(rng, 30, 6)), (2, prose(rng, 12, 300)), (10, "Two Words"), (3, ""), (4, None), (None, prose(rng, 11, 50)), (2, "été 日本 w1"), (5, "w3")]
    whole = [t for _, t in items if t]
    texts = [None, "", "two-WORDS two words", "Été, 日本; w1!", whole[0] + " " + whole[0]]
    texts += [prose(rng, rng.randint(0, 60), 6) + " " + " ".join(rng.choice(whole).split()[: rng.randint(1, 30)]) + " " + prose(rng, 20, 60) for _ in range(400)]
    ids = [*range(len(texts)), 9, None, None]
    texts += [texts[9], texts[10], texts[10]]
    benchmark = spark.createDataFrame(items, "item_id long, text string")
    assert (decontaminate.count_blocks(benchmark, block_bytes) > 1) == (block_bytes == 200)
    got = decontaminate.match(documents(texts, ids), benchmark, 10, block_bytes, shard_bytes).collect()
    want = [(i, *brute_hits(t, items)) for i, t in zip(ids, texts, strict=True)]
    assert sorted(map(repr, map(tuple, got))) == sorted(map(repr, want))
    left = decontaminate.remove(documents(texts, ids), benchmark, 10, block_bytes, shard_bytes)
    assert left.count() == len(texts) and left.columns == documents([]).columns
    again = decontaminate.match(documents(texts, ids), benchmark, 10).where("n_hit > 0").count()
    assert again and {r.doc_id for r in left.collect() if r.text in (None, "")} >= {0, 1}


def test_shards_are_cut_in_the_worker():
    import pyarrow as pa

    batches = [pa.record_batch([pa.array(["x" * 50] * 1000)], names=["text"])]
    assert [t.num_rows for t in decontaminate._shards(iter(batches), 0, 3000)] == [200] * 5
    assert [t.num_rows for t in decontaminate._shards(iter(batches), 0, 1 << 20)] == [1000]


def test_spans_are_cut_out(spark, documents):
    item = "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda"
    docs = documents([f"Keep this. {item.title()}, and this.", None, "alpha beta"], [1, 1, None])
    benchmark = spark.createDataFrame([(1, item)], "item_id long, text string")
    out = decontaminate.remove(docs, benchmark).collect()
    assert {(r.doc_id, r.text, r.n_chars) for r in out} == {(1, "Keep this. , and this.", 22), (1, None, None), (None, "alpha beta", 10)}
    parted = decontaminate.remove(docs, benchmark.unionByName(benchmark), block_bytes=20).collect()
    assert {(r.doc_id, r.text, r.n_chars) for r in parted} == {(r.doc_id, r.text, r.n_chars) for r in out}
    none = decontaminate.match(docs, benchmark.limit(0)).collect()
    assert [r.n_hit for r in none] == [0, 0, 0] and decontaminate.match(documents([]), benchmark).count() == 0


def test_index_finds_every_occurrence():
    rng = np.random.default_rng(0)
    text = np.concatenate([rng.integers(1, 5, 400), [0], rng.integers(1, 5, 90), [0]])
    index = decontaminate.FMIndex(text, 5)
    for n in (1, 2, 5):
        windows = np.array([text[k : k + n] for k in range(0, 300, 7)])
        low, high = index.search(windows)
        for w, a, z in zip(windows, low, high, strict=True):
            want = [k for k in range(len(text) - n + 1) if (text[k : k + n] == w).all()]
            assert sorted(index.locate(np.arange(a, z)).tolist()) == want
