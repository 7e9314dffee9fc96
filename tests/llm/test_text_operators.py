import hashlib
import math
import random
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

from pyspark.sql import functions as F

from marginalia.llm import bpe_codec, gru_lm, mixing, quality_classifier, quality_rules, token_counts
from marginalia.llm.queries import vocabulary

from . import brute

DOCS = "/root/testdata/sf0.001/documents.parquet"
ODD = [
    None, "", " ", "\n\t", "a", "A b c d", "a b c a b c a b c", "x\ny\nx\n\nx ", "é È ß İ ΑΣ", "🎉🎉 <s></s><unk> <0x41>", "<|endoftext|>a<|startoftext|> it's We'LL",
    " " * 700 + "x", "a" * 3000, "ab" * 700 + " " + "#$%" * 90, "tion" * 300, "日本語のテキスト", "\x00\x1c  b﻿", "é ́", "of the\r\nof the\x0bof the",
]


@pytest.fixture(scope="module")
def odd(spark):
    rows = [(i, t, "en", "s", None) for i, t in enumerate(ODD)] + [(None, "no id", None, None, None), (3, "again", "x", "y", 1), (3, "again", "x", "y", 1)]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").withColumnRenamed("lang", "score")


def test_token_counts_match_library(spark, odd):
    from sentencepiece import SentencePieceProcessor

    library = SentencePieceProcessor(model_file=vocabulary("piece_bpe_32k.model"))
    docs = spark.read.parquet(DOCS)
    both = docs.select("doc_id", "text").collect() + odd.select("doc_id", "text").collect()
    got = token_counts.token_counts(docs.select("doc_id", "text").unionByName(odd.select("doc_id", "text")), vocabulary("piece_bpe_32k.model"), limit=900).collect()
    want = Counter((d, len((t or "").encode()), n := len(library.encode(t or "")), n > 900) for d, t in both)
    assert Counter(map(tuple, got)) == want


@pytest.mark.parametrize("leaf", [40, 32_768])
def test_bpe_matches_library(spark, odd, leaf):
    from tokenizers import Tokenizer

    library = Tokenizer.from_file(vocabulary("word_bpe_49k.json"))
    docs = spark.read.parquet(DOCS).select("doc_id", "text").unionByName(odd.select("doc_id", "text"))
    want = Counter()
    for d, t in docs.collect():
        ids = library.encode(t or "", add_special_tokens=False).ids
        want[d, np.array(ids, "<u4").tobytes(), library.decode(ids, skip_special_tokens=False)] += 1
    got = bpe_codec.bpe_encode_decode(docs, vocabulary("word_bpe_49k.json"), leaf_chars=leaf).collect()
    assert Counter((d, bytes(i), s) for d, i, s in got) == want


def test_long_pretokens_match_library():
    """Both layouts of the merging rounds against the library, on pre-tokens of thousands of characters."""
    import random

    from sentencepiece import SentencePieceProcessor

    library = SentencePieceProcessor(model_file=vocabulary("piece_bpe_32k.model"))
    counter = token_counts.PieceCounter(vocabulary("piece_bpe_32k.model"))
    rng = random.Random(6)
    syllables = ["the", "ing", "an", "er", "re", "tion", "a", "b", "c", "ß", "é", "日", "0", "1", "-", "aa", "bc"]
    texts = ["".join(rng.choice(syllables) for _ in range(n)) for n in [90, 150, 300, 2000, 6000]] + ["a" * 9000, "ab" * 5000, "abc" * 3000, "".join(rng.choice("abcdefgh") for _ in range(5000)), "".join(map(chr, range(33, 3000)))]
    assert counter.count(texts) == [len(library.encode(t)) for t in texts]


def test_statistics_match_brute_force(spark, odd):
    docs = spark.read.parquet(DOCS).select("doc_id", "text").unionByName(odd.select("doc_id", "text"))
    got = quality_rules.quality_rules(docs, spark.createDataFrame([(0,), (1,)], "doc_id long"))
    columns = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]
    assert Counter((r["doc_id"], *(r[c] for c in columns)) for r in got.collect()) == Counter((d, *brute.statistics(t)) for d, t in docs.collect())
    for r in got.collect():
        assert r["base_failed"] == (r["n_words"] < 50 or 100 * r["n_repeat_words"] > 50 * r["n_words"])
        assert r["kept"] == (not r["base_failed"] and r["score"] >= quality_rules.THRESHOLD)


def test_log_ratio_matches_brute_force(spark):
    import xxhash

    rows = [(0, "a b c b"), (1, "a b"), (2, "x y x"), (3, None), (4, "a")]
    signed = lambda x: x - (1 << 64) if x >> 63 else x
    one = lambda w: xxhash.xxh64_intdigest(w.encode(), 42)

    def two(a, b):
        h = xxhash_long(one(a), 42)
        return xxhash_long(one(b), h)

    def grams(t):
        w = brute.words(t)
        return [one(x) & 255 for x in w] + [two(x, y) & 255 for x, y in zip(w, w[1:], strict=False)]

    raw, target = Counter(g for _, t in rows for g in grams(t)), Counter(g for i, t in rows for g in grams(t) if i in (0, 4))
    scale = sum(target.values()) / sum(raw.values())
    a = quality_rules.SMOOTHING
    ratio = {b: math.log((target[b] + a) / (n * scale + a)) for b, n in raw.items()}
    got = quality_rules.quality_rules(spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame([(0,), (4,), (None,)], "doc_id long"), bits=8)
    for r in got.collect():
        g = grams(dict(rows)[r["doc_id"]])
        assert r["score"] == pytest.approx(sum(ratio[b] for b in g) / len(g) if g else 0.0)
    assert signed(1) == 1
    none = quality_rules.quality_rules(spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame([], "doc_id long"))
    assert {r["score"] for r in none.collect()} == {0.0}


def xxhash_long(value, seed):
    """XXH64 of one long, as the hash of a bigint column."""
    m = (1 << 64) - 1
    rot = lambda x, r: ((x << r) | (x >> (64 - r))) & m
    p1, p2, p3, p4, p5 = 0x9E3779B185EBCA87, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x85EBCA77C2B2AE63, 0x27D4EB2F165667C5
    h = (seed + p5 + 8) & m
    h ^= rot(value * p2 & m, 31) * p1 & m
    h = (rot(h, 27) * p1 + p4) & m
    h ^= h >> 33
    h = h * p2 & m
    h ^= h >> 29
    h = h * p3 & m
    return h ^ (h >> 32)


def test_classifier_learns(spark, odd):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    labels = spark.read.parquet("/root/testdata/sf0.01/labels.parquet")
    from pyspark.sql import functions as F

    held = quality_classifier.held_out(F.col("doc_id"))
    model = quality_classifier.train(docs, labels.where(~held).select("doc_id", "quality"))
    scored = quality_classifier.quality_scores(docs, model).join(labels, "doc_id").where(held).collect()
    assert sum(r["predicted"] == r["quality"] for r in scored) >= 0.95 * len(scored)
    assert all(r["predicted"] == (r["score"] >= 0.5) for r in scored)
    out = quality_classifier.quality_scores(odd, model)
    assert out.count() == odd.count()
    assert all(0 <= r["score"] <= 1 for r in out.collect())
    assert {r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 3 == 1) for r in docs.select("doc_id", held.alias("held_out")).collect()} == {True}


def test_frequent_words_stay_remembered(monkeypatch):
    """A worker learns a word that comes in every batch once, however many other words come between."""
    from tokenizers import Tokenizer

    code, learned = bpe_codec.WordBpe(vocabulary("word_bpe_49k.json")), Counter()
    learn = code._learn
    monkeypatch.setattr(code, "_learn", lambda new: (learned.update(new), learn(new)))
    monkeypatch.setattr(type(code.known), "BYTES", 20_000)
    library = Tokenizer.from_file(vocabulary("word_bpe_49k.json"))
    for i in range(30):
        row = ["again", *(f"w{i}x{j}" for j in range(30)), "Once,more"]
        code.encode_chunks([row])
        ids = np.frombuffer(code.coded(row)[0], "<u4").tolist()
        want = library.encode(" ".join(row), add_special_tokens=False).ids
        assert ids == want and code.coded(row)[1] == library.decode(want, skip_special_tokens=False)
    assert learned["again"] == learned["Once,more"] == 1
    assert len(code.known) + len(code.known.older) < 200  # both generations are bounded


def test_language_model(spark, odd):
    docs = spark.read.parquet(DOCS).select("doc_id", "text")
    rows = docs.collect()
    tokens = {r["doc_id"]: [*brute.words((r["text"] or "").translate(brute.UPPER)), None] for r in rows}
    train = Counter(t for i, ts in tokens.items() if zlib.crc32(str(i).encode()) % 10 for t in ts)
    n, v = sum(train.values()), len(train)
    got = {r["doc_id"]: r for r in gru_lm.score_texts(docs).collect()}
    assert len(got) == len(rows)
    for i, ts in tokens.items():
        r = got[i]
        assert r["held_out"] == (zlib.crc32(str(i).encode()) % 10 == 0)
        assert (r["n_tokens"], r["n_known"], r["train_tokens"]) == (len(ts), sum(train[t] > 0 for t in ts), n)
        assert r["base_score"] == pytest.approx(sum(math.log10((train[t] + 0.1) / (n + 0.1 * (v + 1))) for t in ts))
    held = [r for r in got.values() if r["held_out"]]
    assert sum(r["score"] for r in held) > sum(r["base_score"] for r in held)
    twice = gru_lm.score_texts(odd)
    assert twice.count() == odd.count()
    assert all(math.isfinite(r["score"]) for r in twice.collect())


def test_network_sums_to_one_and_gradient():
    rng = np.random.default_rng(0)
    f = rng.uniform(1, 9, gru_lm.SYMBOLS)
    net = gru_lm.Net(frequency=f / f.sum())
    prefix = rng.integers(0, gru_lm.SYMBOLS, 5)
    base = gru_lm.log_likelihoods(net, [prefix])[0]
    total = sum(math.exp(x - base) for x in gru_lm.log_likelihoods(net, [np.append(prefix, s) for s in range(gru_lm.SYMBOLS)]))
    assert total == pytest.approx(1, abs=1e-3)
    # a gradient by differences
    net.p = {k: p.astype(np.float64) for k, p in net.p.items()}
    ids = rng.integers(0, 50, (4, 7))

    def loss(grad=None):
        h, tape, hidden = np.zeros((4, gru_lm.HIDDEN)), [], []
        for t in range(6):
            h, kept = net.step(ids[:, t], h)
            tape.append(kept)
            hidden.append(h)
        s, back = net.outputs(np.concatenate(hidden), ids[:, 1:].T.ravel(), grad)
        if grad is not None:
            net.backward(tape, list(back.reshape(6, 4, -1)), grad)
        return -s.sum()

    grad = {k: np.zeros_like(p) for k, p in net.p.items()}
    loss(grad)
    for name, at in (("x", (int(ids[0, 0]), 3)), ("x", (int(ids[1, 2]), 30)), ("x", (int(ids[2, 1]), 60)), ("h", (2, 5)), ("h", (3, 60)), ("c", (1, 2)), ("w", (int(ids[0, 1]) // 32, 4, 5)), ("wb", (1, 3))):
        old = net.p[name][at]
        net.p[name][at] = old + 1e-5
        up = loss()
        net.p[name][at] = old - 1e-5
        down = loss()
        net.p[name][at] = old
        assert grad[name][at] == pytest.approx((up - down) / 2e-5, rel=1e-3, abs=1e-5)


def test_gates_are_blocks_of_memory():
    """Inner loops run along tokens, not along the few numbers of one token; results are the plain formulas'."""
    rng = np.random.default_rng(6)
    net = lane_net()
    net.p["h"][...] = rng.normal(0, 0.5, net.p["h"].shape)
    ids, h = rng.integers(0, gru_lm.SYMBOLS, 40), rng.normal(0, 0.5, (40, gru_lm.HIDDEN)).astype(np.float32)
    new, tape = net.step(ids, h)
    assert new.T.flags.c_contiguous and all(x.flags.c_contiguous for x in tape[2:])
    k = gru_lm.HIDDEN
    a, u = net.p["x"][ids].astype(float), h.astype(float) @ net.p["h"]
    z, r = (1 / (1 + np.exp(-(a[:, i : i + k] + u[:, i : i + k]))) for i in (0, k))
    n = np.tanh(a[:, 2 * k :] + r * u[:, 2 * k :])
    assert np.allclose(new, (1 - z) * n + z * h, atol=1e-6)
    assert all(np.shares_memory(p, net.memory) for p in net.p.values())  # one optimiser step for all


def test_words_of_a_run_are_split_and_encoded_as_one_array():
    rng = random.Random(7)
    texts = ["", None, " ", "One two\tONE", "\n\r\x0b\x0c", "É Ä\u0085b  c ", "a\x1cb", "日本語 テキスト x", "😀 y\x00"] + ["".join(rng.choices("aX \té\n日x", k=rng.randrange(30))) for _ in range(40)]
    plain = [[w.encode() for w in brute.words((t or "").translate(brute.UPPER))] for t in texts]
    lexicon = gru_lm.Lexicon([(gru_lm.END, 9), ("one", 5), ("x", 3)])
    known = {b"one": 1, b"x": 2}
    for kind in (pa.string(), pa.large_string()):
        for cut in (slice(0, None), slice(3, 9), slice(0, 1), slice(0, 0)):
            some, want = pa.array(texts, kind)[cut], plain[cut]
            words, size = gru_lm.split_words(some)
            assert (words.to_pylist(), size.tolist()) == ([w for row in want for w in row], [len(row) for row in want])
            if want:
                symbol, place, size, at, rare = lexicon.encode_all(some)
                assert place.tolist() == [p for row in want for p in [*(known.get(w, 3) for w in row), 0]]
                other = [w for row in want for w in row if w not in known]
                assert rare.to_pylist() == other and size.tolist() == [len(row) + 1 for row in want]
                assert symbol[at].tolist() == [gru_lm.SYMBOLS - gru_lm.ENDINGS + gru_lm.ending(w.decode()) for w in other]


def test_outputs_pass_over_tokens_without_a_target():
    rng = np.random.default_rng(8)
    net = lane_net()
    net.memory[:] = rng.normal(0, 0.3, net.SIZE)
    h, target = rng.normal(0, 0.5, (3000, gru_lm.HIDDEN)).astype(np.float32), rng.integers(0, gru_lm.SYMBOLS, 3000)
    target[::7] = -1
    kept = np.flatnonzero(target >= 0)
    full, part = (net.views(np.zeros(net.SIZE, np.float32)) for _ in range(2))
    score, back = net.outputs(h, target, full)
    alone, back_alone = net.outputs(h[kept], target[kept], part)
    assert not score[::7].any() and not back[::7].any()
    assert np.allclose(score[kept], alone, atol=1e-5) and np.allclose(back[kept], back_alone, atol=1e-5)
    assert all(np.allclose(full[n], part[n], atol=1e-3) for n in full)


def lane_net():
    return gru_lm.Net(frequency=np.full(gru_lm.SYMBOLS, 1 / gru_lm.SYMBOLS))


def test_lanes_run_to_their_ends():
    rng = np.random.default_rng(1)
    few = [rng.integers(0, gru_lm.SYMBOLS, n) for n in [70] * 50]
    assert gru_lm.train_lanes(lane_net(), iter(few)) == 50 * 70  # fewer than a quarter of the lanes
    long = [rng.integers(0, gru_lm.SYMBOLS, n) for n in [20_000] + [70] * 300]
    assert gru_lm.train_lanes(lane_net(), iter(long)) == 20_000 + 70 * 300


def test_stretches_hold_every_token_once():
    text = np.random.default_rng(2).integers(0, gru_lm.SYMBOLS, 3 * gru_lm.STRETCH + 5)
    parts = list(gru_lm.stretches(text))
    assert np.array_equal(np.concatenate([p[p >= 0] for p in parts]), text)
    assert [int((p < 0).sum()) for p in parts] == [0] + [gru_lm.WINDOW] * 3
    assert np.array_equal(~parts[1][: gru_lm.WINDOW], text[gru_lm.STRETCH - gru_lm.WINDOW : gru_lm.STRETCH])


@pytest.mark.parametrize("workers", [1, 211])
def test_every_token_is_learned_from_once(spark, monkeypatch, workers):
    docs = spark.read.parquet(DOCS).select("doc_id", "text").where("doc_id < 30").selectExpr("doc_id", "coalesce(text, '') as text")
    counts = {r["word"]: r["c"] for r in gru_lm.word_counts(docs).collect()}
    want = Counter(w for r in docs.collect() for w in [*brute.words(r["text"].translate(brute.UPPER)), gru_lm.END])
    assert counts == want
    tokens = sum(counts.values())
    monkeypatch.setattr(gru_lm, "PART_TOKENS", tokens / gru_lm.ROUNDS / workers)
    lexicon = gru_lm.Lexicon(sorted(counts.items(), key=lambda x: (x[0] != gru_lm.END, -x[1], x[0])))
    rows = [(r["doc_id"], r["doc_id"], bytearray(lexicon.encode(r["text"])[0].astype(np.int16).tobytes())) for r in docs.collect()]
    net, learned = gru_lm.train_network(spark.createDataFrame(rows, "doc_id long, row long, symbols binary"), lane_net(), tokens)
    assert learned == tokens
    assert np.abs(net.flat() - lane_net().flat()).max() > 0


def test_likelihood_matches_a_plain_loop():
    rng = np.random.default_rng(4)
    f = rng.uniform(1, 9, gru_lm.SYMBOLS)
    net = gru_lm.Net(frequency=f / f.sum())
    net.p["h"] = rng.normal(0, 0.5, net.p["h"].shape).astype(np.float32)
    texts = [rng.integers(0, gru_lm.SYMBOLS, n) for n in (1, 40, 0, 3, 700, 16, 17)]
    for text, got in zip(texts, gru_lm.log_likelihoods(net, texts), strict=True):
        h, before, total = np.zeros((1, gru_lm.HIDDEN)), gru_lm.SYMBOLS, 0.0
        for t in text:
            a, u = net.p["x"][before].astype(float), h @ net.p["h"]
            gate = lambda x: 1 / (1 + np.exp(-x))
            k = gru_lm.HIDDEN
            z, r = gate(a[:k] + u[:, :k]), gate(a[k : 2 * k] + u[:, k : 2 * k])
            n = np.tanh(a[2 * k :] + r * u[:, 2 * k :])
            h = (1 - z) * n + z * h
            c, w = divmod(int(t), gru_lm.CLASSES)
            first, second = (h @ net.p["c"] + net.p["cb"])[0], (h @ net.p["w"][c] + net.p["wb"][c])[0]
            total += first[c] - np.log(np.exp(first).sum()) + second[w] - np.log(np.exp(second).sum())
            before = t
        assert got == pytest.approx(total, rel=1e-4, abs=1e-4)


MASK = (1 << 64) - 1


def plain_mix(x):
    for _ in range(2):
        x ^= x >> 32
        x = x * 0xD6E8FEB86659FD93 & MASK
    return x ^ (x >> 32)


def plain_features(text):
    """Buckets of the words, and of the runs of 3 and 4 characters in them between blanks."""
    key = lambda c: plain_mix(ord(c) + 0x51ED27)
    out = []
    for w in brute.words(text):
        total = sum(plain_mix((key(c) + (i + 1) * 0xD1B54A32D192ED03) & MASK) for i, c in enumerate(w))
        out.append(plain_mix(total & MASK))
        for n in (3, 4):
            for g in (f" {w} "[i : i + n] for i in range(len(w) + 3 - n)):
                h = 0
                for c in g:
                    h = (h * 0x9E3779B97F4A7C15 + key(c)) & MASK
                out.append(plain_mix((h + n) & MASK))
    return Counter(x & (quality_classifier.BUCKETS - 1) for x in out)


def test_classifier_matches_a_plain_version(spark, monkeypatch):
    texts = [t or "" for t in ODD if "\x1c" not in (t or "")] + ["word " * 9000 + "x" * 3000 + "\n" + "tail é" * 500]
    want = [plain_features(t) for t in texts]
    for size in (700, quality_classifier.PIECE):  # long texts in pieces, and whole
        monkeypatch.setattr(quality_classifier, "PIECE", size)
        got = quality_classifier.bags(texts) if size > 700 else [quality_classifier.bags([t])[0] for t in texts]
        assert [dict(zip(b.tolist(), c.tolist(), strict=True)) for b, c in got] == want
    rng = np.random.default_rng(0)
    model = quality_classifier.Embeddings(rng.normal(0, 1, (quality_classifier.BUCKETS, quality_classifier.DIM)), rng.normal(0, 1, (quality_classifier.DIM, 2)), np.array([0.3, -0.2]))
    frame = spark.createDataFrame(list(enumerate(texts)), "_id long, text string").withColumn("_label", F.lit("clash")).withColumn("predicted", F.lit("x"))
    scores = {r["_id"]: r["score"] for r in quality_classifier.quality_scores(frame, model).collect()}
    for i, bag in enumerate(want):
        n = sum(bag.values())
        hidden = sum((c * model.vectors[b] for b, c in bag.items()), np.zeros(quality_classifier.DIM)) / max(1, n)
        e = np.exp(hidden @ model.weights + model.bias)
        assert scores[i] == pytest.approx(e[1] / e.sum(), rel=1e-4)


def test_one_very_long_text(spark):
    """A text of a million characters beside short ones goes through the operators whole."""
    text = "\n".join(f"line {i} of the long text says word{i % 977} again" for i in range(22_000))
    docs = spark.createDataFrame([(1, text, "a"), (2, "short one", "b"), (3, "x" * 200_000, "b")], "doc_id long, text string, source string")
    n, chars, symbols, lines, repeated = brute.statistics(text)
    r = {x["doc_id"]: x for x in quality_rules.quality_rules(docs, docs.where("doc_id = 2").select("doc_id")).collect()}[1]
    assert (r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"], r["n_repeat_words"]) == (n, chars, symbols, lines, repeated)
    scored = {x["doc_id"]: x for x in gru_lm.score_texts(docs.withColumn("held_out", F.lit("clash")).withColumn("key", F.lit(1))).collect()}
    assert (scored[1]["n_tokens"], scored[3]["n_tokens"]) == (n + 1, 2)
    taken = {x["doc_id"]: x for x in mixing.taken(mixing.mix_plan(docs)).collect()}
    assert taken[1]["size"] == n and sum(x["taken"] for x in taken.values()) == pytest.approx(n + 3, abs=2 * mixing.BLOCK)


def test_digests_of_ids(spark):
    from pyspark.sql import functions as F

    coded = bpe_codec.bpe_encode_decode(spark.createDataFrame([(1, "hello")], "doc_id long, text string"), vocabulary("word_bpe_49k.json"))
    r = coded.select("ids", F.sha2("ids", 256).alias("s")).first()
    assert r["s"] == hashlib.sha256(bytes(r["ids"])).hexdigest()


def test_empty_tables(spark):
    none = spark.createDataFrame([], "doc_id long, text string, source string")
    assert token_counts.token_counts(none, vocabulary("piece_bpe_32k.model")).count() == 0
    assert bpe_codec.bpe_encode_decode(none, vocabulary("word_bpe_49k.json")).count() == 0
    assert quality_rules.quality_rules(none, none.select("doc_id")).count() == 0
    assert gru_lm.score_texts(none).count() == 0
    model = quality_classifier.train(none, none.selectExpr("doc_id", "1 as label"))
    assert quality_classifier.quality_scores(none, model).count() == 0
