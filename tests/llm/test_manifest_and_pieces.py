import hashlib
import random
import zlib
from collections import Counter

import numpy as np
import pytest
from sentencepiece import SentencePieceProcessor
from tokenizers import Tokenizer

from pyspark.sql import functions as F

from marginalia.llm import merkle_manifest, piece_codec, queries, token_alignment
from marginalia.llm.bpe_codec import byte_symbols
from marginalia.llm.common import staged
from marginalia.llm.queries import vocabulary

SF = "/root/testdata/sf0.001"
ODD = [
    None, "", " ", "\n\t", "a", "  two  spaces ", "é È ß İ ΑΣ", "🎉🎉 <s></s><unk> <0x41>", "<|endoftext|>a it's We'LL", " " * 700 + "x", "a" * 3000, "日本語のテキスト" * 50,
    "a mark ▁ inside", "\x00\x1c  b﻿", "é ́", "of the\r\nof the\x0bof the", "tion" * 300, "no" + "\n" * 600 + "wide",
]
DDL = "doc_id long, text string, lang string, source string, n_chars long, digest string, pos long, ids long"


@pytest.fixture(scope="module")
def odd(spark):
    """Texts of all kinds, repeated rows, null fields, and columns whose names clash with the operators' own."""
    rows = [(i, t, "en", "s", 5, "x", 1, 1) for i, t in enumerate(ODD)] + [(None, "no Id", None, None, None, "x", 1, 1), (3, "Again", "x", "y", 1, "x", 1, 1), (3, "Again", "x", "y", 1, "z", 2, 2), (7, None, None, "y", 1, "", 0, 0)]
    return spark.createDataFrame(rows, DDL)


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def plain_manifest(rows, fan=16):
    """(doc_id, leaf, subroot, root, proof, folded root, verified) by building every tree level by level."""
    field = lambda v: "-" if v is None else f"{len(str(v).encode())}:{v}"
    low = str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})
    trees = {}
    for doc_id, source, lang, n_chars, text in rows:
        given = "".join(map(field, (doc_id, source, lang, n_chars)))
        leaf = folded = sha(given + field(text))
        if doc_id is not None and zlib.crc32(str(doc_id).encode()) % 5 == 0 and text is not None:
            folded = sha(given + field(text.translate(low)))
        trees.setdefault(source, []).append((doc_id, leaf, folded))

    def build(level):
        ways, at = [[] for _ in level], list(range(len(level)))
        while len(level) > 1:
            runs = [level[i : i + fan] for i in range(0, len(level), fan)]
            for way, i in zip(ways, at, strict=True):
                way.append((i % fan, runs[i // fan]))
            at = [i // fan for i in at]
            level = [sha("".join(r)) for r in runs]
        return level[0], ways

    names = sorted(trees, key=lambda s: (s is not None, (s or "").encode()))
    for s in names:
        trees[s].sort(key=lambda x: (x[0] is not None, x[0] or 0, x[1]))
    built = {s: build([x[1] for x in trees[s]]) for s in names}
    root, above = build([built[s][0] for s in names]) if names else (None, [])
    out = Counter()
    for s, up in zip(names, above, strict=True):
        for (doc_id, leaf, folded), way in zip(trees[s], built[s][1], strict=True):
            way = way + up
            proof = "".join("".join(r[:i]) + "".join(r[i + 1 :]) for i, r in way)
            for i, r in way:
                folded = sha("".join(r[:i]) + folded + "".join(r[i + 1 :]))
            out[doc_id, leaf, built[s][0], root, sha(proof), folded, folded == root] += 1
    return out


def made_manifest(docs):
    return Counter(map(tuple, merkle_manifest.manifest(docs).select("doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified").collect()))


def fields(docs):
    return docs.select("doc_id", "source", "lang", "n_chars", "text").collect()


def test_manifest_matches_plain_trees(spark, odd):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    got = Counter(map(tuple, queries.op11_merkle_manifest(spark, SF).collect()))
    assert got == plain_manifest(fields(docs))
    assert any(not k[6] for k in got) and any(k[6] for k in got)
    assert made_manifest(odd) == plain_manifest(fields(odd))


@pytest.mark.parametrize("n", [1, 2, 16, 17, 4096, 4097, 9000])
def test_manifest_of_one_source(spark, n):
    """Trees of one, two and four levels, of one block and of several; every row of one text."""
    docs = spark.range(n).select(F.col("id").alias("doc_id"), F.lit("s").alias("source"), F.lit("en").alias("lang"), F.lit(4).alias("n_chars"), F.lit("Text").alias("text"))
    assert made_manifest(docs) == plain_manifest(fields(docs))


def test_manifest_of_many_sources_and_equal_rows(spark):
    """Four thousand lone leaves and one source of equal rows: the upper tree has several blocks, too."""
    lone = spark.range(4200).select(F.col("id").alias("doc_id"), F.concat(F.lit("s"), F.col("id")).alias("source"), F.lit(None).cast("string").alias("lang"), F.lit(4).alias("n_chars"), F.lit("A").alias("text"))
    equal = spark.range(5000).select(F.lit(5).cast("long").alias("doc_id"), F.lit(None).cast("string").alias("source"), F.lit("x").alias("lang"), F.lit(4).alias("n_chars"), F.lit("Equal").alias("text"))
    docs = lone.unionByName(equal)
    assert made_manifest(docs) == plain_manifest(fields(docs))


def test_manifest_of_nothing(spark):
    assert merkle_manifest.manifest(spark.createDataFrame([], DDL)).collect() == []


def test_equal_rows_are_dealt_over_partitions(spark):
    """Range partitions of 20,000 equal rows stay alike, since no sort key repeats."""
    rows = staged(spark.range(20_000, numPartitions=8).select(F.lit(1).cast("long").alias("doc_id"), F.lit("s").alias("source"), F.lit("d").alias("leaf")), "equal")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        ordered, _ = merkle_manifest.ranged(rows, "source", ["doc_id", "leaf"], "equal-sorted")
        sizes = [r["count"] for r in ordered.groupBy("_part").count().collect()]
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert sum(sizes) == 20_000 and max(sizes) < 8000


def random_texts(n, seed):
    rng = random.Random(seed)
    parts = [*"aaabbeeeothinsr  ▁\n\t\x00éß😀漢字梦'’<>0x41s/", "the", "ing", "  ", "<0x41>", "<s>", "</s>", "<unk>"]
    return ["".join(rng.choices(parts, k=rng.randint(0, 50))) for _ in range(n)]


def test_piece_codec_matches_library(spark, odd):
    library = SentencePieceProcessor(model_file=vocabulary("piece_bpe_32k.model"))
    made = spark.createDataFrame(list(enumerate(random_texts(3000, 5))), "doc_id long, text string")
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").unionByName(odd.select("doc_id", "text")).unionByName(made)
    want = Counter()
    for d, t in docs.collect():
        ids = library.encode(t or "")
        want[d, tuple(ids), library.decode(ids)] += 1
    got = piece_codec.piece_encode_decode(docs, vocabulary("piece_bpe_32k.model")).collect()
    assert Counter((d, tuple(i), s) for d, i, s in got) == want
    assert piece_codec.piece_encode_decode(odd, vocabulary("piece_bpe_32k.model")).columns == ["doc_id", "ids", "decoded"]
    assert piece_codec.piece_encode_decode(docs.limit(0), vocabulary("piece_bpe_32k.model")).collect() == []


def test_piece_digests(spark):
    library = SentencePieceProcessor(model_file=vocabulary("piece_bpe_32k.model"))
    want = Counter()
    for d, t in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect():
        ids = library.encode(t or "")
        want[d, len(ids), sha(",".join(map(str, ids))), sha(library.decode(ids))] += 1
    assert Counter(map(tuple, queries.op12_piece_codec(spark, SF).collect())) == want


def test_decoding_any_ids_matches_library():
    """Ids in any order: bytes that are no characters, control ids between bytes, unknown ids, marks at the beginning."""
    library, code, rng = SentencePieceProcessor(model_file=vocabulary("piece_bpe_32k.model")), piece_codec.codec(vocabulary("piece_bpe_32k.model")), random.Random(9)
    some = [0, 1, 2, 259, 300, 264, *(3 + b for b in (0xE4, 0xBD, 0xA0, 0xED, 65, 0xF0, 0x9F, 0x98, 0x80, 0xC0))]
    for _ in range(5000):
        ids = [rng.choice([*some, rng.randrange(32_000)]) for _ in range(rng.randint(0, 8))]
        assert code.decode(ids) == library.decode(ids), ids


def test_pair_compatibility_is_the_merge_of_both():
    """The two traces against encoding the joined text of random pairs of pieces."""
    library, code, rng = SentencePieceProcessor(model_file=vocabulary("piece_bpe_32k.model")), piece_codec.codec(vocabulary("piece_bpe_32k.model")), random.Random(3)
    pieces = [i for i in sorted(code.traces) if "▁" not in code.piece[i]]
    seen = Counter()
    for _ in range(20_000):
        a, b = rng.choice(pieces), rng.choice(pieces)
        # a mark and a digit before the pair: digits merge with nothing here
        seen[ok := code.compatible(a, b)] += 1
        assert (library.encode("7" + code.piece[a] + code.piece[b])[2:] == [a, b]) == ok or code.piece[a][0].isdigit()
    assert seen[True] > 1000 and seen[False] > 1000


def plain_alignment(rows):
    """The contract's rows, one occurrence of a token after another."""
    a, b = Tokenizer.from_file(vocabulary("byte_bpe_50k.json")), SentencePieceProcessor(model_file=vocabulary("piece_bpe_32k.model"))
    a.encode_special_tokens = True
    byte_of = {c: i for i, c in enumerate(byte_symbols())}
    bytes_b = lambda i: bytes([int(b.id_to_piece(i)[3:-1], 16)]) if b.is_byte(i) else b.id_to_piece(i).replace("▁", " ").encode()
    docs, counts = [], Counter()
    for doc_id, text in rows:
        whole = " " + (text or "")
        x, y = (a.encode(whole, add_special_tokens=False).ids, b.encode(text)) if text else ([], [])
        side_x = [(i, bytes(byte_of[c] for c in a.id_to_token(i))) for i in x]
        side_y = [(i, bytes_b(i)) for i in y]
        if any(b"".join(s for _, s in side) != whole.encode() for side in (side_x, side_y)):
            docs.append((doc_id, 0, 0, [], []))
            continue
        ends = [dict(zip(np.cumsum([len(s) for _, s in side]).tolist(), range(1, len(side) + 1), strict=True)) for side in (side_x, side_y)]
        groups, links, i, j = [], [], 0, 0
        for end in sorted(ends[0].keys() & ends[1].keys()):
            p, q = ends[0][end], ends[1][end]
            groups.append(",".join(map(str, x[i:p])) + "|" + ",".join(map(str, y[j:q])))
            links.append((x[p - 1], y[q - 1]))
            i, j = p, q
        counts.update(links)
        docs.append((doc_id, len(x), len(y), groups, links))
    best = {}
    for (_, y), n in counts.items():
        best[y] = max(best.get(y, 0), n)
    return Counter((d, n_a, n_b, len(g), len(k), sum(counts[p] == best[p[1]] for p in k), sum(counts[p] for p in k), sha(";".join(g)) if n_a else "") for d, n_a, n_b, g, k in docs)


@pytest.mark.parametrize("hot", [token_alignment.HOT_PAIRS, 40, 0])
def test_alignment_matches_plain_version(spark, odd, hot):
    """All pairs broadcast, some of them, none: the results are the same."""
    made = spark.createDataFrame(list(enumerate(random_texts(500, 11))), "doc_id long, text string")
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").unionByName(odd.select("doc_id", "text")).unionByName(made)
    aligned = token_alignment.align(docs, vocabulary("byte_bpe_50k.json"), vocabulary("piece_bpe_32k.model"))
    aligned = staged(aligned.withColumns({"n_groups": F.col("n_links"), "groups_sha256": token_alignment.digest(F.col("groups"))}), "aligned")
    found = token_alignment.linked(aligned, hot, keep=("n_groups", "groups_sha256"))
    got = found.select("doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256").collect()
    assert Counter(map(tuple, got)) == plain_alignment(docs.collect())


def test_alignment_query(spark):
    rows = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()
    assert Counter(map(tuple, queries.op13_token_alignment(spark, SF).collect())) == plain_alignment(rows)


def test_alignment_of_nothing(spark, odd):
    aligned = staged(token_alignment.align(odd.limit(0), vocabulary("byte_bpe_50k.json"), vocabulary("piece_bpe_32k.model")), "none")
    assert token_alignment.linked(aligned).collect() == []


def test_fast_byte_level_ids_match_library():
    library = Tokenizer.from_file(vocabulary("byte_bpe_50k.json"))
    library.encode_special_tokens = True
    tokens = token_alignment.ByteTokens(vocabulary("byte_bpe_50k.json"))
    texts = random_texts(5000, 2) + [t for t in ODD if t] + [" " * 100_000 + "x", "a" * 100_000, "\n " * 2000]
    assert [tokens.encode(t).tolist() for t in texts] == [library.encode(t, add_special_tokens=False).ids for t in texts]


def test_remembered_windows_change_nothing():
    """A worker that has seen other texts gives the same as one that has seen none."""
    tool, texts = token_alignment.Aligner(vocabulary("byte_bpe_50k.json"), vocabulary("piece_bpe_32k.model")), random_texts(1500, 4)
    plain = lambda text: (*(x := tool.align(text))[:3], x[3].tobytes())
    fresh = []
    for text in texts:
        tool.windows.clear()
        fresh.append(plain(text))
    assert [plain(t) for t in texts] == fresh and [plain(t) for t in reversed(texts)] == fresh[::-1]


def test_a_run_of_texts_is_aligned_as_its_texts_are():
    """Texts without tokens lie between others; groups are written in several parts."""
    tool = token_alignment.Aligner(vocabulary("byte_bpe_50k.json"), vocabulary("piece_bpe_32k.model"))
    texts = ["", *random_texts(300, 5), "a▁b", None, "some words, " * token_alignment.WRITTEN, "▁", "Ünïcode 日本語", ""]
    n_a, n_b, groups, n_links, links = tool.align_all(texts)
    assert not any(x.any() for x in tool.windows.values())  # no marks stay
    for i, (text, own) in enumerate(zip(texts, np.split(links, np.cumsum(n_links)[:-1]), strict=True)):
        alone = tool.align(text)
        assert (n_a[i], n_b[i], groups[i].as_py()) == alone[:3] and np.array_equal(own, alone[3])
        written = [[side.split(",") for side in g.split("|")] for g in alone[2].split(";") if g]
        assert [(int(a[-1]) << 32) | int(b[-1]) for a, b in written] == own.tolist()
        if text and "▁" not in text:
            assert b"".join(tool.a.bytes[int(x)] for a, _ in written for x in a) == b"".join(tool.b.bytes[int(x)] for _, b in written for x in b) == (" " + text).encode()
            assert all(b"".join(tool.a.bytes[int(x)] for x in a) == b"".join(tool.b.bytes[int(x)] for x in b) for a, b in written)
    assert tool.align_all([])[0].tolist() == [] and tool.align_all(["", None])[2].to_pylist() == ["", ""]


def test_manifest_sql_matches_plain_trees(odd):
    """The SQL that stands beside the query, on odd rows and on one source of several levels."""
    import duckdb

    many = [(i, f"Text {i}", "en", "s" if i % 3 else None, 5, "", 0, 0) for i in range(700)]
    for rows in ([tuple(r) for r in odd.collect()], many):
        db = duckdb.connect()
        db.execute("create table documents (doc_id bigint, text varchar, lang varchar, source varchar, n_chars bigint)")
        db.executemany("insert into documents values (?, ?, ?, ?, ?)", [r[:5] for r in rows])
        got = db.execute(f"select doc_id, leaf, subroot, root, proof_sha256, folded_root, verified from ({queries.ORACLE_SQL['op11_merkle_manifest']})").fetchall()
        assert Counter(got) == plain_manifest([(i, s, lang, n, t) for i, t, lang, s, n, *_ in rows])
