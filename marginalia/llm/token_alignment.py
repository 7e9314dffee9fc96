"""Alignment of two tokenizers by whitespace-token anchors, and counts of aligned token pairs over the corpus.

Each text is tokenised in full by both tokenizers.  Tokens carry their bytes, so every token has a byte range of the same
text.  Where a space-marked token begins in both at one offset (and all before it ends there: a verified shared end),
the text is cut: between two such anchors lies a window of tokens of either side.  A window with one token of either side is
one group; only in the others the ends of both sides are compared.  A run of texts is aligned as one array.

Pair counts need all of the corpus, a text's own figures need the counts of its pairs.  Texts are aligned once and
written (``aligned``: distinct pairs of a text and how often it has them); counts are summed by Spark; the frequent pairs,
at most ``hot_pairs`` of them, are broadcast, and the others, rare by their count, are joined in a shuffle.
"""

from __future__ import annotations

import itertools
import json
import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .bpe_codec import byte_symbols
from .common import chunks, keep_memory, ship, staged, texts_of

MARK = "▁"
#: Splits of the byte-level vocabulary's texts (a fixed value).
_SPLIT = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: A run of white space that the fast library's stack may not bear; texts that hold one take the other library.
_WIDE = re.compile(r"\s{512}")
#: Pairs whose counts are broadcast: 16 bytes and a flag each, 9 MB.
HOT_PAIRS = 1 << 19
#: Tokens whose decimals are written at once.
WRITTEN = 1 << 15


class ByteTokens:
    """Byte-level BPE of a tokenizers file: ids of texts, and the bytes of each id.

    The merges' order is the ids' order, so that tiktoken gives the same ids from the same file, in a third of the time.
    """

    def __init__(self, file: str):
        import tiktoken
        from tokenizers import Tokenizer

        spec = json.loads(open(file, encoding="utf-8").read())
        vocab = spec["model"]["vocab"]
        made = [vocab[m if isinstance(m, str) else "".join(m)] if not isinstance(m, str) else vocab[m.replace(" ", "", 1)] for m in spec["model"]["merges"]]
        if made != sorted(made):
            raise ValueError("ids do not follow the merges' order")
        byte_of = {c: b for b, c in enumerate(byte_symbols())}
        self.bytes = [b""] * (max([*vocab.values(), *(t["id"] for t in spec["added_tokens"])]) + 1)
        for token, i in vocab.items():
            self.bytes[i] = bytes(byte_of[c] for c in token)
        self.fast = tiktoken.Encoding("byte-level", pat_str=_SPLIT, mergeable_ranks={b: i for i, b in enumerate(self.bytes) if b}, special_tokens={})
        self.other = Tokenizer.from_file(file)
        self.other.encode_special_tokens = True  # their strings in a text are ordinary text

    def encode(self, text: str) -> np.ndarray:
        if _WIDE.search(text):
            return np.array(self.other.encode(text, add_special_tokens=False).ids, np.int32)
        return self.fast.encode_to_numpy(text, disallowed_special=()).astype(np.int32)


class PieceTokens:
    """A sentencepiece model: ids of texts, and the bytes of each id (a mark is a space)."""

    def __init__(self, file: str):
        from sentencepiece import SentencePieceProcessor

        self.model = SentencePieceProcessor(model_file=file)
        pieces = [self.model.id_to_piece(i) for i in range(self.model.get_piece_size())]
        self.bytes = [bytes([int(p[3:-1], 16)]) if self.model.is_byte(i) else b"" if self.model.is_control(i) else p.replace(MARK, " ").encode("utf-8") for i, p in enumerate(pieces)]

    def encode(self, text: str) -> list[int]:
        return self.model.encode(text)


class Aligner:
    def __init__(self, byte_file: str, piece_file: str):
        self.a, self.b = ByteTokens(byte_file), PieceTokens(piece_file)
        self.size_a, self.size_b = (np.array([len(x) for x in t.bytes], np.int64) for t in (self.a, self.b))
        self.space_a, self.space_b = (np.array([x[:1] == b" " for x in t.bytes]) for t in (self.a, self.b))
        # each id's decimals, in the low bytes of a number; seven at most, and a separator
        names = [str(i).encode() for i in range(max(len(self.size_a), len(self.size_b)))]
        self.digits, self.width = np.array([int.from_bytes(x, "little") for x in names], np.uint64), np.array([len(x) for x in names], np.uint8)
        #: Marks of a run's offsets, all zero between runs, so that their memory serves the next run.
        self.windows: dict[str, np.ndarray] = {}

    def align(self, text: str) -> tuple[int, int, str, np.ndarray]:
        """(tokens of a, tokens of b, groups, links) of one text; see ``align_all``."""
        n_a, n_b, groups, _, links = self.align_all([text])
        return int(n_a[0]), int(n_b[0]), groups[0].as_py(), links

    def align_all(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray, pa.Array, np.ndarray, np.ndarray]:
        """Tokens of a and of b, groups, and number of links of each text, and all links; nothing where b's bytes are not the text.

        A link is a pair (a << 32 | b) of tokens that end together.
        """
        ids_a, ids_b, size = [np.zeros(0, np.int32)], [], []
        for text in texts:
            x, y, data = ids_a[0], [], b""
            if text:
                whole = " " + text
                data, y = whole.encode("utf-8", "surrogatepass"), self.b.encode(text)
                if b"".join(map(self.b.bytes.__getitem__, y)) == data:
                    x = self.a.encode(whole)
                else:
                    y, data = [], b""
            ids_a.append(x)
            ids_b.append(y)
            size.append(len(data))
        n_a, n_b = (np.fromiter(map(len, x), np.int64, len(texts)) for x in (ids_a[1:], ids_b))
        a, b = np.concatenate(ids_a), np.fromiter(itertools.chain.from_iterable(ids_b), np.int32, int(n_b.sum()))
        size_a, size_b = self.size_a[a], self.size_b[b]
        ends_a, ends_b = np.cumsum(size_a), np.cumsum(size_b)
        if not np.array_equal(np.append(0, ends_a)[np.cumsum(n_a)], np.cumsum(size)):  # bytes have tokens of their own, so that side a spells every text
            raise AssertionError("byte-level tokens do not cover their text")
        to_a, to_b = self._shared_ends(a, b, size_a, size_b, ends_a, ends_b)
        links = (a[to_a].astype(np.int64) << 32) | b[to_b]
        n_links = np.diff(np.searchsorted(to_a, np.append(0, np.cumsum(n_a))))
        return n_a, n_b, self._groups(a, b, to_a, to_b, n_a + n_b), n_links, links

    def _shared_ends(self, a: np.ndarray, b: np.ndarray, size_a: np.ndarray, size_b: np.ndarray, ends_a: np.ndarray, ends_b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The tokens, of either side, that end where a token of the other ends."""
        if not len(a):
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        marks = self.windows.get("marks")
        if marks is None or len(marks) <= ends_a[-1]:
            marks = self.windows["marks"] = np.zeros(ends_a[-1] + 1, np.uint8)

        def both(x: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
            """Which of either side's offsets the other has, too."""
            marks[x] = 1
            marks[y] |= 2
            found = marks[x] == 3, marks[y] == 3
            marks[x] = marks[y] = 0
            return found

        # anchors: space-marked tokens that begin together; a text begins with one
        first_a, first_b = np.flatnonzero(self.space_a[a]), np.flatnonzero(self.space_b[b])
        hit_a, hit_b = both((ends_a - size_a)[first_a], (ends_b - size_b)[first_b])
        stop_a, stop_b = np.append(first_a[hit_a][1:], len(a)), np.append(first_b[hit_b][1:], len(b))
        wide_a, wide_b = np.diff(stop_a, prepend=0), np.diff(stop_b, prepend=0)
        # windows of several tokens on both sides may have more shared ends than their own
        several = (wide_a > 1) & (wide_b > 1)
        in_a, in_b = np.flatnonzero(np.repeat(several, wide_a)), np.flatnonzero(np.repeat(several, wide_b))
        hit_a, hit_b = both(ends_a[in_a], ends_b[in_b])
        found = []
        for n, stop, hits in ((len(a), stop_a, in_a[hit_a]), (len(b), stop_b, in_b[hit_b])):
            last = np.zeros(n, bool)
            last[stop - 1] = last[hits] = True
            found.append(np.flatnonzero(last))
        return found[0], found[1]

    def _groups(self, a: np.ndarray, b: np.ndarray, to_a: np.ndarray, to_b: np.ndarray, tokens: np.ndarray) -> pa.Array:
        """Each text's groups, written out, where ``tokens`` are a text's tokens of both sides."""
        at_a = np.arange(len(a)) + np.repeat(np.append(0, to_b + 1)[:-1], np.diff(to_a, prepend=-1))
        at_b = np.arange(len(b)) + np.repeat(to_a + 1, np.diff(to_b, prepend=-1))
        ids, mark = np.empty(len(a) + len(b), np.int32), np.full(len(a) + len(b), ord(","), np.uint8)
        ids[at_a], ids[at_b] = a, b
        mark[at_a[to_a]], mark[at_b[to_b]] = ord("|"), ord(";")
        stop = np.cumsum(tokens)
        mark[stop[tokens > 0] - 1] = 0  # nothing follows a text's last token
        kept = np.arange(8) < np.arange(9)[:, None]
        parts, lengths = [], [np.zeros(1, np.int64)]
        for i in range(0, len(ids), WRITTEN):
            some, follow = ids[i : i + WRITTEN], mark[i : i + WRITTEN]
            width = self.width[some]
            chars = self.digits[some] | (follow.astype(np.uint64) << (8 * width.astype(np.uint64)))
            width += follow > 0
            parts.append(chars.astype("<u8").view(np.uint8).reshape(-1, 8)[kept[width]])
            lengths.append(width.astype(np.int64))
        offsets = np.cumsum(np.concatenate(lengths))[np.append(0, stop)].astype(np.int32)
        return pa.Array.from_buffers(pa.string(), len(tokens), [None, pa.py_buffer(offsets), pa.py_buffer(np.concatenate([np.zeros(0, np.uint8), *parts]))])


@lru_cache(maxsize=2)
def aligner(byte_file: str, piece_file: str) -> Aligner:
    return Aligner(byte_file, piece_file)


def align(docs: DataFrame, byte_file: str, piece_file: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_a, n_b, n_links, groups, a, b, times) of every row: its groups as text, and its distinct linked pairs.

    A text is encoded with a space before it by the byte-level tokenizer and as it is by the other, which adds the space.
    Texts that are null or empty, or whose tokens do not spell them (they hold U+2581), have no tokens: zeros, "" and
    empty arrays.  Each group ends at an offset where both sides' tokens end, and links its last two tokens.  Rows are
    independent: repeated rows and null ids stay, other columns are ignored.  Nothing is shuffled.
    """
    ship(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tool = aligner(byte_file, piece_file)
        keep_memory()
        for batch in chunks(batches, "text"):
            n_a, n_b, groups, n_links, links = tool.align_all(texts_of(batch, "text"))
            # a text's pairs, each once
            side = len(tool.size_b)
            square = len(tool.size_a) * side
            code, times = np.unique(np.repeat(np.arange(len(n_links)) * square, n_links) + (links >> 32) * side + (links & 0xFFFFFFFF), return_counts=True)
            offsets = pa.array(np.searchsorted(code, np.arange(len(n_links) + 1) * square), pa.int32())
            code %= square
            lists = [pa.ListArray.from_arrays(offsets, pa.array(x.astype(np.int32))) for x in (code // side, code % side, times)]
            counts = [pa.array(x, pa.int64()) for x in (n_a, n_b, n_links)]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *counts, groups, *lists], ["doc_id", "n_a", "n_b", "n_links", "groups", "a", "b", "times"])

    source = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return source.mapInArrow(run, "doc_id long, n_a long, n_b long, n_links long, groups string, a array<int>, b array<int>, times array<int>")


def _codes(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Pairs of a batch as one number each, their times, and each row's number of pairs."""
    a, b, times = (batch.column(c).flatten().to_numpy(zero_copy_only=False).astype(np.int64) for c in ("a", "b", "times"))
    return (a << 32) | b, times, np.diff(batch.column("a").offsets.to_numpy())


def pair_counts(aligned: DataFrame) -> DataFrame:
    """(pair, count, best): corpus-wide counts of linked pairs (a << 32 | b); ``best`` if no pair of that b counts more.

    Tasks add up what they read before anything is shuffled; a row of the result is a pair of ids, so there are no more
    than the vocabularies allow.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept, size = [], 0

        def added() -> pa.RecordBatch:
            pair, at = np.unique(np.concatenate([p for p, _ in kept]), return_inverse=True)
            count = np.bincount(at, weights=np.concatenate([t for _, t in kept]), minlength=len(pair)).astype(np.int64)
            return pa.RecordBatch.from_arrays([pa.array(pair), pa.array(count)], ["pair", "count"])

        for batch in batches:
            code, times, _ = _codes(batch)
            kept.append((code, times))
            size += len(code)
            if size > 1 << 21:
                yield added()
                kept, size = [], 0
        if kept:
            yield added()

    counts = aligned.select("a", "b", "times").mapInArrow(run, "pair long, count long").groupBy("pair").agg(F.sum("count").alias("count"))
    counts = staged(counts, "pairs")
    top = counts.groupBy((F.col("pair").bitwiseAND(F.lit(0xFFFFFFFF))).alias("b")).agg(F.max("count").alias("top"))  # a row per id of b
    return counts.join(F.broadcast(top), F.col("pair").bitwiseAND(F.lit(0xFFFFFFFF)) == F.col("b")).select("pair", "count", (F.col("count") == F.col("top")).alias("best"))


def hot_count(counts: DataFrame, most: int) -> int:
    """The least power of two that at most ``most`` pairs reach."""
    steps = counts.groupBy(F.length(F.bin("count")).alias("bits")).count().collect()  # 63 rows at most
    left, least = most, 1
    for bits, n in sorted(((r["bits"], r["count"]) for r in steps), reverse=True):
        left -= n
        if left < 0:
            least = 1 << bits
            break
    return least


def linked(aligned: DataFrame, hot_pairs: int = HOT_PAIRS, keep: tuple[str, ...] = ()) -> DataFrame:
    """(doc_id, n_a, n_b, n_links, n_best, count_sum, and ``keep``) of every row of ``aligned``, which must be written.

    ``n_best``: links of the row whose pair is, over all rows, the most frequent of its b (ties too); ``count_sum``: the
    pairs' corpus-wide counts, summed over the row's links.
    """
    spark = aligned.sparkSession
    counts = staged(pair_counts(aligned), "counts")
    least = hot_count(counts, hot_pairs)
    hot = counts.where(F.col("count") >= least).toArrow()  # hot_pairs rows at most
    pair = hot.column("pair").to_numpy().astype(np.int64)
    order = np.argsort(pair)
    table = spark.sparkContext.broadcast((pair[order], hot.column("count").to_numpy().astype(np.int64)[order], hot.column("best").to_numpy().astype(bool)[order]))
    head = ["row", "doc_id", "n_a", "n_b", "n_links", *keep]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pairs, count, best = table.value
        for batch in batches:
            code, times, size = _codes(batch)
            at = np.minimum(np.searchsorted(pairs, code), max(0, len(pairs) - 1))
            hit = pairs[at] == code if len(pairs) else np.zeros(len(code), bool)
            row = np.repeat(np.arange(batch.num_rows), size)
            sums = np.zeros((2, batch.num_rows), np.int64)
            np.add.at(sums[0], row[hit], times[hit] * best[at[hit]])
            np.add.at(sums[1], row[hit], times[hit] * count[at[hit]])
            offsets = pa.array(np.concatenate(([0], np.cumsum(np.bincount(row[~hit], minlength=batch.num_rows)))).astype(np.int32))
            rest = [pa.ListArray.from_arrays(offsets, pa.array(x[~hit])) for x in (code, times)]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in head), pa.array(sums[0]), pa.array(sums[1]), *rest], [*head, "n_best", "count_sum", "rest", "rest_times"])

    kinds = {f.name: f.dataType.simpleString() for f in aligned.schema}
    schema = "row long, " + ", ".join(f"{c} {kinds[c]}" for c in head[1:]) + ", n_best long, count_sum long, rest array<long>, rest_times array<long>"
    rows = aligned.withColumn("row", F.monotonically_increasing_id()).select(*head, "a", "b", "times")
    scored = staged(rows.mapInArrow(run, schema), "scored")
    rare = scored.select("row", F.explode(F.arrays_zip("rest", "rest_times")).alias("x")).select("row", F.col("x.rest").alias("pair"), F.col("x.rest_times").alias("times"))
    found = rare.join(counts.where(F.col("count") < least), "pair").groupBy("row")
    found = found.agg(F.sum(F.when(F.col("best"), F.col("times")).otherwise(0)).alias("more_best"), F.sum(F.col("times") * F.col("count")).alias("more"))
    plus = lambda a, b: (F.col(a) + F.coalesce(F.col(b), F.lit(0))).alias(a)
    return scored.drop("rest", "rest_times").join(found, "row", "left").select(*head[1:], plus("n_best", "more_best"), plus("count_sum", "more"))


def digest(groups: Column) -> Column:
    """Hash of the groups' text; "" without tokens."""
    return F.when(groups == "", F.lit("")).otherwise(F.sha2(groups, 256))
