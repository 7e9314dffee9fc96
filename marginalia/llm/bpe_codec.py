"""BPE encoding and decoding by tree concatenation.

Texts longer than ``leaf_chars`` are halved until every leaf is short; the leaves are encoded in parallel by Spark
tasks, and neighbours are joined level by level: a window around the join, growing from one chunk a side, is encoded
again until its outermost chunks agree exactly with what both sides already hold.  The same scheme works inside a
worker on pre-tokens too long to merge at once: halves of their symbols are merged side by side and joined by
windows of tokens.  Both are exact.  White space ends every pre-token, so an agreeing chunk shields all text beyond
it; and a token sequence is the BPE encoding of its text if and only if each adjacent pair of tokens is, so windows
whose outermost tokens agree leave no unchecked pair.
"""

from __future__ import annotations

import itertools
import json
import re
import unicodedata
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Generations, chunks, ship, texts_of
from .merging import MergeTable, merge_batch

#: Code points of the largest leaf of a text, and symbols of the largest leaf of a pre-token.
LEAF_CHARS, LEAF_SYMBOLS = 32_768, 48
#: Unicode's White_Space as a character class (fixed values); str.split() would also cut at U+001C..U+001F.
_SPACE = "\t-\r \x85\xa0" + chr(0x1680) + chr(0x2000) + "-" + chr(0x200A) + "".join(map(chr, (0x2028, 0x2029, 0x202F, 0x205F, 0x3000)))
_CHUNK = re.compile(f"[^{_SPACE}]+")
_PRETOKEN = regex.compile(rf"'s|'t|'re|'ve|'m|'ll|'d|\p{{L}}+|\p{{N}}|[^{_SPACE}\p{{L}}\p{{N}}]+")
_ODD_SPACE = re.compile("[\x1c-\x1f]")


def byte_symbols() -> list[str]:
    """The printable character that stands for each byte in byte-level vocabularies."""
    plain = [*range(ord("!"), ord("~") + 1), *range(ord("¡"), ord("¬") + 1), *range(ord("®"), ord("ÿ") + 1)]
    moved = iter(range(256, 512))
    return [chr(b) if b in plain else chr(next(moved)) for b in range(256)]


class WordBpe:
    """A lower-casing byte-level BPE with word ends, read from a tokenizers file."""

    def __init__(self, file: str):
        spec = json.loads(open(file, encoding="utf-8").read())
        model, end = spec["model"], spec["model"]["end_of_word_suffix"]
        vocab = model["vocab"]
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.name = {i: s for s, i in [*vocab.items(), *self.special.items()]}
        self._special = re.compile("(" + "|".join(map(re.escape, self.special)) + ")") if self.special else None
        merges = [m if isinstance(m, list) else m.split(" ") for m in model["merges"]]
        left, right, merged = (np.array([vocab[f(a, b)] for a, b in merges], np.int64) for f in (lambda a, b: a, lambda a, b: b, lambda a, b: a + b))
        self.table = MergeTable(left, right, np.arange(len(merges)), merged, max(self.name) + 1)
        inner = byte_symbols()
        self.inner, self.last = np.array([vocab[c] for c in inner]), np.array([vocab[c + end] for c in inner])
        self.names = [self.name.get(i, "") for i in range(max(self.name) + 1)]
        #: Packed ids and decoded text of white-space chunks.
        self.known = Generations()

    def _merge(self, tokens: list[str]) -> list[tuple[bytes, str]]:
        """Packed ids and decoded text of distinct pre-tokens; long ones by tree concatenation."""
        data = [t.encode("utf-8", "surrogatepass") for t in tokens]
        lengths = np.array([len(d) for d in data], np.int64)
        raw = np.frombuffer(b"".join(data), np.uint8)
        symbols = self.inner[raw]
        stops = np.cumsum(lengths)
        symbols[stops - 1] = self.last[raw[stops - 1]]
        # a long pre-token becomes 2**d leaves; all leaves of the batch merge together
        trees: dict[int, list[tuple[int, int]]] = {}
        for i in np.flatnonzero(lengths > LEAF_SYMBOLS).tolist():
            trees[i] = halves(int(stops[i] - lengths[i]), int(stops[i]), LEAF_SYMBOLS)
        count = np.ones(len(tokens), np.int64)
        for i, parts in trees.items():
            count[i] = len(parts)
        size = np.repeat(lengths, count)
        first = np.concatenate(([0], np.cumsum(count)))
        for i, parts in trees.items():
            size[first[i] : first[i + 1]] = [b - a for a, b in parts]
        out, kept = merge_batch(self.table, symbols, size)
        at = np.concatenate(([0], np.cumsum(kept)))
        ids, packed, names = out.tolist(), out.astype("<u4").tobytes(), self.names
        bounds = at[first].tolist()
        result = [(packed[4 * p : 4 * q], names[ids[p]] if q == p + 1 else " ".join([names[x] for x in ids[p:q]])) for p, q in zip(bounds[:-1], bounds[1:], strict=True)]
        for i, parts in trees.items():
            whole = self._tree([(out[p:q], *part) for part, p, q in zip(parts, at[first[i] : first[i + 1]], at[first[i] + 1 : first[i + 1] + 1], strict=True)], symbols)
            result[i] = (whole.astype("<u4").tobytes(), self.decode(whole))
        return result

    def _tree(self, level: list[tuple[np.ndarray, int, int]], symbols: np.ndarray) -> np.ndarray:
        while len(level) > 1:
            level = [self._join(*level[i : i + 2], symbols) if i + 1 < len(level) else level[i] for i in range(0, len(level), 2)]
        return level[0][0]

    def _width(self, ids: np.ndarray) -> int:
        if not hasattr(self, "_widths"):
            end = len("</w>")
            widths = np.zeros(max(self.name) + 1, np.int64)
            for i, s in self.name.items():
                widths[i] = len(s) - (end if s.endswith("</w>") and len(s) > end else 0)
            self._widths = widths
        return int(self._widths[ids].sum())

    def _join(self, a: tuple, b: tuple, symbols: np.ndarray) -> tuple[np.ndarray, int, int]:
        (x, start, cut), (y, _, stop) = a, b
        k = 2
        while True:
            i, j = max(0, len(x) - k), min(len(y), k)
            lo, hi = (start if i == 0 else cut - self._width(x[i:])), (stop if j == len(y) else cut + self._width(y[:j]))
            w, _ = merge_batch(self.table, symbols[lo:hi], np.array([hi - lo]))
            if (i == 0 or w[0] == x[i]) and (j == len(y) or w[-1] == y[j - 1]):
                return np.concatenate((x[:i], w, y[j:])), start, stop
            k *= 2

    def _learn(self, new: list[str]) -> None:
        """Encodes white-space chunks not seen yet."""
        rows: list[list[str]] = []
        for chunk in new:
            if self._special and "<|" in chunk:
                rows.append([t for piece in self._special.split(chunk) for t in ([piece] if piece in self.special else _pretokens(piece))])
            else:
                rows.append(_pretokens(chunk))
        distinct = list({t for row in rows for t in row} - self.special.keys())
        done = dict(zip(distinct, self._merge(distinct), strict=True)) if distinct else {}
        done |= {name: (np.array([i], "<u4").tobytes(), name) for name, i in self.special.items()}
        for chunk, row in zip(new, rows, strict=True):
            if len(row) == 1:
                self.known[chunk] = done[row[0]]
            else:
                pairs = [done[t] for t in row]
                self.known[chunk] = b"".join([p[0] for p in pairs]), " ".join([p[1] for p in pairs])

    def encode_chunks(self, lists: list[list[str]]) -> None:
        """Makes sure that every chunk of a batch is known."""
        self.known.room()
        new = self.known.unknown(set(itertools.chain.from_iterable(lists)))
        for i in range(0, len(new), 20_000):
            self._learn(new[i : i + 20_000])

    def coded(self, row: list[str]) -> tuple[bytes, str]:
        """Packed ids and decoded text of known chunks."""
        if not row:
            return b"", ""
        ids, texts = zip(*map(self.known.__getitem__, row), strict=True)
        return b"".join(ids), " ".join(texts)

    def decode(self, ids: np.ndarray) -> str:
        return " ".join(self.name[i] for i in ids.tolist())


def halves(start: int, stop: int, leaf: int) -> list[tuple[int, int]]:
    """Leaves of the binary tree over [start, stop): all of one depth, so that neighbours pair up level by level."""
    parts = [(start, stop)]
    while parts and max(b - a for a, b in parts) > leaf:
        parts = [p for a, b in parts for p in ((a, (a + b) // 2), ((a + b) // 2, b))]
    return parts


def _pretokens(piece: str) -> list[str]:
    if not piece.isascii():
        piece = unicodedata.normalize("NFC", piece).replace(chr(0x3A3), chr(0x3C3))  # str.lower() would look at a sigma's place in its word
    return _PRETOKEN.findall(piece.lower())


def split_chunks(text: str) -> list[str]:
    return _CHUNK.findall(text) if _ODD_SPACE.search(text) else text.split()


@lru_cache(maxsize=2)
def codec(file: str) -> WordBpe:
    return WordBpe(file)


def join_texts(code: WordBpe, a: tuple[str, list[tuple[int, int]], list[bytes]], b: tuple[str, list[tuple[int, int]], list[bytes]]) -> tuple[str, list[tuple[int, int]], list[bytes]]:
    """Joins two encoded stretches of text: (text, spans of chunks, ids of chunks)."""
    (s, sa, ia), (t, sb, ib), k = a, b, 1
    shift = len(s)
    moved = [(p + shift, q + shift) for p, q in sb]
    while True:
        i, j = max(0, len(sa) - k), min(len(sb), k)
        lo, hi = (sa[i][0] if sa and i else 0), (sb[j - 1][1] if sb and j < len(sb) else len(t))
        window = s[lo:] + t[:hi]
        spans = [(m.start() + lo, m.end() + lo) for m in _CHUNK.finditer(window)]
        code.encode_chunks([[window[p - lo : q - lo] for p, q in spans]])
        ids = [code.known[window[p - lo : q - lo]][0] for p, q in spans]
        if (not i or (spans and spans[0] == sa[i] and ids[0] == ia[i])) and (j >= len(sb) or (spans and spans[-1] == moved[j - 1] and ids[-1] == ib[j - 1])):
            return s + t, sa[:i] + spans + moved[j:], ia[:i] + ids + ib[j:]
        k *= 2


def bpe_encode_decode(docs: DataFrame, file: str, leaf_chars: int = LEAF_CHARS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, ids, decoded): token ids as packed little-endian unsigned 32-bit integers, and the text they decode to.

    A null or empty text has no ids and decodes to "".  Repeated rows each keep their row; equal long texts are
    encoded once.  Null ids stay null, other columns are ignored, an empty table gives an empty result.
    """
    ship(docs.sparkSession)
    source = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    is_long = F.length("text") > leaf_chars

    def whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        code = codec(file)
        for batch in chunks(batches, "text"):
            lists = [split_chunks(t) for t in texts_of(batch, "text")]
            code.encode_chunks(lists)
            ids, decoded = zip(*map(code.coded, lists), strict=True)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(ids, pa.binary()), pa.array(decoded, pa.string())], ["doc_id", "ids", "decoded"])

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in chunks(batches, "text"):
            rows = [(k, i, t[a:b]) for k, t in zip(batch.column("key").to_pylist(), texts_of(batch, "text"), strict=True) for i, (a, b) in enumerate(halves(0, len(t), leaf_chars))]
            yield pa.RecordBatch.from_arrays([pa.array(x, kind) for x, kind in zip(zip(*rows, strict=True), (pa.string(), pa.int32(), pa.string()), strict=True)], ["key", "leaf", "text"])

    def leaves(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        code = codec(file)
        for batch in chunks(batches, "text"):
            texts = texts_of(batch, "text")
            lists = [split_chunks(t) for t in texts]
            code.encode_chunks(lists)
            ids = [[code.known[c][0] for c in row] for row in lists]
            yield pa.RecordBatch.from_arrays([batch.column("key"), batch.column("leaf"), batch.column("text"), pa.array(ids, pa.list_(pa.binary()))], ["key", "leaf", "text", "ids"])

    def joined(group: pd.DataFrame) -> pd.DataFrame:
        code = codec(file)
        group = group.sort_values("leaf")
        level = [(t, [m.span() for m in _CHUNK.finditer(t)], list(i)) for t, i in zip(group["text"], group["ids"], strict=True)]
        while len(level) > 1:
            level = [join_texts(code, *level[i : i + 2]) if i + 1 < len(level) else level[i] for i in range(0, len(level), 2)]
        ids = b"".join(level[0][2])
        return pd.DataFrame({"key": [group["key"].iloc[0]], "ids": [ids], "decoded": [code.decode(np.frombuffer(ids, "<u4"))]})

    keyed = source.where(is_long).withColumn("key", F.md5("text"))
    parts = keyed.select("key", "text").mapInArrow(cut, "key string, leaf int, text string").groupBy("key", "leaf").agg(F.first("text").alias("text"))
    encoded = parts.mapInArrow(leaves, "key string, leaf int, text string, ids array<binary>").groupBy("key").applyInPandas(joined, "key string, ids binary, decoded string")
    short = source.where(~is_long).mapInArrow(whole, "doc_id long, ids binary, decoded string")
    return short.unionByName(keyed.select("doc_id", "key").join(encoded, "key").select("doc_id", "ids", "decoded"))
