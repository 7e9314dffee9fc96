"""Token counts by rank-synchronous array merging.

Texts are cut before each run of word-start marks; the distinct pre-tokens of a run of rows are held as ragged
arrays of characters and merged together (``merging.merge_batch``): each round, every sequence applies its lowest-rank
pair.  There are two layouts of the same rounds: sequences of up to ``merging.LONG`` symbols lie side by side, a longer
one keeps the places of each rank in arrays of its own, since a round over all of it would cost its length.  A symbol
that survives counts once, or once per UTF-8 byte if the vocabulary lacks it.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Remembered, chunks, ship, texts_of
from .merging import MergeTable, merge_batch

MARK = "▁"
_PRETOKEN = re.compile(f"{MARK}+[^{MARK}]*")


class PieceCounter:
    """Counts of a sentencepiece BPE model with byte fallback, an identity normaliser and a dummy prefix."""

    def __init__(self, model_file: str):
        from sentencepiece import SentencePieceProcessor

        model = SentencePieceProcessor(model_file=model_file)
        special = [model.is_control(i) or model.is_unknown(i) or model.is_byte(i) or model.is_unused(i) for i in range(model.get_piece_size())]
        pieces = {model.id_to_piece(i): i for i in range(model.get_piece_size()) if not special[i]}
        if any(MARK in p.lstrip(MARK) for p in pieces):
            raise ValueError("a piece holds a word start inside; words can't be counted apart")
        scores = sorted({model.get_score(i) for i in pieces.values()}, reverse=True)
        rank_of = {s: r for r, s in enumerate(scores)}
        rows = [(pieces[p[:k]], pieces[p[k:]], rank_of[model.get_score(i)], i) for p, i in pieces.items() for k in range(1, len(p)) if p[:k] in pieces and p[k:] in pieces]
        left, right, rank, merged = (np.array(x, np.int64) for x in zip(*rows, strict=True))
        self.table = MergeTable(left, right, rank, merged, model.get_piece_size())
        self.char_id = {p: i for p, i in pieces.items() if len(p) == 1}
        self.known = Remembered()

    def count_pretokens(self, tokens: list[str]) -> np.ndarray:
        """Tokens of each distinct pre-token."""
        chars = "".join(tokens)
        distinct, which = np.unique(np.frombuffer(chars.encode("utf-32-le", "surrogatepass"), np.uint32), return_inverse=True)
        ids = np.array([self.char_id.get(chr(c), -1 - len(chr(c).encode("utf-8", "surrogatepass"))) for c in distinct], np.int64)
        symbols, lengths = merge_batch(self.table, ids[which], np.array([len(t) for t in tokens], np.int64))
        worth = np.where(symbols >= 0, 1, -symbols - 1)
        ends = np.concatenate(([0], np.cumsum(worth)))
        at = np.concatenate(([0], np.cumsum(lengths)))
        return ends[at[1:]] - ends[at[:-1]]

    def count(self, texts: list[str]) -> list[int]:
        bags = [Counter(_PRETOKEN.findall(MARK + t.replace(" ", MARK))) if t else Counter() for t in texts]
        self.known.room()
        new = list({w for bag in bags for w in bag if w not in self.known})
        # a bounded number of characters is merged at once; a longer pre-token goes alone
        start = 0
        while start < len(new):
            size, end = 0, start
            while end < len(new) and (end == start or size + len(new[end]) <= 1 << 19):
                size += len(new[end])
                end += 1
            for token, n in zip(new[start:end], self.count_pretokens(new[start:end]).tolist(), strict=True):
                self.known[token] = n
            start = end
        known = self.known
        return [sum(known[w] * n for w, n in bag.items()) for bag in bags]


@lru_cache(maxsize=2)
def counter(model_file: str) -> PieceCounter:
    return PieceCounter(model_file)


def token_counts(docs: DataFrame, model_file: str, limit: int = 4096, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_bytes, n_tokens, over_limit) of every row.

    A null or empty text has 0 bytes and 0 tokens.  Rows are independent: repeated rows and null ids stay as they
    are, other columns are ignored, an empty table gives an empty result.  Nothing is shuffled.
    """
    ship(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count = counter(model_file)
        for batch in chunks(batches, "text"):
            texts = texts_of(batch, "text")
            n = count.count(texts)
            size = [len(t.encode("utf-8", "surrogatepass")) for t in texts]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(size, pa.int64()), pa.array(n, pa.int64()), pa.array([x > limit for x in n], pa.bool_())], ["doc_id", "n_bytes", "n_tokens", "over_limit"])

    source = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return source.mapInArrow(run, "doc_id long, n_bytes long, n_tokens long, over_limit boolean")
