"""SentencePiece encoding and decoding by a prefix table of merge types.

For every prefix of a text the table holds the last token of the prefix's own encoding.  That token is unique: of the
pieces that an Aho-Corasick automaton finds to end there, exactly one is compatible with the last token of the prefix
before it.  The ids are then recovered backwards, from the table's end.

Why this is the merge order's own result: a token sequence is the BPE encoding of its text if and only if that holds for
each pair of neighbours.  (Up to the first merge across a token boundary, both neighbours change just as they would
alone, so that merge would happen in the pair, too.)  A pair is tested without merging its text anew: every piece keeps
its *trace*, the ranks of its merges in order and the symbols at its two ends after each; two traces are run side by
side, and the pair is compatible if no symbol at the join ever merges first.

Texts are cut before each run of word-start marks, which no piece crosses; the tables of the distinct words of a run of
rows are remembered by the worker.  A word may be as long as the text: the table is linear in it.
"""

from __future__ import annotations

import codecs
import itertools
import re
from array import array
from collections.abc import Iterator
from functools import lru_cache

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Remembered, chunks, ship, texts_of

MARK = "▁"
_WORD = re.compile(f"{MARK}+[^{MARK}]*")
#: Rank of what never merges.
NEVER = 1 << 40
#: Pairs whose compatibility a worker remembers; it starts afresh above.
PAIRS = 1 << 18


class Words(Remembered):
    """Words and their packed ids: about 400,000 entries at most."""

    BYTES, ENTRY = 1 << 26, 160


codecs.register_error("each_byte", lambda e: ("�", e.start + 1))


class PieceCodec:
    """A sentencepiece BPE model with byte fallback, an identity normaliser and a dummy prefix."""

    def __init__(self, model_file: str):
        from sentencepiece import SentencePieceProcessor

        model = SentencePieceProcessor(model_file=model_file)
        self.size = n = model.get_piece_size()
        byte_of = {i: int(model.id_to_piece(i)[3:-1], 16) for i in range(n) if model.is_byte(i)}
        self.byte_id = [i for i, _ in sorted(byte_of.items(), key=lambda x: x[1])]
        self.silent = {i for i in range(n) if model.is_control(i)}
        self.piece = [model.id_to_piece(i) for i in range(n)]
        plain = [i for i in range(n) if i not in byte_of and i not in self.silent and i != model.unk_id() and not model.is_unused(i)]
        if len(self.byte_id) != 256:
            raise ValueError("the model has no byte fallback")
        if any(MARK in self.piece[i].lstrip(MARK) for i in plain):
            raise ValueError("a piece holds a word start inside; words can't be encoded apart")
        order = {s: r for r, s in enumerate(sorted({model.get_score(i) for i in plain}, reverse=True))}
        self.rank = {self.piece[i]: order[model.get_score(i)] for i in plain}
        #: Traces of the pieces that merging their characters makes; only these are ever the last token of a prefix.
        self.traces = {i: t for i in plain if (t := self._trace(self.piece[i])) is not None}
        self._fits: dict[int, bool] = {}
        self.automaton = ahocorasick.Automaton()
        for i in self.traces:
            self.automaton.add_word(self.piece[i], (i, len(self.piece[i])))
        self.automaton.make_automaton()
        self.starts_marked = {i for i in plain if self.piece[i].startswith(MARK)}
        # a byte above 127 stands as the surrogate that "surrogateescape" turns into that byte again
        self.name = ["" if i in self.silent else chr(b if b < 128 else 0xDC00 + b) if (b := byte_of.get(i)) is not None else " ⁇ " if i == model.unk_id() else self.piece[i].replace(MARK, " ") for i in range(n)]
        #: Packed ids (little-endian 32-bit) of words.
        self.ids_of = Words()

    def _trace(self, piece: str) -> tuple[list[int], list[str], list[str]] | None:
        """Ranks of the merges that make ``piece``, and its first and last symbol before, between and after them."""
        symbols, ranks = list(piece), []
        firsts, lasts = [symbols[0]], [symbols[-1]]
        while len(symbols) > 1:
            rank, at = min((self.rank.get(a + b, NEVER), i) for i, (a, b) in enumerate(itertools.pairwise(symbols)))
            if rank == NEVER:
                return None
            symbols[at : at + 2] = [symbols[at] + symbols[at + 1]]
            ranks.append(rank)
            firsts.append(symbols[0])
            lasts.append(symbols[-1])
        return [*ranks, NEVER], firsts, lasts

    def compatible(self, left: int, right: int) -> bool:
        """Whether the encoding of two pieces' joined text is these two pieces."""
        key = left * self.size + right
        known = self._fits.get(key)
        if known is None:
            if len(self._fits) >= PAIRS:
                self._fits.clear()
            known = self._fits[key] = self._run(self.traces[left], self.traces[right])
        return known

    def _run(self, a: tuple[list[int], list[str], list[str]], b: tuple[list[int], list[str], list[str]]) -> bool:
        (left_ranks, _, lasts), (right_ranks, firsts, _) = a, b
        i = j = 0
        while True:
            across, left, right = self.rank.get(lasts[i] + firsts[j], NEVER), left_ranks[i], right_ranks[j]
            # the lowest rank merges first; of equal ranks the leftmost: inside left, across, inside right
            if across < left and across <= right:
                return False
            if left == right == NEVER:
                return True
            if left <= right:
                i += 1
            else:
                j += 1

    def prefix_table(self, word: str) -> list[int]:
        """The last token of each prefix of ``word``: an id, or -1 for a character without a piece.

        Such a character is never merged, so that it is compatible with all neighbours.  Entry 0 is no token.
        """
        table, fits, size = [-1] * (len(word) + 1), self._fits.get, self.size
        for last, (i, length) in self.automaton.iter(word):
            if table[last + 1] < 0:
                start = last + 1 - length
                before = table[start] if start else -1
                if before < 0:
                    table[last + 1] = i
                else:
                    ok = fits(before * size + i)
                    if ok or (ok is None and self.compatible(before, i)):
                        table[last + 1] = i
        return table

    def recover(self, word: str) -> list[int]:
        """Ids of a word, read backwards from its prefix table."""
        table, at, out = self.prefix_table(word), len(word), []
        while at:
            i = table[at]
            if i < 0:
                out.extend(self.byte_id[b] for b in reversed(word[at - 1].encode("utf-8", "surrogatepass")))
                at -= 1
            else:
                out.append(i)
                at -= len(self.piece[i])
        out.reverse()
        return out

    def decode(self, ids: list[int]) -> str:
        """Text of ids as the library gives it: the dummy prefix, a mark that begins the text, is dropped; bytes that are no UTF-8 become U+FFFD each."""
        if self.silent.isdisjoint(ids):
            text = self._text(ids)
        else:  # what says nothing still ends a run of bytes
            text = "".join(self._text(list(run)) for _, run in itertools.groupby(ids, self.silent.__contains__))
        head = next((i for i in ids if i not in self.silent), None)
        return text[1:] if head in self.starts_marked else text

    def _text(self, ids: list[int]) -> str:
        text = "".join(map(self.name.__getitem__, ids))
        return text if text.isascii() else text.encode("utf-8", "surrogateescape").decode("utf-8", "each_byte")

    def encode_packed(self, rows: list[list[str]]) -> list[bytes]:
        """Packed ids of texts given as words (``split_words``)."""
        self.ids_of.room()
        for word in set(itertools.chain.from_iterable(rows)).difference(self.ids_of):
            self.ids_of[word] = array("i", self.recover(word)).tobytes()
        return [b"".join(map(self.ids_of.__getitem__, row)) for row in rows]


def split_words(text: str) -> list[str]:
    """A text's words with their marks; the dummy prefix comes first."""
    return _WORD.findall(MARK + text.replace(" ", MARK)) if text else []


@lru_cache(maxsize=2)
def codec(model_file: str) -> PieceCodec:
    return PieceCodec(model_file)


def lists_of(packed: list[bytes]) -> pa.ListArray:
    """Packed 32-bit integers as an Arrow list column."""
    offsets = np.concatenate(([0], np.cumsum([len(p) // 4 for p in packed]))).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.frombuffer(b"".join(packed), "<i4")))


def piece_encode_decode(docs: DataFrame, model_file: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, ids, decoded): the ids of every whole text, and the text that these ids decode to.

    A null or empty text has no ids and decodes to "".  A mark (U+2581) in a text is a space, as for the library.  Rows
    are independent: repeated rows and null ids stay as they are, other columns are ignored, an empty table gives an
    empty result.  Nothing is shuffled; texts are read in runs of half a megabyte (one text at least).
    """
    ship(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        code = codec(model_file)
        for batch in chunks(batches, "text"):
            rows = [split_words(t) for t in texts_of(batch, "text")]
            packed = code.encode_packed(rows)
            decoded = pa.array([code.decode(memoryview(p).cast("i").tolist()) for p in packed], pa.string())
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), lists_of(packed), decoded], ["doc_id", "ids", "decoded"])

    source = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return source.mapInArrow(run, "doc_id long, ids array<int>, decoded string")
