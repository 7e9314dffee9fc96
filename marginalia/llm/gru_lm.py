"""Language-model scoring with a gated recurrent network.

Exact word counts of the whole training corpus give the unigram base and the probabilities of rare words.  The network
predicts frequent words and classes of rare ones (by their ending); its output softmax is factored into classes.  It
is trained by truncated backpropagation through every window in numpy: the training texts are dealt by a hash over
rounds and partitions of about as many tokens each; every partition starts from the same weights, runs through its
texts, and the results are averaged by Spark after each round.  A text is scored from its first token to its end, the
state carried across windows.
"""

from __future__ import annotations

import itertools
import math
import string
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import chunks, gathered, keep_memory, ship, staged

#: Hidden units, output classes (each of as many symbols), and how many symbols are endings of rare words.
HIDDEN, CLASSES, ENDINGS = 24, 32, 64
SYMBOLS = CLASSES * CLASSES
#: Frequent words whose counts every worker holds; counts of all others come from a join.
FREQUENT = 1 << 16
#: Tokens of a window, texts side by side, averaging rounds, and step of the optimiser.
WINDOW, LANES, ROUNDS, STEP = 16, 256, 2, 0.004
#: Training tokens of a partition, on average, and of a stretch, at most: longer texts are cut before they are dealt.
PART_TOKENS, STRETCH = 1 << 20, 1 << 10
#: Tasks whose weights one task averages.
FAN_IN = 64
#: Bytes of texts that are split into words at once.
RUN = 1 << 22
FLOOR = 0.1
#: Lower-cases A-Z in UTF-8, and makes a space of U+0009..U+000D.
PLAIN = bytes.maketrans(string.ascii_uppercase.encode() + bytes(range(9, 14)), string.ascii_lowercase.encode() + b" " * 5)
END = "\n"  # no word holds a line end


def ending(word: str) -> int:
    return zlib.crc32(word[-2:].encode("utf-8", "surrogatepass")) % ENDINGS


def ending_of(word: Column) -> Column:
    return (F.crc32(F.right(word, F.lit(2)).cast("binary")) % ENDINGS).cast("int")


def split_words(texts: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """The words of all texts (null: none) in one binary array, A-Z lowered, and the number of words of each text."""
    texts = pc.fill_null(texts, "")
    kind = np.int64 if pa.types.is_large_string(texts.type) else np.int32
    bounds = np.frombuffer(texts.buffers()[1], kind)[texts.offset : texts.offset + len(texts) + 1].astype(np.int64)
    held = texts.buffers()[2]
    raw = np.frombuffer(held[int(bounds[0]) : int(bounds[-1])].to_pybytes().translate(PLAIN) if held else b"", np.uint8)
    bounds -= bounds[0]
    inside = raw != 32
    cut = np.zeros(len(raw) + 1, bool)
    cut[bounds] = True  # words end with their text, too
    begins, ends = cut[:-1].copy(), cut[1:].copy()
    begins[1:] |= ~inside[:-1]
    ends[:-1] |= ~inside[1:]
    first = np.flatnonzero(begins & inside)
    size = np.flatnonzero(ends & inside) + 1 - first
    offsets = np.concatenate(([0], np.cumsum(size))).astype(np.int32)
    words = pa.Array.from_buffers(pa.binary(), len(first), [None, pa.py_buffer(offsets), pa.py_buffer(raw[inside])])
    return words, np.diff(np.searchsorted(first, bounds))


def is_training(id_column: Column) -> Column:
    """Nine tenths of the ids by crc32; rows with a null id are training rows."""
    return F.coalesce(F.crc32(id_column.cast("string").cast("binary")) % 10 != 0, F.lit(True))


def sigmoid(x: np.ndarray) -> np.ndarray:
    """In place; where the exponential overflows, the result is 0."""
    np.negative(x, out=x)
    with np.errstate(over="ignore"):
        np.exp(x, out=x)
    x += 1
    return np.reciprocal(x, out=x)


class Net:
    """Weights and passes of the network; arrays in a fixed order so that they can be averaged.

    Arguments and results have a row for each token.  Gates and the softmax are computed with a column for each token:
    a gate is then one block of memory, and maxima and sums go along many tokens at once.
    """

    SHAPES = {"x": (SYMBOLS + 1, 3 * HIDDEN), "h": (HIDDEN, 3 * HIDDEN), "c": (HIDDEN, CLASSES), "cb": (CLASSES,), "w": (CLASSES, HIDDEN, CLASSES), "wb": (CLASSES, CLASSES)}
    SIZE = sum(map(math.prod, SHAPES.values()))

    def __init__(self, flat: np.ndarray | None = None, frequency: np.ndarray | None = None):
        self.memory = np.zeros(self.SIZE, np.float32)
        self.p = self.views(self.memory)
        if flat is None:
            rng = np.random.default_rng(5)
            for n, s in self.SHAPES.items():
                self.p[n][...] = rng.normal(0, 0.1, s)
            f = frequency.reshape(CLASSES, CLASSES)  # the softmax starts as the unigram distribution
            self.p["cb"][...], self.p["wb"][...] = np.log(f.sum(1)), np.log(f / f.sum(1, keepdims=True))
        else:
            at = 0
            for n, s in self.SHAPES.items():
                self.p[n][...] = flat[at : at + math.prod(s)].reshape(s)
                at += math.prod(s)

    @classmethod
    def views(cls, memory: np.ndarray) -> dict[str, np.ndarray]:
        """A model's arrays, all in one."""
        found, at = {}, 0
        for n, s in cls.SHAPES.items():
            part = memory[at : at + math.prod(s)]
            found[n] = part.reshape(s)
            at += len(part)
        return found

    def flat(self) -> np.ndarray:
        return np.concatenate([self.p[n].ravel() for n in self.SHAPES])

    def step(self, ids: np.ndarray, h: np.ndarray) -> tuple[np.ndarray, tuple]:
        h, k = h.T, 2 * HIDDEN
        a, u = self.p["x"].take(ids, 0).T.copy(), self.p["h"].T @ h
        zr, n = a[:k], a[k:]
        zr += u[:k]
        sigmoid(zr)
        u = u[k:]
        z, r = zr[:HIDDEN], zr[HIDDEN:]
        n += r * u
        np.tanh(n, out=n)
        new = h - n
        new *= z
        new += n
        return new.T, (ids, h, z, r, n, u)

    def outputs(self, h: np.ndarray, target: np.ndarray, grad: dict | None = None) -> tuple[np.ndarray, np.ndarray | None]:
        """Log probability of each target, 0 where it is negative (none); with ``grad``, also gradients (of the sum, added to ``grad``)."""
        cls = target // CLASSES
        # tokens by class, those without a target first: each class reads and writes a slice
        order = np.argsort(cls.astype(np.int16), kind="stable")
        bounds = np.searchsorted(cls[order], np.arange(CLASSES + 1))
        order, bounds = order[bounds[0] :], (bounds - bounds[0]).tolist()
        n, of = len(order), target[order]
        cls, word = of // CLASSES, of % CLASSES
        slices = [(c, slice(i, j)) for c, (i, j) in enumerate(itertools.pairwise(bounds)) if i < j]
        # a last unit that is always 1 takes the biases along
        own = np.ones((n, HIDDEN + 1), h.dtype)
        own[:, :HIDDEN] = h.take(order, 0)
        outer, within = np.concatenate((self.p["c"], self.p["cb"][None])), np.concatenate((self.p["w"], self.p["wb"][:, None]), 1)
        d = outer.T @ own.T
        inner = np.empty_like(d)
        for c, at in slices:
            np.matmul(within[c].T, own[at].T, out=inner[:, at])
        score, back = np.zeros(len(target)), None
        score[order] = self.softmax(d, cls, grad is not None).astype(np.float64) + self.softmax(inner, word, grad is not None)
        if grad is not None:
            found = own.T @ d.T
            grad["c"] += found[:HIDDEN]
            grad["cb"] += found[HIDDEN]
            found = np.zeros_like(within)
            rest = np.empty((n, HIDDEN), d.dtype)
            for c, at in slices:
                part = inner[:, at].T
                np.matmul(own[at].T, part, out=found[c])
                np.matmul(part, self.p["w"][c].T, out=rest[at])
            grad["w"] += found[:, :HIDDEN]
            grad["wb"] += found[:, HIDDEN]
            back = np.zeros((n + 1, HIDDEN), d.dtype)  # the last for tokens without a target
            np.matmul(d.T, self.p["c"].T, out=back[:n])
            back[:n] += rest
            place = np.full(len(target), n)
            place[order] = np.arange(n)
            back = back.take(place, 0)
        return score, back

    @staticmethod
    def softmax(logits: np.ndarray, own: np.ndarray, gradient: bool, beside: int = 1024) -> np.ndarray:
        """Log probability of each token's own row; ``logits`` (a column for each token) become the gradient."""
        score = np.empty(len(own), logits.dtype)
        for i in range(0, len(own), beside):  # so many columns stay in the cache
            d, at = logits[:, i : i + beside], (own[i : i + beside], np.arange(min(beside, len(own) - i)))
            d -= d.max(0)
            mine = d[at]
            np.exp(d, out=d)
            total = d.sum(0)
            mine -= np.log(total)
            score[i : i + beside] = mine
            if gradient:
                d *= 1 / total
                d[at] = np.exp(mine) - 1
        return score

    def backward(self, tape: list[tuple], back: list[np.ndarray], grad: dict) -> None:
        later = 0
        seen, given = [], []
        for (ids, h, z, r, n, u), d in zip(reversed(tape), reversed(back), strict=True):
            d = d.T.copy()
            d += later
            rest = d - d * z
            gates = np.empty((3 * HIDDEN, len(ids)), d.dtype)
            dz, dr, dn = gates[:HIDDEN], gates[HIDDEN : 2 * HIDDEN], rest * (1 - n * n)
            np.multiply(rest * z, h - n, out=dz)
            np.multiply(dn, r, out=gates[2 * HIDDEN :])
            np.multiply(gates[2 * HIDDEN :] * u, 1 - r, out=dr)
            grad["h"] += h @ gates.T
            later = d * z
            later += self.p["h"] @ gates
            seen.append(ids)
            gates[2 * HIDDEN :] = dn
            given.append(gates.T)
        ids, g = np.concatenate(seen), np.concatenate(given, out=np.empty((sum(map(len, seen)), 3 * HIDDEN), d.dtype))
        order = np.argsort(ids.astype(np.int16), kind="stable")
        ids = ids[order]
        first = np.flatnonzero(np.concatenate(([True], ids[1:] != ids[:-1])))
        # sums of pairs of numbers, which take half as many turns
        pairs = g.take(order, 0).view(np.result_type(g.dtype, np.complex64))
        grad["x"][ids[first]] += np.add.reduceat(pairs, first).view(g.dtype)


def stretches(text: np.ndarray) -> Iterator[np.ndarray]:
    """Parts of at most ``STRETCH`` tokens; each is led in by the window before it, whose tokens (as ~token) are no targets."""
    for at in range(0, len(text), STRETCH):
        yield np.concatenate((~text[max(0, at - WINDOW) : at], text[at : at + STRETCH]))


def train_lanes(net: Net, texts: Iterator[np.ndarray]) -> int:
    """Adam on truncated windows: texts run through ``LANES`` lanes to their ends, each state reset where a text starts.

    Where the last texts end, windows are filled up with starts, which are no targets; a step is as long as its window
    has targets, so that every token counts alike however few lanes are left.
    """
    keep_memory()
    m, v, g, some = np.zeros((4, net.SIZE), np.float32)
    grad = net.views(g)
    # a row for each lane, of which ``at`` to ``end`` is to come; a window more than the longest
    lanes = np.full((LANES, STRETCH + 3 * WINDOW), SYMBOLS)
    at, end, span = np.zeros(LANES, np.int64), np.zeros(LANES, np.int64), np.arange(WINDOW + 1)
    state, done, seen, widest, k = np.zeros((LANES, HIDDEN), np.float32), False, 0, 0, 0
    while True:
        for i in () if done else np.flatnonzero(end - at <= WINDOW).tolist():
            while end[i] - at[i] <= WINDOW and (text := next(texts, None)) is not None:
                rest = lanes[i, at[i] : end[i]].copy()
                size = len(rest) + 1 + len(text)
                if size + WINDOW > lanes.shape[1]:
                    lanes = np.pad(lanes, ((0, 0), (0, size + WINDOW - lanes.shape[1])), constant_values=SYMBOLS)
                # SYMBOLS marks the start
                lanes[i, : len(rest)], lanes[i, len(rest)], lanes[i, len(rest) + 1 : size], lanes[i, size : size + WINDOW] = rest, SYMBOLS, text, SYMBOLS
                at[i], end[i] = 0, size
            done = done or end[i] - at[i] <= WINDOW
        live = np.flatnonzero(end - at > 1)
        if not len(live):
            return seen
        block = lanes[live[:, None], at[live, None] + span]
        at[live] += WINDOW
        target = block[:, 1:].T
        target = np.where(target == SYMBOLS, -1, target).ravel()
        targets = int((target >= 0).sum())
        block = np.where(block < 0, ~block, block)
        starts = block == SYMBOLS
        some_start = starts.any(0).tolist()
        h, tape = np.asfortranarray(state[live]), []
        hidden = np.empty((WINDOW, len(live), HIDDEN), np.float32)
        for t in range(WINDOW):
            if some_start[t]:
                h = h.copy(order="F")
                h[starts[:, t]] = 0
            h, kept = net.step(block[:, t], h)
            tape.append(kept)
            hidden[t] = h
        state[live] = h
        if not targets:
            continue
        g[:] = 0
        back = net.outputs(hidden.reshape(-1, HIDDEN), target, grad)[1]
        net.backward(tape, list(back.reshape(WINDOW, len(live), HIDDEN)), grad)
        seen, widest, k = seen + targets, max(widest, targets), k + 1
        rate = STEP * targets / widest * math.sqrt(1 - 0.99**k) / (1 - 0.9**k)
        # all weights in one, and no new memory: they are as many as a window's numbers
        g /= targets
        np.subtract(g, m, out=some)
        some *= 0.1
        m += some
        g *= g
        g -= v
        g *= 0.01
        v += g
        np.sqrt(v, out=some)
        some += 1e-6
        np.divide(m, some, out=some)
        some *= rate
        net.memory -= some


def log_likelihoods(net: Net, texts: list[np.ndarray], beside: int = 1024) -> np.ndarray:
    """Natural log probability of each id sequence; ``beside`` texts of like lengths run side by side, the longest first."""
    keep_memory()
    order = np.argsort([-len(t) for t in texts], kind="stable")
    out = np.zeros(len(texts))
    for i in range(0, len(texts), beside):
        some = order[i : i + beside]
        out[some] = _side_by_side(net, [texts[j] for j in some.tolist()])
    return out


def _side_by_side(net: Net, texts: list[np.ndarray]) -> np.ndarray:
    size = np.array([len(t) for t in texts], np.int64)
    flat, at = np.concatenate(texts), np.cumsum(size) - size
    total = np.zeros(len(texts))
    h = np.zeros((len(texts), HIDDEN), np.float32, order="F")
    before = np.full(len(texts), SYMBOLS)
    hidden, target, who, held = [], [], [], 0
    # texts longer than t, for each t
    live = np.searchsorted(-size, -np.arange(size[0] + 1), side="left").tolist()
    turn = np.arange(len(texts))
    for t, n in enumerate(live):
        if n:
            h = net.step(before[:n], h[:n] if n == len(h) else h[:n].copy(order="F"))[0]
            before = flat[at[:n] + t]
            hidden.append(h)
            target.append(before)
            who.append(turn[:n])
            held += n
        if held > 8192 or (held and not n):  # narrow steps share one pass of the softmax
            score, _ = net.outputs(np.concatenate(hidden, out=np.empty((held, HIDDEN), np.float32)), np.concatenate(target))
            total += np.bincount(np.concatenate(who), score, len(texts))
            hidden, target, who, held = [], [], [], 0
    return total


class Lexicon:
    """Frequent words: symbol (or ending's symbol) and count of each; the rest goes by its ending."""

    def __init__(self, rows: list[tuple[str, int]]):
        self.rows = rows
        self._load()

    def __getstate__(self) -> list[tuple[str, int]]:
        return self.rows

    def __setstate__(self, rows: list[tuple[str, int]]) -> None:
        self.rows = rows
        self._load()

    def _load(self) -> None:
        own = SYMBOLS - ENDINGS
        self.words = pa.array([w.encode("utf-8", "surrogatepass") for w, _ in self.rows], pa.binary())
        self.symbol = np.array([i if i < own else own + ending(w) for i, (w, _) in enumerate(self.rows)] + [0], np.int64)
        self.count = np.array([c for _, c in self.rows] + [0], np.int64)
        self.log = np.log10(self.count + FLOOR)
        self.log[-1] = 0.0
        self.end = [w for w, _ in self.rows].index(END)

    def encode(self, text: str) -> tuple[np.ndarray, np.ndarray, list[str]]:
        """Symbols of the tokens, their places among the frequent words (the last place for others), and the others."""
        symbol, place, _, _, rare = self.encode_all(pa.array([text], pa.string()))
        return symbol, place, rare.cast(pa.string()).to_pylist()

    def encode_all(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, pa.DictionaryArray]:
        """All texts in one: symbols and places (as ``encode``), tokens of each text; where the other words are, and they."""
        words, size = split_words(texts)
        size += 1
        other = len(self.rows)
        found = pc.index_in(words, value_set=self.words)
        rare = words.filter(found.is_null()).dictionary_encode()
        place = np.full(len(words) + len(size), self.end)
        is_word = np.ones(len(place), bool)
        is_word[np.cumsum(size) - 1] = False
        place[is_word] = found.fill_null(other).to_numpy()
        symbol = self.symbol[place]
        at = np.flatnonzero(place == other)
        tails = pc.utf8_slice_codeunits(rare.dictionary.cast(pa.string()), -2).dictionary_encode()  # few
        endings = np.array([ending(w) for w in tails.dictionary.to_pylist()], np.int64)
        symbol[at] = SYMBOLS - ENDINGS + endings[tails.indices.to_numpy()[rare.indices.to_numpy()]]
        return symbol, place, size, at, rare


def score_texts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score) of every row, scores in log10.

    Tokens are words (A-Z lowered) and one end.  A null or empty text is its end alone.  Rows with a null id are
    training rows; repeated rows are scored each, and count as often as they occur.  Without training tokens every
    token is unknown.  Other columns do not matter; an empty table gives an empty result.
    """
    spark = docs.sparkSession
    ship(spark)
    source = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    train = source.where(is_training(F.col("doc_id")))
    counts = staged(word_counts(train), "counts")
    total = counts.agg(F.coalesce(F.sum("c"), F.lit(0)).alias("n"), F.count(F.lit(1)).alias("v")).first()
    n_all, n_distinct = int(total["n"]), int(total["v"])
    frequent = [(r["word"], r["c"]) for r in counts.orderBy(F.desc("c"), "word").limit(FREQUENT).collect()]
    if not any(w == END for w, _ in frequent):
        frequent = [(END, 0), *frequent[: FREQUENT - 1]]
    frequent.sort(key=lambda x: (x[0] != END, -x[1], x[0]))  # the end always has a symbol
    lexicon = Lexicon(frequent)
    own = SYMBOLS - ENDINGS
    # words without a symbol of their own, by ending: counts, and distinct words
    top = spark.createDataFrame(frequent[:own], "word string, c long").select("word")
    tails = {r["e"]: (int(r["n"]), int(r["v"])) for r in counts.join(F.broadcast(top), "word", "left_anti").groupBy(ending_of(F.col("word")).alias("e")).agg(F.sum("c").alias("n"), F.count(F.lit(1)).alias("v")).collect()}
    tail_n, tail_v = ([float(tails.get(e, (0, 0))[i]) for e in range(ENDINGS)] for i in (0, 1))
    tail_log = np.log10(np.array([n + FLOOR * (v + 1) for n, v in zip(tail_n, tail_v, strict=True)]))
    frequency = np.array([c for _, c in frequent[:own]] + [0] * (own - len(frequent[:own])) + tail_n, float) + 1
    shared = spark.sparkContext.broadcast(lexicon)
    tails_of = spark.sparkContext.broadcast(tail_log)

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lex, tail = shared.value, tails_of.value
        for batch in chunks(batches, "text", RUN):
            symbols, place, size, at, unknown = lex.encode_all(batch.column("text"))
            stop = np.cumsum(size)
            first = stop - size  # of each text; all have an end
            logs = lex.log[place]
            in_tail = symbols >= own
            # of words behind an ending's symbol, the frequent ones' counts are known here
            beside = np.where(in_tail, logs - tail[np.maximum(symbols - own, 0)], 0.0)
            n, known, base, within = size, np.add.reduceat((lex.count[place] > 0).astype(np.int64), first), np.add.reduceat(logs, first), np.add.reduceat(beside, first)
            offsets = np.concatenate(([0], 2 * stop)).astype(np.int32)
            packed = pa.Array.from_buffers(pa.binary(), len(size), [None, pa.py_buffer(offsets), pa.py_buffer(symbols.astype(np.int16))])
            # other words of a text, each once
            distinct = max(1, len(unknown.dictionary))
            pair, times = np.unique(np.searchsorted(stop, at, side="right") * distinct + unknown.indices.to_numpy(), return_counts=True)
            starts = pa.array(np.searchsorted(pair, np.arange(len(size) + 1) * distinct), pa.int32())
            rare = pa.MapArray.from_arrays(starts, unknown.dictionary.take(pa.array(pair % distinct)).cast(pa.string()), pa.array(times, pa.int64()))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(n, pa.int64()), pa.array(known, pa.int64()), pa.array(base, pa.float64()), pa.array(within, pa.float64()), packed, rare], ["doc_id", "n_tokens", "n_known", "base", "within", "symbols", "rare"])

    # texts are encoded once; each row gets a number as it is written
    encoded = source.mapInArrow(encode, "doc_id long, n_tokens long, n_known long, base double, within double, symbols binary, rare map<string,long>")
    encoded = staged(encoded.withColumn("row", F.monotonically_increasing_id()), "encoded")
    net, _ = train_network(encoded.where(is_training(F.col("doc_id"))), Net(frequency=frequency / frequency.sum()), n_all)
    weights = spark.sparkContext.broadcast(net.flat())
    kept = ("row", "doc_id", "n_tokens", "n_known", "base", "within")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = Net(weights.value)
        for batch in gathered(batches, "symbols", 1 << 23):  # many texts side by side, so that few steps are narrow
            ids = [np.frombuffer(x, np.int16) for x in batch.column("symbols").to_pylist()]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in kept), pa.array(log_likelihoods(model, ids) / math.log(10), pa.float64())], [*kept, "net"])

    scored = encoded.select(*kept, "symbols").mapInArrow(run, "row long, doc_id long, n_tokens long, n_known long, base double, within double, net double")
    # words beyond the frequent ones get their counts from a join
    pairs = encoded.select("row", F.explode("rare").alias("word", "n")).join(counts, "word", "left")
    pairs = pairs.groupBy("row").agg(F.sum(F.col("n") * F.log10(F.coalesce("c", F.lit(0)) + FLOOR)).alias("rare"), F.sum(F.when(F.col("c").isNotNull(), F.col("n"))).alias("rare_known"))
    both = scored.join(pairs, "row", "left")
    rare = F.coalesce("rare", F.lit(0.0))
    share = math.log10(n_all + FLOOR * (n_distinct + 1))
    return both.select(
        "doc_id",
        (~is_training(F.col("doc_id"))).alias("held_out"),
        "n_tokens",
        (F.col("n_known") + F.coalesce("rare_known", F.lit(0))).alias("n_known"),
        F.lit(n_all).cast("long").alias("train_tokens"),
        (F.col("base") + rare - F.col("n_tokens") * share).alias("base_score"),
        (F.col("net") + F.col("within") + rare).alias("score"),
    )


def word_counts(texts: DataFrame) -> DataFrame:
    """(word, c) of all tokens of ``texts``; a worker hands on the counts of each run of texts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (x for some in gathered(batches, "text", 2 * RUN) for x in chunks([some], "text", 2 * RUN)):
            found = split_words(batch.column("text"))[0].dictionary_encode()
            times = np.bincount(found.indices.to_numpy(), minlength=len(found.dictionary))
            yield pa.RecordBatch.from_arrays([pa.concat_arrays([found.dictionary, pa.array([END.encode()])]).cast(pa.string()), pa.array(np.append(times, batch.num_rows), pa.int64())], ["word", "n"])

    return texts.select("text").mapInArrow(run, "word string, n long").groupBy("word").agg(F.sum("n").alias("c"))


def averaged(local: DataFrame, parts: int) -> DataFrame:
    """The weighted mean of each piece of (piece, weight, values), of which ``parts`` tasks give one each, as a tree.

    A task of a level takes the pieces of ``FAN_IN`` tasks, as they come, into one running mean of the model's size; so
    no group grows with the number of tasks.
    """
    schema = "piece int, weight double, values binary"

    def joined(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        means: dict[int, tuple[float, np.ndarray]] = {}
        for batch in batches:
            for piece, weight, values in zip(*(batch.column(c).to_pylist() for c in ("piece", "weight", "values")), strict=True):
                before, mean = means.get(piece, (0.0, 0.0))
                means[piece] = before + weight, mean + (np.frombuffer(values, np.float64) - mean) * (weight / (before + weight))
        if means:
            found = sorted(means.items())
            yield pa.RecordBatch.from_arrays([pa.array([p for p, _ in found], pa.int32()), pa.array([w for _, (w, _) in found]), pa.array([m.tobytes() for _, (_, m) in found], pa.binary())], ["piece", "weight", "values"])

    while parts > FAN_IN:
        parts = -(-parts // FAN_IN)
        # all pieces of a task go one way, so that each task of the next level has a model's worth of each
        local = local.withColumn("_to", F.pmod(F.spark_partition_id(), F.lit(parts))).repartition(parts, "_to").drop("_to").mapInArrow(joined, schema)

    def average(group: pd.DataFrame) -> pd.DataFrame:
        values = np.stack([np.frombuffer(v, np.float64) for v in group["values"]])
        mean = np.average(values, axis=0, weights=group["weight"].to_numpy())
        return pd.DataFrame({"piece": [group["piece"].iloc[0]], "weight": [group["weight"].sum()], "values": [mean.tobytes()]})

    return local.groupBy("piece").applyInPandas(average, schema)


def train_network(encoded: DataFrame, net: Net, tokens: int, piece: int = 4096) -> tuple[Net, int]:
    """Rounds of local training and averaging on (doc_id, row, symbols).

    Each round takes its share of the texts' stretches, by hash, as does each partition.  Also returns how many tokens
    were learned from, which is every one once.
    """
    learned = 0

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in chunks(batches, "symbols", 1 << 20):
            found = [(d, n, x.tobytes()) for d, t in zip(batch.column("deal").to_pylist(), batch.column("symbols").to_pylist(), strict=True) for n, x in enumerate(stretches(np.frombuffer(t, np.int16)))]
            yield pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(zip(*found, strict=True), (pa.int64(), pa.int32(), pa.binary()), strict=True)], ["deal", "part", "symbols"])

    # copies are dealt by their id, those without one by their row
    dealt = encoded.select(F.xxhash64(F.coalesce("doc_id", "row"), F.xxhash64("symbols")).alias("deal"), "symbols")
    parts = dealt.mapInArrow(cut, "deal long, part int, symbols binary")
    workers = max(1, round(tokens / PART_TOKENS / ROUNDS))
    for r in range(ROUNDS):
        weights = encoded.sparkSession.sparkContext.broadcast(net.flat())

        def run(batches: Iterator[pa.RecordBatch], weights=weights) -> Iterator[pa.RecordBatch]:
            own = Net(weights.value)
            texts = (np.frombuffer(x, np.int16).astype(np.int64) for batch in batches for x in batch.column("symbols").to_pylist())
            if seen := train_lanes(own, texts):
                flat = own.flat().astype(np.float64)
                cells = [flat[i : i + piece] for i in range(0, len(flat), piece)]
                yield pa.RecordBatch.from_arrays([pa.array(range(len(cells)), pa.int32()), pa.array([float(seen)] * len(cells)), pa.array([c.tobytes() for c in cells], pa.binary())], ["piece", "weight", "values"])

        shard = parts.where(F.pmod(F.xxhash64("deal", "part", F.lit("round")), F.lit(ROUNDS)) == r).repartition(workers, "deal", "part").sortWithinPartitions("deal", "part").select("symbols")
        local = shard.mapInArrow(run, "piece int, weight double, values binary")
        rows = averaged(local, workers).collect()  # the model's size
        if rows:
            learned += int(rows[0]["weight"])
            net = Net(np.concatenate([np.frombuffer(x["values"], np.float64) for x in sorted(rows, key=lambda x: x["piece"])]))
    return net, learned
