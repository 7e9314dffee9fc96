"""Quality classifier: supervised subword embeddings.

A text is the average of learned vectors of its words and of the character n-grams inside them, all hashed into one
table; a softmax over two labels reads the average.  Both are trained by numpy stochastic gradient descent on a
bounded sample of labelled rows.  As the output is linear in the average, scoring needs one number per bucket.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import BROADCAST_IDS, chunks, mix, ship, staged, texts_of

BUCKETS, DIM, GRAMS = 1 << 15, 8, (3, 4)
#: Labelled rows that training may use, at most (its only sample; scoring covers everything).  A row's bag holds at most
#: BUCKETS entries of 6 bytes, a text of 3000 characters about 10 kB.
TRAIN_ROWS = 3000
#: Bytes of their features in the driver, at most; a text has up to 196 kB, most have some 5 kB.
TRAIN_BYTES = 200_000_000
#: Characters of a piece of a long text, about: pieces end at white space, so that no feature is cut.
PIECE = 1 << 18
EPOCHS, BATCH, RATE = 12, 32, 0.4
_GAP = re.compile("[\x20\x09-\x0D]")


@dataclass
class Embeddings:
    vectors: np.ndarray
    weights: np.ndarray
    bias: np.ndarray

    def bucket_logits(self) -> np.ndarray:
        """What each bucket adds to logit(1) - logit(0)."""
        return (self.vectors @ (self.weights[:, 1] - self.weights[:, 0])).astype(np.float32)


def feature_buckets(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Buckets of all features of all texts, and the number of features of each.

    Features: every word, and every run of 3 or 4 characters of a word between boundary marks.  Words end at ASCII
    white space.  Runs over code points, so that any script counts alike.
    """
    padded = [f" {t} " for t in texts]
    code = np.frombuffer("".join(padded).encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)
    size = np.array([len(t) for t in padded], np.int64)
    owner = np.repeat(np.arange(len(texts)), size)
    gap = (code == 32) | ((code >= 9) & (code <= 13))
    code = np.where(gap, np.uint64(32), code)
    key = mix(code + np.uint64(0x51ED27))
    found, whose = [], []
    for n in GRAMS:
        if len(code) < n:
            continue
        h = np.zeros(len(code) - n + 1, np.uint64)
        for k in range(n):
            h = h * np.uint64(0x9E3779B97F4A7C15) + key[k : len(code) - n + 1 + k]
        inner = np.zeros(len(h), bool)
        for k in range(1, n - 1):
            inner |= gap[k : len(h) + k]
        ok = ~inner & (owner[: len(h)] == owner[n - 1 :])
        found.append(mix(h[ok] + np.uint64(n)))
        whose.append(owner[: len(h)][ok])
    # words: prefix sums of a polynomial over code points
    starts = np.flatnonzero(gap[:-1] & ~gap[1:]) + 1
    ends = np.flatnonzero(~gap[:-1] & gap[1:]) + 1
    if len(starts):
        total = np.concatenate((np.zeros(1, np.uint64), np.cumsum(mix(key + _position(starts, ends, len(code))), dtype=np.uint64)))
        found.append(mix(total[ends] - total[starts]))
        whose.append(owner[starts])
    if not found:
        return np.zeros(0, np.int64), np.zeros(len(texts), np.int64)
    h, who = np.concatenate(found), np.concatenate(whose)
    order = np.argsort(who, kind="stable")
    return (h[order] & np.uint64(BUCKETS - 1)).astype(np.int64), np.bincount(who, minlength=len(texts)).astype(np.int64)


def pieces(texts: list[str], size: int = PIECE) -> Iterator[tuple[np.ndarray, list[str]]]:
    """Runs of (row of each part, parts): long texts are cut at white space, and a run has at most about two pieces' size."""
    rows: list[int] = []
    parts: list[str] = []
    held = 0
    for row, text in enumerate(texts):
        start = 0
        while start < len(text) or (not text and start == 0):
            gap = _GAP.search(text, start + size) if len(text) - start > size else None
            stop = gap.end() if gap else len(text)
            rows.append(row)
            parts.append(text[start:stop])
            held += stop - start
            start = stop or 1
            if held >= size:
                yield np.array(rows), parts
                rows, parts, held = [], [], 0
    if parts:
        yield np.array(rows), parts


def bags(texts: list[str]) -> list[tuple[np.ndarray, np.ndarray]]:
    """Distinct buckets and their counts of each text."""
    keys, counts = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
    for rows, parts in pieces(texts):
        ids, n = feature_buckets(parts)
        k, c = np.unique(np.repeat(rows, n) * BUCKETS + ids, return_counts=True)
        keys.append(k)
        counts.append(c)
    key, which = np.unique(np.concatenate(keys), return_inverse=True)
    total = np.bincount(which, np.concatenate(counts), len(key)).astype(np.uint32)
    at = np.searchsorted(key, np.arange(len(texts) + 1) * BUCKETS)
    return [((key[a:b] % BUCKETS).astype(np.uint16), total[a:b]) for a, b in zip(at[:-1], at[1:], strict=True)]


def _position(starts: np.ndarray, ends: np.ndarray, n: int) -> np.ndarray:
    """Place of each character in its word, spread over 64 bits (0 outside words)."""
    step = np.zeros(n + 1, np.int64)
    step[starts] += 1
    step[ends] -= ends - starts
    inside = np.zeros(n + 1, np.int64)
    inside[starts] += 1
    inside[ends] -= 1
    run = np.cumsum(inside)[:n]
    base = np.zeros(n, np.int64)
    base[starts] = starts
    base = np.maximum.accumulate(base)
    return np.where(run > 0, np.arange(n) - base + 1, 0).astype(np.uint64) * np.uint64(0xD1B54A32D192ED03)


def fit(bags: list[tuple[np.ndarray, np.ndarray]], labels: np.ndarray, seed: int = 3) -> Embeddings:
    """Stochastic gradient descent on (distinct buckets, their counts) of each text."""
    rng = np.random.default_rng(seed)
    model = Embeddings(rng.uniform(-1 / DIM, 1 / DIM, (BUCKETS, DIM)), np.zeros((DIM, 2)), np.zeros(2))
    share = np.array([max(1, (labels == c).sum()) for c in (0, 1)], float)
    balance = np.sqrt(share.sum() / 2 / share)  # rarer labels weigh a little more
    steps, done = max(1, EPOCHS * -(-len(bags) // BATCH)), 0
    for _ in range(EPOCHS):
        for some in np.array_split(rng.permutation(len(bags)), max(1, -(-len(bags) // BATCH))):
            rate = RATE * (1 - done / steps)
            done += 1
            index = np.concatenate([bags[i][0] for i in some])
            count = np.concatenate([bags[i][1] / max(1, bags[i][1].sum()) for i in some])
            size = np.array([len(bags[i][0]) for i in some])
            owner = np.repeat(np.arange(len(some)), size)
            hidden = np.stack([np.bincount(owner, model.vectors[index, k] * count, len(some)) for k in range(DIM)], 1)
            logit = hidden @ model.weights + model.bias
            p = np.exp(logit - logit.max(1, keepdims=True))
            p /= p.sum(1, keepdims=True)
            y = labels[some]
            error = (np.eye(2)[y] - p) * balance[y][:, None]
            back = error @ model.weights.T
            model.weights += rate * hidden.T @ error
            model.bias += rate * error.mean(0)
            touched, which = np.unique(index, return_inverse=True)
            for k in range(DIM):
                model.vectors[touched, k] += rate * 20 * np.bincount(which, back[owner, k] * count, len(touched))
    return model


def sample(docs: DataFrame, labelled: DataFrame, rows: int = TRAIN_ROWS, id_col: str = "doc_id", text_col: str = "text", max_bytes: int = TRAIN_BYTES) -> DataFrame:
    """(_id, label, buckets, counts) of at most ``rows`` labelled documents, those with the smallest hashes of their ids, of ``max_bytes`` in all.

    ``labelled`` holds (id, label); rows with a null in either, or a label other than 0 and 1, are left out, and an id
    labelled both ways counts as 0.  Of rows that share a labelled id, the smallest text stands for all.  The sample's
    ids are few, so they are broadcast; features are taken on the executors from whole texts and written.
    """
    ship(docs.sparkSession)
    marks = labelled.toDF("_id", "_label").where("_id is not null and _label in (0, 1)").groupBy("_id").agg(F.min("_label").alias("_label"))
    marks = marks.orderBy(F.xxhash64("_id"), "_id").limit(min(rows, BROADCAST_IDS))
    chosen = docs.select(F.col(id_col).cast("long").alias("_id"), F.col(text_col).cast("string").alias("text")).join(F.broadcast(marks), "_id")
    chosen = chosen.groupBy("_id").agg(F.first("_label").cast("int").alias("label"), F.min("text").alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in chunks(batches, "text"):
            found = bags(texts_of(batch, "text"))
            yield pa.RecordBatch.from_arrays([batch.column("_id"), batch.column("label"), pa.array([b.tobytes() for b, _ in found], pa.binary()), pa.array([c.tobytes() for _, c in found], pa.binary())], ["_id", "label", "buckets", "counts"])

    made = staged(chosen.mapInArrow(run, "_id long, label int, buckets binary, counts binary"), "bags")
    sizes = Window.orderBy(F.xxhash64("_id"), "_id")  # a row per document of the sample
    room = made.select("_id", F.sum(F.octet_length("buckets") + F.octet_length("counts")).over(sizes).alias("held")).where(F.col("held") <= max_bytes).select("_id")
    return made.join(F.broadcast(room), "_id")


def train(docs: DataFrame, labelled: DataFrame, **options) -> Embeddings:
    """Fits on the documents of ``sample``, which takes the same arguments.

    One task holds the sample and fits; the driver gets the model only, a megabyte or two.
    """

    def fitted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        some = [b for b in batches if b.num_rows]
        if some:
            got = pa.Table.from_batches(some)
            order = np.argsort(got.column("_id").to_numpy(), kind="stable").tolist()
            kept = [tuple(np.frombuffer(got.column(c)[i].as_buffer(), kind) for c, kind in (("buckets", np.uint16), ("counts", np.uint32))) for i in order]
            model = fit(kept, got.column("label").to_numpy()[order].astype(np.int64))
            yield pa.RecordBatch.from_arrays([pa.array([x.tobytes()], pa.binary()) for x in (model.vectors, model.weights, model.bias)], ["vectors", "weights", "bias"])

    rows = sample(docs, labelled, **options)
    found = rows.repartition(1).mapInArrow(fitted, "vectors binary, weights binary, bias binary").collect()
    flat = [np.frombuffer(found[0][c], float) if found else None for c in ("vectors", "weights", "bias")]
    return Embeddings(*(np.zeros(shape) if x is None else x.reshape(shape).copy() for x, shape in zip(flat, ((BUCKETS, DIM), (DIM, 2), (2,)), strict=True)))


def quality_scores(docs: DataFrame, model: Embeddings, text_col: str = "text", score: str = "score", predicted: str = "predicted") -> DataFrame:
    """``docs`` with ``score`` (probability of label 1) and ``predicted`` (1 if score >= 0.5).

    A text without features (null, empty) gets the score of the bias alone, 0.5 of an untrained model.  Repeated rows
    are scored each; nulls elsewhere do not matter; columns named like the added ones are replaced; an empty table
    gives an empty result.  Nothing is shuffled; the model (one number per bucket) is broadcast.
    """
    spark = docs.sparkSession
    ship(spark)
    table = spark.sparkContext.broadcast((model.bucket_logits(), float(model.bias[1] - model.bias[0])))
    rest = docs.drop(score, predicted)
    names = rest.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        logits, bias = table.value
        for batch in chunks(batches, text_col):
            sums, size = np.zeros(batch.num_rows), np.zeros(batch.num_rows)
            for rows, parts in pieces(texts_of(batch, text_col)):
                ids, n = feature_buckets(parts)
                sums += np.bincount(np.repeat(rows, n), logits[ids], batch.num_rows)
                size += np.bincount(rows, n, batch.num_rows)
            p = 1 / (1 + np.exp(-np.clip(sums / np.maximum(size, 1) + bias, -30, 30)))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(p, pa.float64()), pa.array((p >= 0.5).astype(np.int32))], [*names, score, predicted])

    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rest.schema)
    return rest.mapInArrow(run, f"{kinds}, {score} double, {predicted} int")


def held_out(id_column: Column) -> Column:
    """True for the third of ids that training never sees."""
    return F.coalesce(F.crc32(id_column.cast("string").cast("binary")) % 3 == 1, F.lit(False))
