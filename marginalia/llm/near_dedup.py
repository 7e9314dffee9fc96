"""MinHash near-dedup with SetSketch registers.

A text's shingle set gives ``registers`` minima of seeded hashes, read as exponential variates and truncated to
exponentially spaced levels: mergeable by maximum, and equal with a probability that grows with the similarity.
Bands of registers name buckets; members of a bucket are candidates.  A candidate pair's similarity is first estimated
jointly by likelihood from both sketches, then confirmed on the full sets.

Equal sets are one class throughout.  A bucket of n classes gives n - 1 candidates (each with the bucket's first
class); what is still apart after these is compared within the bucket in blocks, so that no link is lost and no list
of all pairs of a group exists.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import chunks, if_small, mix, ship, staged, texts_of, with_ids, word_hashes

#: Registers, and registers of a band: a pair at 0.8 escapes all bands with probability (1 - 0.8**5)**57 = 2e-10, one at
#: 0.2 (texts that share a passage) meets in a band with 2 %.
REGISTERS, ROWS = 285, 5
#: Ratio of neighbouring levels, number of levels and rate of the sketch.
BASE, LEVELS, RATE = 1.001, (1 << 16) - 2, 20.0
#: Members, and bytes of their texts, of a block when the rest of a bucket is compared; and members of a bucket whose few
#: pairs are listed instead.
BLOCK, BLOCK_BYTES, SMALL = 128, 1 << 21, 16


def shingle_sets(texts: list[str], words: int) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct 64-bit shingle hashes of all texts, one after the other, and how many each text has."""
    hashes, n = word_hashes(texts)
    owner = np.repeat(np.arange(len(texts)), n)
    place = np.arange(len(hashes)) - np.repeat(np.cumsum(n) - n, n)
    full = np.flatnonzero(place <= n[owner] - words)
    first = np.flatnonzero((place == 0) & (n[owner] < words))
    acc = np.zeros(len(hashes), np.uint64)
    for k in range(words):
        at = np.concatenate((full, first[n[owner[first]] > k]))
        acc[at] = mix(acc[at] * np.uint64(0x9E3779B97F4A7C15) + hashes[at + k] + np.uint64(k + 1))
    at = np.concatenate((full, first))
    values, who = acc[at], owner[at]
    order = np.lexsort((values, who))
    values, who = values[order], who[order]
    fresh = np.ones(len(values), bool)
    fresh[1:] = (values[1:] != values[:-1]) | (who[1:] != who[:-1])
    return values[fresh], np.bincount(who[fresh], minlength=len(texts)).astype(np.int64)


def sketch(values: np.ndarray, counts: np.ndarray, registers: int) -> np.ndarray:
    """SetSketch registers (unsigned 16 bits) of ragged sets; a row for each set that has elements."""
    starts = (np.cumsum(counts) - counts)[counts > 0]
    out = np.zeros((len(starts), registers), np.uint16)
    if not len(starts):
        return out
    odd = np.random.default_rng(20_24).integers(0, 1 << 63, registers, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
    least, buffer = np.empty(out.shape, np.float64), np.empty_like(values)
    for r in range(registers):
        # values are mixed already: an odd multiplier gives each register an order of its own
        np.multiply(values, odd[r], out=buffer)
        least[:, r] = np.minimum.reduceat(buffer, starts)
    variate = -np.log1p(-np.minimum((least + 0.5) / 2.0**64, 1 - 2.0**-53)) / RATE
    out[:] = np.clip(np.floor(1 - np.log(variate) / np.log(BASE)), 0, LEVELS + 1)
    return out


def likely_similarity(a: np.ndarray, b: np.ndarray, size_a: np.ndarray, size_b: np.ndarray) -> np.ndarray:
    """Joint maximum-likelihood estimate of the similarity of sketched sets of known sizes, on a grid."""
    a, b = a.astype(np.int32), b.astype(np.int32)
    more, less = (a > b).sum(1)[:, None], (a < b).sum(1)[:, None]
    same = a.shape[1] - more - less
    u = (size_a / (size_a + size_b))[:, None]
    v = 1 - u
    j = np.linspace(0, 1, 201)[None, :] * np.minimum(u / v, v / u)
    p = lambda x: -np.log1p(-np.clip(x, 0, 1) * (BASE - 1) / BASE) / np.log(BASE)
    up, down = p(u - v * j), p(v - u * j)
    tiny = 1e-12
    like = more * np.log(up + tiny) + less * np.log(down + tiny) + same * np.log(np.maximum(1 - up - down, 0) + tiny)
    return j[np.arange(len(j)), like.argmax(1)]


def possible(ra: np.ndarray, rb: np.ndarray, na: np.ndarray, nb: np.ndarray, least: float) -> np.ndarray:
    """Whether the joint estimate of each pair lies at most seven standard deviations below ``least``."""
    low = least - 7 * np.sqrt(least * (1 - least) / ra.shape[1])
    parts = [likely_similarity(ra[i : i + 1000], rb[i : i + 1000], na[i : i + 1000], nb[i : i + 1000]) >= low for i in range(0, len(na), 1000)]
    return np.concatenate(parts or [np.zeros(0, bool)])


def sets_of(texts: list[str], words: int, run: int = 1 << 18) -> Iterator[np.ndarray]:
    """The shingle set of each text; texts are worked off in runs of about ``run`` characters."""
    start = 0
    while start < len(texts):
        stop, size = start + 1, len(texts[start])
        while stop < len(texts) and size + len(texts[stop]) <= run:
            size += len(texts[stop])
            stop += 1
        values, n = shingle_sets(texts[start:stop], words)
        yield from np.split(values, np.cumsum(n)[:-1])
        start = stop


def sketches(docs: DataFrame, words: int, registers: int, id_col: str, text_col: str) -> DataFrame:
    """(doc_id, text_key, n_shingles, set_key, regs): set_key is equal for equal sets; it and regs are null for empty sets."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in chunks(batches, "text"):
            values, n = shingle_sets(texts_of(batch, "text"), words)
            regs = iter(sketch(values, n, registers))
            ends = np.cumsum(n)
            keys = [hashlib.blake2b(values[e - k : e].tobytes(), digest_size=16).digest() if k else None for e, k in zip(ends, n, strict=True)]
            packed = [next(regs).tobytes() if k else None for k in n]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("text_key"), pa.array(n, pa.int64()), pa.array(keys, pa.binary()), pa.array(packed, pa.binary())], ["doc_id", "text_key", "n_shingles", "set_key", "regs"])

    source = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.xxhash64(text_col).alias("text_key"), F.col(text_col).cast("string").alias("text"))
    return source.mapInArrow(run, "doc_id long, text_key long, n_shingles long, set_key binary, regs binary")


def estimated(pairs: DataFrame, classes: DataFrame, least: float) -> DataFrame:
    """Pairs (a, b) of class ids whose sizes allow, and whose estimate does not rule out, a similarity of ``least``."""
    own = classes.select("rep", "n_shingles", "regs")
    both = pairs.join(own.toDF("a", "na", "ra"), "a").join(own.toDF("b", "nb", "rb"), "b").where((F.least("na", "nb") >= least * F.greatest("na", "nb") - 1e-9))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            ra, rb = (np.frombuffer(b"".join(batch.column(c).to_pylist()), np.uint16).reshape(batch.num_rows, -1) for c in ("ra", "rb"))
            na, nb = (batch.column(c).to_numpy().astype(float) for c in ("na", "nb"))
            yield batch.select(["a", "b"]).filter(pa.array(possible(ra, rb, na, nb, least)))

    return both.select("a", "b", "na", "nb", "ra", "rb").mapInArrow(run, "a long, b long")


def is_link(x: np.ndarray, y: np.ndarray, percent: int) -> bool:
    """100 * intersection >= percent * union, of sorted distinct arrays."""
    if min(len(x), len(y)) * 100 < percent * max(len(x), len(y)):
        return False
    shared = int((y[np.minimum(np.searchsorted(y, x), len(y) - 1)] == x).sum())
    return 100 * shared >= percent * (len(x) + len(y) - shared)


def confirmed(pairs: DataFrame, texts: DataFrame, words: int, percent: int) -> DataFrame:
    """The pairs that are links by their full sets."""
    both = pairs.join(texts.toDF("a", "ta"), "a").join(texts.toDF("b", "tb"), "b").select("a", "b", "ta", "tb")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in chunks(batches, "ta"):
            ta, tb = texts_of(batch, "ta"), texts_of(batch, "tb")
            ok = [is_link(x, y, percent) for x, y in zip(sets_of(ta, words), sets_of(tb, words), strict=True)]
            yield batch.select(["a", "b"]).filter(pa.array(ok, pa.bool_()))

    return both.mapInArrow(run, "a long, b long")


def components(links: DataFrame) -> DataFrame:
    """(v, c): the smallest vertex that each vertex of the links (a, b) reaches.

    Alternates large-star and small-star steps until nothing changes; every step is a grouped minimum and a join,
    written to the shared folder.
    """
    edges = links.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u != v").distinct()
    before = None
    while True:
        near = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        # large star: what is larger than u goes to the smallest neighbour of u (or u itself)
        low = near.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = near.where("v > u").join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u != v").distinct()
        # small star: u and its smaller neighbours go to the smallest of them
        small_low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(small_low, "u").select(F.explode(F.array("u", "v")).alias("u"), F.col("m").alias("v")).where("u != v").distinct()
        edges = staged(small, "components")
        now = tuple(edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").bitwiseAND(F.lit((1 << 40) - 1)))).first())
        if now == before:
            return edges.toDF("v", "c").unionByName(edges.select(F.col("v"), F.col("v").alias("c"))).distinct()
        before = now


def near_duplicates(docs: DataFrame, words: int = 5, percent: int = 80, registers: int = REGISTERS, rows: int = ROWS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_shingles, component_id, kept) of every row.

    Texts link if they share at least ``percent`` % of the union of their sets of word shingles (as 64-bit hashes); words
    are split at ASCII white space after lower-casing A-Z.  A text with fewer words than a shingle is one shingle, a text
    without words (null, empty) none: it links with nothing.  Rows that share a doc_id are one document: it links by
    each of its texts.  A row with a null id links with nothing and is kept (its component_id is null).  An empty table
    gives an empty result; columns other than the two named do not matter.
    """
    spark = docs.sparkSession
    ship(spark)
    least = percent / 100
    sets = staged(sketches(docs, words, registers, id_col, text_col), "sketches")
    known = sets.where("set_key is not null and doc_id is not null")
    # a class of equal sets, with a number of its own (fixed once written) and its first text
    first = F.min(F.struct("doc_id", "text_key"))
    classes = known.groupBy("set_key").agg(first.alias("f"), F.first("n_shingles").alias("n_shingles"), F.first("regs").alias("regs"))
    classes = staged(classes.select(F.monotonically_increasing_id().alias("rep"), F.col("f.doc_id").alias("first_id"), F.col("f.text_key").alias("text_key"), "set_key", "n_shingles", "regs"), "classes")
    placed = sets.select("doc_id", "n_shingles", "set_key").join(classes.select("set_key", "rep"), "set_key", "left")
    placed = staged(placed.select("doc_id", "n_shingles", F.when(F.col("doc_id").isNotNull(), F.col("rep")).alias("rep")), "placed")
    # a bucket's name: the band's number and its registers
    names = F.array(*[F.xxhash64(F.lit(i), F.substring(F.col("regs"), 2 * rows * i + 1, 2 * rows)) for i in range(registers // rows)])
    members = staged(classes.select("rep", F.explode(names).alias("bucket")), "buckets")
    # written, so that the join may split a bucket with many members
    heads = staged(members.groupBy("bucket").agg(F.min("rep").alias("a"), F.count(F.lit(1)).alias("n")).where("n > 1").select("bucket", "a"), "heads")
    full = staged(members.join(heads, "bucket"), "shared")  # members of buckets with others
    stars = full.where("rep != a").select("a", F.col("rep").alias("b")).distinct()
    wanted = staged(classes.join(full.select("rep").distinct(), "rep", "left_semi").select(F.col("first_id").alias("v"), "text_key", "rep"), "wanted")
    own = docs.select(F.col(id_col).cast("long").alias("v"), F.xxhash64(text_col).alias("text_key"), F.col(text_col).cast("string").alias("text"))
    texts = staged(own.join(if_small(wanted), ["v", "text_key"]).dropDuplicates(["v", "text_key"]).select(F.col("rep").alias("v"), "text"), "texts")
    # documents of several texts tie these together
    several = placed.where("doc_id is not null and rep is not null").groupBy("doc_id").agg(F.min("rep").alias("a"), F.max("rep").alias("z")).where("a < z")
    tied = placed.join(several.select("doc_id", "a"), "doc_id").select("a", F.col("rep").alias("b")).where("a != b").distinct()
    links = staged(confirmed(estimated(stars, classes, least), texts, words, percent).unionByName(tied), "links")
    found = components(links)
    label = lambda frame, c: frame.join(c.toDF("rep", "c"), "rep", "left").withColumn("c", F.coalesce("c", "rep"))
    apart = label(full, found)
    mixed = apart.groupBy("bucket").agg(F.min("c").alias("lo"), F.max("c").alias("hi"), F.sum(F.xxhash64("rep").cast("decimal(20,0)")).alias("sig"), F.count(F.lit(1)).alias("n")).where("lo < hi and n > 2")
    once = mixed.groupBy("sig", "n").agg(F.min("bucket").alias("bucket")).select("bucket", "n")  # buckets with equal members: one of them
    left = staged(apart.join(once, "bucket").select("bucket", "n", "rep", "c"), "apart")
    few = left.where(F.col("n") <= SMALL).groupBy("bucket").agg(F.collect_list(F.struct("rep", "c")).alias("m"))  # SMALL members at most
    two = F.flatten(F.transform("m", lambda x: F.transform(F.filter("m", lambda y: (y["rep"] > x["rep"]) & (y["c"] != x["c"])), lambda y: F.struct(x["rep"].alias("a"), y["rep"].alias("b")))))
    pairs = few.select(F.explode(two).alias("p")).select("p.a", "p.b").distinct()
    rest = staged(confirmed(estimated(pairs, classes, least), texts, words, percent).unionByName(rest_links(left.where(F.col("n") > SMALL).drop("n"), classes, texts, words, percent)), "rest")
    labelled = staged(label(classes.select("rep", "first_id"), components(links.unionByName(rest))), "labelled")
    smallest = staged(labelled.groupBy("c").agg(F.min("first_id").alias("component_id")), "smallest")
    # a row without words belongs where its document's other texts do
    bare = placed.where("doc_id is not null and rep is null").select("doc_id").distinct()
    twins = staged(with_ids(placed.where("rep is not null"), bare, "doc_id", "left_semi").groupBy("doc_id").agg(F.min("rep").alias("twin")), "twins")
    whole = placed.join(if_small(twins), "doc_id", "left").withColumn("rep", F.coalesce("rep", "twin"))
    answer = whole.join(labelled.join(smallest, "c").select("rep", "component_id"), "rep", "left")
    answer = answer.select("doc_id", "n_shingles", F.when(F.col("doc_id").isNotNull(), F.coalesce("component_id", "doc_id")).alias("component_id"))
    return answer.withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)))


def rest_links(members: DataFrame, classes: DataFrame, texts: DataFrame, words: int, percent: int) -> DataFrame:
    """Links between members of a bucket that the stars left in different components.

    ``members``: (bucket, rep, c).  A bucket's largest component names it; all buckets of that name are taken
    together, so that a pair is compared once however many buckets it shares.  The component's members and the others,
    the strays, are cut into blocks of about ``BLOCK`` members and ``BLOCK_BYTES``; each block of strays meets each block
    in a group of its own, which emits a link only where it joins two components.  A text is thus copied once for each
    block that it meets, a 128th of the members; registers rule out most pairs before any set is compared.
    """
    least = percent / 100
    named = members.groupBy("bucket", "c").agg(F.count(F.lit(1)).alias("k")).groupBy("bucket").agg(F.max_by("c", F.struct("k", "c")).alias("main"))
    gathered = members.join(if_small(staged(named, "named")), "bucket").select("main", "rep", "c").distinct().withColumn("stray", F.col("c") != F.col("main"))
    gathered = staged(gathered.join(texts.select(F.col("v").alias("rep"), F.octet_length("text").alias("bytes")), "rep"), "gathered")
    blocks = lambda own: F.ceil(F.greatest(F.count_if(own) / BLOCK, F.sum(F.when(own, F.col("bytes"))) / BLOCK_BYTES)).cast("int")
    sizes = gathered.groupBy("main").agg(blocks(F.col("stray")).alias("strays"), blocks(~F.col("stray")).alias("mains"))
    strays, mains = F.col("strays"), F.col("mains")
    placed = gathered.join(if_small(staged(sizes, "sizes")), "main").withColumn("mine", F.pmod(F.xxhash64("rep"), F.when(F.col("stray"), strays).otherwise(mains)).cast("int"))
    group = lambda kind, s, o: F.struct(s.cast("int").alias("s"), F.lit(kind).alias("kind"), o.cast("int").alias("o"))
    up_to = lambda n: F.sequence(F.lit(0), n - 1)
    mine = F.col("mine")
    groups = F.when(F.col("stray"), F.concat(F.transform(up_to(mains), lambda x: group("main", mine, x)), F.transform(up_to(strays), lambda x: group("stray", F.least(mine, x), F.greatest(mine, x))))).otherwise(F.transform(up_to(strays), lambda x: group("main", x, mine)))
    dealt = placed.select("main", "rep", "c", F.explode(groups).alias("g")).select("main", "g.*", "rep", "c")
    loaded = dealt.join(classes.select("rep", "n_shingles", "regs"), "rep").join(texts.toDF("rep", "text"), "rep")

    def run(group: pd.DataFrame) -> pd.DataFrame:
        reps, parts = group["rep"].to_numpy(), group["c"].to_numpy()
        sizes = group["n_shingles"].to_numpy().astype(float)
        regs = np.frombuffer(b"".join(group["regs"]), np.uint16).reshape(len(group), -1)
        i, j = (x.astype(np.int32) for x in np.triu_indices(len(group), 1))
        ok = (parts[i] != parts[j]) & (np.minimum(sizes[i], sizes[j]) >= least * np.maximum(sizes[i], sizes[j]) - 1e-9)
        i, j = i[ok], j[ok]
        # equal registers first: cheaper than the joint estimate, and rules out most
        width = regs.shape[1]
        few = (least - 8 * np.sqrt(least * (1 - least) / width)) * width
        kept = [np.zeros((0, 2), np.int64)]
        for k in range(0, len(i), 4096):
            a, b = i[k : k + 4096], j[k : k + 4096]
            ok = (regs[a] == regs[b]).sum(1) >= few
            a, b = a[ok], b[ok]
            ok = possible(regs[a], regs[b], sizes[a], sizes[b], least)
            kept.append(np.stack((a[ok], b[ok]), 1))
        i, j = np.concatenate(kept).T
        joined: dict[int, int] = {}

        def top(x: int) -> int:
            while x in joined:
                x = joined[x]
            return x

        used = np.unique(np.concatenate((i, j)))
        cache = dict(zip(used.tolist(), sets_of(group["text"].iloc[used].tolist(), words), strict=True))
        out = []
        for x, y in zip(i.tolist(), j.tolist(), strict=True):
            p, q = top(int(parts[x])), top(int(parts[y]))
            if p == q:
                continue
            if is_link(cache[x], cache[y], percent):
                joined[max(p, q)] = min(p, q)
                out.append((int(reps[x]), int(reps[y])))
        return pd.DataFrame(out, columns=["a", "b"]).astype("int64")

    return loaded.groupBy("main", "s", "kind", "o").applyInPandas(run, "a long, b long")
