"""Mixing sources to target weights by Sainte-Lague apportionment.

Each source's documents are dealt by a seeded hash to shards of about equally many words, laid out there in seeded order
and cut into blocks of equally many words.  The total number of blocks is apportioned to the sources by highest quotients
``target / (2 k + 1)``, each source's blocks likewise to groups of its shards and from there to the shards.  Every shard
takes its quota: whole passes first, then blocks from a seeded one on, around the shard's end.
"""

from __future__ import annotations

import heapq
import re
from collections.abc import Iterator, Sequence
from fractions import Fraction

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import WORD, chunks, if_small, ship, staged, texts_of, words

WEIGHTS = (5, 2, 1)
#: Words of a block; words and documents of a shard, on average at most; shards of a group; the most times that a source may be repeated.
BLOCK, SHARD_WORDS, SHARD_DOCS, GROUP_SHARDS, MOST = 64, 1 << 16, 4096, 4096, 3
#: Copies of a row that one task makes at once.
COPIES = 1 << 16
_WORD = re.compile(WORD)


def capped_targets(sizes: Sequence[int], weights: Sequence[int], total: int, most: int = MOST) -> list[float]:
    """Shares of ``total`` by weight; none above ``most`` times its size, the excess shared anew by weight.

    Sources reach their limits in the order of size by weight, so that one pass over them in that order settles all.
    """
    share = [0.0] * len(sizes)
    order = sorted((i for i, s in enumerate(sizes) if s > 0), key=lambda i: Fraction(sizes[i], weights[i]))
    left, weight = total, sum(weights[i] for i in order)
    for at, i in enumerate(order):
        if left * weights[i] <= most * sizes[i] * weight:  # nor does any later one reach its limit
            for j in order[at:]:
                share[j] = float(Fraction(left * weights[j], weight))
            break
        share[i] = float(most * sizes[i])
        left -= most * sizes[i]
        weight -= weights[i]
    return share


def sainte_lague(votes: Sequence[float], seats: int, limits: Sequence[int]) -> list[int]:
    """Seats by highest quotients votes / (2 k + 1), ties to the earlier entry, nobody above its limit.

    The divisor is found by bisection, so the number of seats costs no time; the few that it leaves go by a heap of quotients.
    """
    got = [0] * len(votes)
    seats = min(seats, sum(n for v, n in zip(votes, limits, strict=True) if v > 0))
    if seats <= 0 or not any(v > 0 for v in votes):
        return got
    low, high = 0.0, 2.0 * max(votes) + 1.0  # at the divisor ``high`` nobody has a seat
    for _ in range(200):
        mid = (low + high) / 2
        if not low < mid < high:
            break
        if sum(min(n, int(v / mid + 0.5)) for v, n in zip(votes, limits, strict=True)) > seats:
            low = mid
        else:
            high = mid
    got = [min(n, int(v / high + 0.5)) for v, n in zip(votes, limits, strict=True)]
    left = seats - sum(got)
    queue = [(-v / (2 * got[i] + 1), i) for i, v in enumerate(votes) if v > 0 and got[i] < limits[i]] if left else []
    heapq.heapify(queue)
    for _ in range(left):
        i = queue[0][1]
        got[i] += 1
        if got[i] < limits[i]:
            heapq.heapreplace(queue, (-votes[i] / (2 * got[i] + 1), i))
        else:
            heapq.heappop(queue)
    return got


def repeated(counted: DataFrame) -> DataFrame:
    """A row ``copy`` = 0, 1, ... for each of the ``n`` rows that a row of ``counted`` (written) stands for.

    Rows of up to ``COPIES`` copies are spread where they are; larger ones first into parts of so many, dealt anew.
    """
    few = counted.where(f"n <= {COPIES}").withColumn("part", F.lit(0).cast("long"))
    many = counted.where(f"n > {COPIES}").withColumn("part", F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("n") - 1) / COPIES)))).repartition("key", "part")
    last = F.least(F.col("n"), (F.col("part") + 1) * COPIES) - 1
    both = few.unionByName(many)
    return both.withColumn("copy", F.explode(F.sequence(F.col("part") * COPIES, last))).drop("n", "part")


def mix_plan(docs: DataFrame, weights: Sequence[int] = WEIGHTS, block: int = BLOCK, seed: int = 7, most: int = MOST, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """(doc_id, size, source_size, target, passes, spans, key) of every row.

    ``passes`` is how often the whole text is taken, ``spans`` the word ranges [start, stop) taken once more; ``key``
    is a hash of the text.  A null or empty text has size 0 and is not taken; a null source is one source, the last.
    Rows that repeat are separate rows; rows with a null id are, too.  An empty table gives an empty result.

    Texts are read once; what follows works on a written table of sizes.  A row per source and per ``GROUP_SHARDS``
    shards (some 270 million words) reaches the driver; documents never do.
    """
    spark = docs.sparkSession
    ship(spark)
    text = F.col(text_col).cast("string")
    sized = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(source_col).cast("string").alias("source"), F.size(words(text)).cast("long").alias("size"), F.xxhash64(text).alias("key"))
    sized = staged(sized.groupBy("doc_id", "source", "size", "key").agg(F.count(F.lit(1)).alias("n")), "sizes")
    totals = sized.groupBy("source").agg(F.sum(F.col("size") * F.col("n")).alias("size"), F.sum("n").alias("docs")).collect()
    order = sorted(totals, key=lambda r: (r["source"] is None, r["source"] or ""))
    sizes = [r["size"] for r in order]
    targets = capped_targets(sizes, [weights[i % len(weights)] for i in range(len(order))], sum(sizes), most)
    seats = sainte_lague(targets, round(sum(targets) / block), [-(-most * s // block) for s in sizes])
    rows = [(r["source"], i, r["size"], t, max(1, -(-r["size"] // SHARD_WORDS), -(-r["docs"] // SHARD_DOCS))) for i, (r, t) in enumerate(zip(order, targets, strict=True))]
    sources = if_small(spark.createDataFrame(rows, "source string, no int, source_size long, target double, shards long"))

    at = F.xxhash64(F.lit(seed), "doc_id", "size", "key")
    at = F.when(F.col("copy") == 0, at).otherwise(F.xxhash64(at, "copy"))  # equal rows are spread over the shards
    rows = repeated(sized)
    placed = rows.join(sources, rows["source"].eqNullSafe(sources["source"])).select("doc_id", "size", "key", "no", "source_size", "target", "shards", at.alias("at"))
    placed = placed.withColumn("shard", F.pmod(F.xxhash64("at", F.lit("shard")), F.col("shards"))).drop("shards")
    line = Window.partitionBy("no", "shard").orderBy("at", "doc_id", "size").rowsBetween(Window.unboundedPreceding, 0)
    placed = staged(placed.withColumn("stop", F.sum("size").over(line)).withColumn("start", F.col("stop") - F.col("size")).drop("at"), "placed")

    cells = placed.groupBy("no", "shard").agg(F.sum("size").alias("words")).select("no", "shard", "words", F.ceil(F.col("words") / block).alias("blocks"), F.floor(F.col("shard") / GROUP_SHARDS).alias("part"))
    parts: dict[int, list] = {}
    for r in cells.groupBy("no", "part").agg(F.sum("words").alias("words"), F.sum("blocks").alias("blocks")).orderBy("no", "part").collect():
        parts.setdefault(r["no"], []).append(r)
    dealt = [(no, r["part"], n) for no, own in parts.items() for r, n in zip(own, sainte_lague([float(r["words"]) for r in own], seats[no], [most * r["blocks"] for r in own]), strict=True)]

    def quotas(group: pd.DataFrame) -> pd.DataFrame:
        """One group of shards, a row each."""
        group = group.sort_values("shard", ignore_index=True)
        blocks = group["blocks"].tolist()
        quota = sainte_lague([float(s) for s in group["words"]], int(group["seats"].iloc[0]), [most * b for b in blocks])
        return pd.DataFrame({"no": group["no"], "shard": group["shard"], "blocks": blocks, "passes": [q // b if b else 0 for q, b in zip(quota, blocks, strict=True)], "extra": [q % b if b else 0 for q, b in zip(quota, blocks, strict=True)]})

    # every part has a row in the driver already: to broadcast them is no more
    seated = cells.join(F.broadcast(spark.createDataFrame(dealt, "no int, part long, seats long")), ["no", "part"])
    quota = staged(seated.groupBy("no", "part").applyInPandas(quotas, "no int, shard long, blocks long, passes long, extra long"), "quotas")
    first = F.pmod(F.xxhash64(F.lit(seed), "no", "shard"), F.greatest("blocks", F.lit(1)))
    ranges = quota.select("no", "shard", "passes", (first * block).alias("a"), ((first + F.col("extra")) * block).alias("b"), ((first + F.col("extra") - F.col("blocks")) * block).alias("c"))
    # of a text's words, those from a to b, and those before c where the quota goes on from the shard's start
    cut = lambda low, high: F.struct((F.greatest("start", low) - F.col("start")).alias("start"), (F.least("stop", high) - F.col("start")).alias("stop"))
    spans = F.filter(F.array(cut(F.lit(0).cast("long"), F.col("c")), cut(F.col("a"), F.col("b"))), lambda s: s["stop"] > s["start"])
    return placed.join(if_small(ranges), ["no", "shard"]).select("doc_id", "size", "source_size", "target", "passes", spans.alias("spans"), "key")


def taken(plan: DataFrame) -> DataFrame:
    """Adds ``taken``, the words that the mix takes of each row, repeats counted."""
    part = F.aggregate("spans", F.lit(0).cast("long"), lambda n, s: n + s["stop"] - s["start"])
    return plan.withColumn("taken", F.col("passes") * F.col("size") + part)


def mixed_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """The mix itself, with the columns of ``docs``: a row for each pass, its text whole or the words of its spans.

    Neighbouring spans join, and what lies between their words stays; separate spans are parted by a line end.
    """
    plan = mix_plan(docs, id_col=id_col, text_col=text_col, **options).where((F.col("passes") > 0) | (F.size("spans") > 0))
    # keys without nulls: the shuffle that finds equal rows then serves the join as well, and texts move once
    named = lambda c: F.coalesce(c.cast("long").cast("string"), F.lit("null"))
    # equal rows have few ways of being taken in a shard, whole or up to a block's end: their texts meet a row for each
    ways = plan.groupBy(named(F.col("doc_id")).alias("_id"), F.col("key").alias("_key"), "passes", "spans").agg(F.count(F.lit(1)).alias("n"))
    ways = ways.select("_id", "_key", F.struct("passes", "spans", "n").alias("_mix"))
    rows = docs.withColumn("_id", named(F.col(id_col))).withColumn("_key", F.xxhash64(F.col(text_col).cast("string"))).dropDuplicates(["_id", "_key"])
    both = rows.join(ways, ["_id", "_key"]).select(*docs.columns, "_mix")
    times = lambda n: F.explode(F.sequence(F.lit(1).cast("long"), n))
    whole = both.where("_mix.passes > 0").withColumn("_n", times(F.col("_mix.passes") * F.col("_mix.n"))).select(*docs.columns)
    names, at = docs.columns, docs.columns.index(text_col)

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in chunks(batches, text_col):
            out = []
            for t, spans in zip(texts_of(batch, text_col), batch.column("_spans").to_pylist(), strict=True):
                found, parts = [m.span() for m in _WORD.finditer(t)], []
                for s in spans:
                    if parts and parts[-1][1] == s["start"]:
                        parts[-1] = (parts[-1][0], s["stop"])
                    else:
                        parts.append((s["start"], s["stop"]))
                out.append("\n".join(t[found[a][0] : found[b - 1][1]] for a, b in parts))
            columns = [batch.column(n) for n in names]
            columns[at] = pa.array(out, pa.string())
            yield pa.RecordBatch.from_arrays(columns, names)

    part = both.where(F.size("_mix.spans") > 0).select(*names, F.col("_mix.spans").alias("_spans"), times(F.col("_mix.n"))).drop("col").mapInArrow(cut, docs.schema)
    return whole.unionByName(part)
