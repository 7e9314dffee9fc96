"""A Merkle manifest of a dataset by time-forward processing.

Leaves are rows, a tree per source over them, and one tree over the sources' roots.  A node's label is (level, index):
children come before parents.  Digests travel forward in time, each to the label of its parent, and the queue that
delivers them in the order of labels is external: its near part is a heap in the task that sweeps a block of
``FAN ** BAND`` leaves, its far part a table that Spark sorts by (tree, block, position) for the next sweep, a band of
levels higher.  A sweep of 10**12 leaves takes four bands.  The reversed sweep then goes from the root down: every
node gets the *path* above it (own place and digests of each run, level by level), adds its run and sends it to its
children; at the leaves it is hashed.

No task holds more than a block, and positions come from a range sort with prefix sums over (partition, source): a
source of a third of all rows is many blocks, and equal rows are many sort keys.
"""

from __future__ import annotations

import hashlib
import heapq
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import if_small, ship, staged

#: Children of a node, and levels that one sweep climbs (blocks of 4096 leaves).
FAN, BAND = 16, 3
BLOCK = FAN**BAND
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")
_PATH = "array<struct<place: int, run: string>>"


def sha(text: str) -> str:
    return hashlib.sha256(text.encode("ascii")).hexdigest()


def leaf(**changed: Column) -> Column:
    """Digest of a row: each field as "-" if null, else its UTF-8 byte count, ":" and its value."""
    parts = []
    for name in FIELDS:
        value = changed.get(name, F.col(name)).cast("string")
        parts.append(F.coalesce(F.concat(F.octet_length(value).cast("string"), F.lit(":"), value), F.lit("-")))
    return F.sha2(F.concat(*parts), 256)


def crc(value: Column) -> Column:
    return F.crc32(value.cast("string").cast("binary"))


def ranged(rows: DataFrame, group: str, order: list[str], name: str) -> tuple[DataFrame, DataFrame]:
    """``rows`` (written) sorted by range, with ``_part`` and ``_at``; and (group, _part, _first, _before, n) for each of their runs.

    A row's position in its group is ``_at - _first + _before``: what precedes it is a sum over (group, partition), not a
    window over rows.  Rows equal in the order are told apart by a number of their own, so that no sort key repeats.
    """
    ordered = rows.withColumn("_own", F.monotonically_increasing_id())
    keys = [F.col(c).asc_nulls_first() for c in [group, *order, "_own"]]
    ordered = ordered.repartitionByRange(*keys).sortWithinPartitions(*keys).withColumn("_at", F.monotonically_increasing_id())
    ordered = staged(ordered.drop("_own").withColumn("_part", F.shiftright("_at", 33)), name)
    runs = ordered.groupBy(group, "_part").agg(F.min("_at").alias("_first"), F.count("*").alias("_n"))
    whole = Window.partitionBy(group)  # a row for each partition that holds the group
    before = F.sum("_n").over(whole.orderBy("_part")) - F.col("_n")
    return ordered, staged(runs.select(group, "_part", "_first", before.alias("_before"), F.sum("_n").over(whole).alias("n")), f"{name}-runs")


def placed(ordered: DataFrame, runs: DataFrame, group: str) -> DataFrame:
    """Rows of ``ranged`` with ``pos``, counted from 0 in each group, and what else ``runs`` holds."""
    near = if_small(runs.withColumnsRenamed({group: "_group", "_part": "_of"}))
    rows = ordered.join(near, (F.col("_part") == F.col("_of")) & F.col(group).eqNullSafe(F.col("_group")))
    return rows.withColumn("pos", F.col("_at") - F.col("_first") + F.col("_before")).drop("_at", "_part", "_of", "_group", "_first", "_before")


def climb(digests: list[str], alone: bool) -> list[list[tuple[str, ...]]]:
    """Runs of each level of a block, bottom up; the last level has one run unless the block has one node and is a tree.

    ``alone``: the block is the whole tree, which ends with its first single node; otherwise it climbs the full band.
    """
    queue = [(1, i // FAN, i % FAN, d) for i, d in enumerate(digests)]  # messages: label of the receiver, place, digest
    levels: list[list[tuple[str, ...]]] = []
    count = len(digests)
    while queue and not (alone and count == 1) and len(levels) < BAND:
        level, runs = queue[0][0], []
        while queue and queue[0][0] == level:
            label, run = queue[0][:2], []
            while queue and queue[0][:2] == label:
                run.append(heapq.heappop(queue)[3])
            runs.append(tuple(run))
            heapq.heappush(queue, (level + 1, label[1] // FAN, label[1] % FAN, sha("".join(run))))
        levels.append(runs)
        count = len(runs)
    return levels


def _blocks(batches: Iterable[pa.RecordBatch]) -> Iterator[list[dict]]:
    """Rows of one block after another, from batches that are sorted by (tree, block, pos)."""
    held: list[dict] = []
    for batch in batches:
        for row in batch.to_pylist():
            if held and (row["tree"], row["block"]) != (held[0]["tree"], held[0]["block"]):
                yield held
                held = []
            held.append(row)
    if held:
        yield held


def _in_blocks(nodes: DataFrame) -> DataFrame:
    """The far part of the queue: nodes dealt by block and sorted by label."""
    return nodes.repartition("tree", "block").sortWithinPartitions("tree", "block", "pos")


def forward(nodes: DataFrame) -> DataFrame:
    """(tree, pos, n, digest) of the tops of all blocks of ``nodes``, which has the same columns."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tops = []
        for rows in _blocks(batches):
            n = rows[0]["n"]
            levels = climb([r["digest"] for r in rows], n <= BLOCK)
            tops.append((rows[0]["tree"], rows[0]["block"], -(-n // BLOCK), sha("".join(levels[-1][0])) if levels else rows[0]["digest"]))
        yield pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(zip(*tops, strict=True) if tops else [[]] * 4, (pa.int64(), pa.int64(), pa.int64(), pa.string()), strict=True)], ["tree", "pos", "n", "digest"])

    dealt = nodes.select("tree", F.floor(F.col("pos") / BLOCK).alias("block"), "pos", "n", "digest")
    return _in_blocks(dealt).mapInArrow(run, "tree long, pos long, n long, digest string")


def bands(nodes: DataFrame, largest: int, name: str) -> list[DataFrame]:
    """``nodes`` and the tops of their blocks, band by band, until every tree is one node; all but the first are written."""
    found = [nodes]
    while largest > 1:
        # trees that are one node already stay behind: their top is known
        found.append(staged(forward(found[-1].where("n > 1")), f"{name}-{len(found)}"))
        largest = -(-largest // BLOCK)
    return found


def roots(found: list[DataFrame]) -> DataFrame:
    """(tree, digest) of every tree's last node."""
    ends = [f.where("n = 1").select("tree", "digest") for f in found]
    out = ends[0]
    for e in ends[1:]:
        out = out.unionByName(e)
    return out


def paths(rows: list[dict]) -> Iterator[tuple[dict, list[dict]]]:
    """The reversed sweep of one block: every node with the path above it, bottom of the path first.

    ``rows[0]`` is the message to the block's top, with the path above that.
    """
    message, nodes = rows[0], rows[1:]
    levels = climb([r["digest"] for r in nodes], nodes[0]["n"] <= BLOCK)
    # labels in descending order: a parent sends what it got, and its run, to its children
    queue = [(-len(levels), 0, message["path"])]
    while queue:
        level, index, path = heapq.heappop(queue)
        if not level:
            yield nodes[index], path
            continue
        run = levels[-level - 1][index]
        text = "".join(run)
        for place in range(len(run)):
            heapq.heappush(queue, (level + 1, index * FAN + place, [{"place": place, "run": text}, *path]))


def backward(nodes: DataFrame, messages: DataFrame) -> DataFrame:
    """(tree, pos, path) of every node of a band, from messages (tree, pos, path) to the tops of its blocks."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in _blocks(batches):
            yield pa.RecordBatch.from_pylist([{"tree": r["tree"], "pos": r["pos"], "path": path} for r, path in paths(rows)], schema=_SENT)

    return delivered(nodes, messages).mapInArrow(run, f"tree long, pos long, path {_PATH}")


_STEPS = pa.list_(pa.struct([("place", pa.int32()), ("run", pa.string())]))
_SENT = pa.schema([("tree", pa.int64()), ("pos", pa.int64()), ("path", _STEPS)])


def delivered(nodes: DataFrame, messages: DataFrame) -> DataFrame:
    """Nodes of a band in the order of their labels, each block led by the message to its top (at position -1)."""
    dealt = nodes.withColumn("block", F.floor(F.col("pos") / BLOCK))
    return _in_blocks(dealt.unionByName(messages.withColumnRenamed("pos", "block").withColumn("pos", F.lit(-1).cast("long")), allowMissingColumns=True))


def sent_down(found: list[DataFrame], start: DataFrame, name: str) -> DataFrame:
    """Messages (tree, pos, path) to the tops of the lowest band's blocks.  ``start``: (tree, path) of the trees' roots."""
    messages = None
    for k in range(len(found) - 2, -1, -1):
        # a root is the top of its tree's only block in the highest band that has more than one node of the tree
        first = found[k].where(f"pos = 0 and n > 1 and n <= {BLOCK}").select("tree", "pos").join(start, "tree").select("tree", "pos", "path")
        messages = first if messages is None else first.unionByName(staged(backward(found[k + 1].where("n > 1"), messages), f"{name}-{k}"))
    return messages if messages is not None else start.where("false").select("tree", F.lit(0).cast("long").alias("pos"), "path")


def fold(digest: str, path: list[dict]) -> str:
    """Root that follows from a leaf and the digests beside its way up."""
    for step in path:
        at, run = 64 * step["place"], step["run"]
        digest = sha(run[:at] + digest + run[at + 64 :])
    return digest


def siblings(path: list[dict]) -> str:
    return "".join(s["run"][: 64 * s["place"]] + s["run"][64 * s["place"] + 64 :] for s in path)


def manifest(docs: DataFrame) -> DataFrame:
    """(doc_id, source, leaf, tampered, subroot, root, proof_sha256, folded_root, verified) of every row.

    Leaves of a source ascend by doc_id (null first), equal ids by leaf; runs of ``FAN`` nodes become the hash of their
    digests until one node is left.  Sources' roots, null first, then bytewise, are the leaves of the last tree.  Every
    fifth document by hash is tampered with: its leaf is that of its text with A-Z in lower case, and ``verified`` tells
    whether it still leads to the root.  Null fields have a digest of their own; repeated rows are leaves of their own, an empty table
    has no rows, other columns are ignored.
    """
    spark = docs.sparkSession
    ship(spark)
    upper = "".join(map(chr, range(65, 91)))
    touched = F.when(crc(F.col("doc_id")) % 5 == 0, leaf(text=F.translate("text", upper, upper.lower())))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("source").cast("string").alias("source"), F.col("lang").cast("string").alias("lang"), F.col("n_chars").cast("long").alias("n_chars"), F.col("text").cast("string").alias("text"))
    rows = staged(rows.select("doc_id", "source", leaf().alias("leaf"), touched.alias("tampered")), "leaves")
    ordered, runs = ranged(rows, "source", ["doc_id", "leaf"], "sorted")
    # sources, too, get their places by range: they may be as many as web hosts
    trees = staged(runs.select("source", F.lit(0).alias("all")).distinct(), "sources")
    trees = placed(*ranged(trees, "all", ["source"], "ranked"), "all")
    runs = staged(runs.join(trees.select(F.col("source").alias("_source"), F.col("pos").alias("tree")), F.col("source").eqNullSafe(F.col("_source"))).drop("_source"), "runs")
    leaves = placed(ordered, runs, "source")
    leaves = staged(leaves.select("tree", "pos", "n", F.col("leaf").alias("digest"), "doc_id", "source", "tampered"), "placed")
    measures = runs.agg(F.max("n").alias("n"), (F.max("tree") + 1).alias("trees")).first()
    if not measures["trees"]:
        return leaves.select("doc_id", "source", F.col("digest").alias("leaf"), "tampered", *(F.lit(None).cast(k).alias(c) for c, k in (("subroot", "string"), ("root", "string"), ("proof_sha256", "string"), ("folded_root", "string"), ("verified", "boolean"))))

    found = bands(leaves.select("tree", "pos", "n", "digest"), measures["n"], "band")
    subroots = staged(roots(found), "subroots")
    upper_found = bands(subroots.select(F.lit(0).cast("long").alias("tree"), F.col("tree").alias("pos"), F.lit(measures["trees"]).cast("long").alias("n"), "digest"), measures["trees"], "upper")
    root = roots(upper_found).first()["digest"]

    start = spark.createDataFrame([(0, [])], f"tree long, path {_PATH}")
    if measures["trees"] > 1:
        tops = staged(backward(upper_found[0], sent_down(upper_found, start, "above")), "above").select(F.col("pos").alias("tree"), "path")
    else:
        tops = start
    messages = sent_down(found, tops, "down").join(subroots.select("tree", F.col("digest").alias("subroot")), "tree")
    single = leaves.where("n = 1").join(tops, "tree").withColumn("subroot", F.col("digest"))

    def measured(nodes: Iterable[tuple[dict, list[dict], str]]) -> pa.RecordBatch:
        out = []
        for r, path, subroot in nodes:
            folded = fold(r["digest"] if r["tampered"] is None else r["tampered"], path)
            out.append({"doc_id": r["doc_id"], "source": r["source"], "leaf": r["digest"], "tampered": r["tampered"], "subroot": subroot, "proof_sha256": sha(siblings(path)), "folded_root": folded})
        return pa.RecordBatch.from_pylist(out, schema=_OUT)

    def swept(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block in _blocks(batches):
            yield measured((r, path, block[0]["subroot"]) for r, path in paths(block))

    def lone(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield measured((r, r["path"], r["subroot"]) for r in batch.to_pylist())

    many = delivered(leaves.where("n > 1"), messages)
    out = many.mapInArrow(swept, _OUT_DDL).unionByName(single.mapInArrow(lone, _OUT_DDL))
    return out.select("doc_id", "source", "leaf", "tampered", "subroot", F.lit(root).alias("root"), "proof_sha256", "folded_root", (F.col("folded_root") == root).alias("verified"))


_OUT_DDL = "doc_id long, source string, leaf string, tampered string, subroot string, proof_sha256 string, folded_root string"
_OUT = pa.schema([("doc_id", pa.int64()), *((c, pa.string()) for c in ("source", "leaf", "tampered", "subroot", "proof_sha256", "folded_root"))])
