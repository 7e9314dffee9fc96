"""Deduplication and merging of publication records in arrival order."""

from __future__ import annotations

import functools
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from marginalia.operators.shared import Rounds, cut, spread

#: Fields that the first non-null value fills, and lists that the first non-empty value fills.
FILLED = ("doi", "pmid", "abstract", "journal", "publication_date", "license")
LISTS = ("authors", "publication_types", "keywords")


def first_known(c: str, seq: str) -> Column:
    return F.min_by(c, F.when(F.col(c).isNotNull(), F.col(seq))).alias(c)


def first_list(c: str, seq: str) -> Column:
    return F.coalesce(F.min_by(c, F.when(F.size(c) > 0, F.col(seq))), F.array().cast("array<string>")).alias(c)


def ordered_sources(source: str, seq: str) -> Column:
    """Distinct sources in order of arrival.

    One entry per distinct source is kept by the caller's pre-aggregation, so the list is as short as there are sources.
    """
    return F.transform(F.array_sort(F.collect_list(F.struct(F.col(seq).alias("s"), F.col(source).alias("v")))), lambda x: x["v"])


def fold_by_key(records: DataFrame, key: Sequence[str], seq: str = "seq", source: str = "source", filled: Sequence[str] = (), lists: Sequence[str] = (), flags: Sequence[str] = (), firsts: Sequence[str] = ()) -> DataFrame:
    """One row per key: the first row decides ``firsts``, later ones fill what is missing, flags are or-ed.

    Two aggregations on the same hash of the key: per (key, source) first, so that a key with many rows is reduced
    where it is read, then per key.  Adds first_seen_source, sources (in order of arrival), n_rows and first_seq.
    """
    part = records.groupBy(*key, source).agg(
        F.min(seq).alias("_s"),
        F.count(F.lit(1)).alias("_n"),
        *[F.min(F.when(F.col(c).isNotNull(), F.struct(F.col(seq).alias("s"), F.col(c).alias("v")))).alias(c) for c in filled],
        *[F.min(F.when(F.size(c) > 0, F.struct(F.col(seq).alias("s"), F.col(c).alias("v")))).alias(c) for c in lists],
        *[F.coalesce(F.bool_or(F.col(c)), F.lit(False)).alias(c) for c in flags],
        *[F.min_by(F.struct(F.col(c)), seq).alias(c) for c in firsts],
    )
    return part.groupBy(*key).agg(
        F.min("_s").alias("first_seq"),
        F.sum("_n").alias("n_rows"),
        F.min_by(source, "_s").alias("first_seen_source"),
        ordered_sources(source, "_s").alias("sources"),
        *[F.min(c)["v"].alias(c) for c in filled],
        *[F.coalesce(F.min(c)["v"], F.array().cast("array<string>")).alias(c) for c in lists],
        *[F.bool_or(c).alias(c) for c in flags],
        *[F.min_by(c, "_s")[c].alias(c) for c in firsts],
    )


def outcomes(records: DataFrame, key: Sequence[str], seq: str = "seq") -> DataFrame:
    """Adds ``outcome``: the first row of a key (nulls are one) is *added*, the others are *merged*.

    The first rows find themselves by key and ``seq`` together, so that the rows of a frequent key are spread.
    """
    keys = [f"_k{i}" for i in range(len(key))]
    first = records.groupBy(*key).agg(F.min(seq).alias("_first")).toDF(*keys, "_first")
    same = [records[c].eqNullSafe(first[k]) for c, k in zip(key, keys, strict=True)] + [records[seq] == first["_first"]]
    found = records.join(first, functools.reduce(lambda x, y: x & y, same), "left")
    return found.withColumn("outcome", F.when(F.col("_first").isNotNull(), "added").otherwise("merged")).drop(*keys, "_first")


def insert_ignore(stored: DataFrame, incoming: DataFrame, key: Sequence[str], seq: str = "seq") -> DataFrame:
    """Rows of ``incoming`` whose key is neither stored nor taken by an earlier incoming row."""
    fresh = incoming.join(stored.select(*key).distinct(), list(key), "left_anti")
    columns = [c for c in fresh.columns if c not in key]
    row = F.min_by(F.struct(*columns), seq)
    return fresh.groupBy(*key).agg(row.alias("_r")).select(*key, *[F.col("_r")[c].alias(c) for c in columns])


def find_existing(stored: DataFrame, incoming: DataFrame) -> DataFrame:
    """Adds ``existing_id``: the stored row with the incoming DOI, else that with its PMID; blanks never match."""
    by_doi = stored.where("nullif(doi, '') is not null").select(F.col("doi").alias("_d"), F.col("id").alias("_id_doi"))
    by_pmid = stored.where("nullif(pmid, '') is not null").select(F.col("pmid").alias("_p"), F.col("id").alias("_id_pmid"))
    both = incoming.join(by_doi, F.col("doi") == F.col("_d"), "left").join(by_pmid, F.col("pmid") == F.col("_p"), "left")
    return both.withColumn("existing_id", F.coalesce("_id_doi", "_id_pmid")).drop("_d", "_p", "_id_doi", "_id_pmid")


def greedy_matching(edges: DataFrame, rounds: Rounds | None = None) -> DataFrame:
    """(seq, doi, pmid) of the edges that a pass in order of ``seq`` takes: those of which neither end is taken yet.

    In each round the edges that are among the first two of both their ends are looked at.  One that is first at both is
    taken; one with a single edge before it is taken if that one is not, so that such edges form chains, which pointer
    doubling follows to their heads in steps that double.  What touches a taken end is then dropped, and what is left
    makes the next round.  A chain of n edges takes log n steps; edges in random order some log n rounds.  (In the worst
    case, an order made so that most edges wait for two others, more: the problem is not known to have short rounds.)
    Nothing is gathered: an end of any number of edges gives its first two, found before the shuffle.
    """
    spark = edges.sparkSession
    rounds = rounds or Rounds(spark)
    taken = None
    # equal pairs but the first are never taken
    active = rounds.next("active", edges.groupBy("doi", "pmid").agg(F.min("seq").alias("seq")))
    while active.limit(1).count():
        near = []
        for end in ("doi", "pmid"):
            order = Window.partitionBy(end).orderBy("seq")
            first = active.select(end, "seq", F.row_number().over(order).alias(f"n_{end}"), F.min("seq").over(order).alias(f"first_{end}"))
            near.append(first.where(f"n_{end} <= 2"))
        before = F.col("n_doi") + F.col("n_pmid") - 2
        head = F.when(before == 1, F.when(F.col("n_doi") == 2, F.col("first_doi")).otherwise(F.col("first_pmid"))).otherwise(F.col("seq"))
        links = rounds.next("links", near[0].join(spread(near[1]), "seq").select("seq", "doi", "pmid", head.alias("head"), (before == 1).alias("flip"), (before == 0).alias("free")))
        while True:
            up = links.select(F.col("seq").alias("head"), F.col("head").alias("_head"), F.col("flip").alias("_flip"))
            moved = links.join(spread(up), "head", "left").select("seq", "doi", "pmid", F.coalesce("_head", "head").alias("head"), (F.col("flip") != F.coalesce("_flip", F.lit(False))).alias("flip"), "free", (F.coalesce("_head", "head") != F.col("head")).alias("moved"))
            if not moved.where("moved").limit(1).count():
                break
            links = rounds.next("links", moved.drop("moved"))
        heads = links.where("free").select(F.col("seq").alias("head"))
        found = cut(links.where("not flip").join(spread(heads), "head", "left_semi").select("seq", "doi", "pmid"))
        taken = found if taken is None else taken.unionByName(found)
        active = rounds.next("active", active.join(spread(found.select("doi")), "doi", "left_anti").join(spread(found.select("pmid")), "pmid", "left_anti"))
    rounds.drop("active", "links")
    return spark.createDataFrame([], "seq long, doi string, pmid string") if taken is None else taken


def resolve(records: DataFrame, claims: DataFrame | None = None, rounds: Rounds | None = None) -> tuple[DataFrame, DataFrame]:
    """The sequential merge on two keys, over a store: (outcomes, changes), both written.

    Rows come in order of ``seq`` (distinct) to a store with two unique columns: a row joins the publication with its
    DOI, else that with its PMID, else it is added; a null identifier is filled; a fill that would repeat another
    publication's identifier makes the row ``failed``.  Blank identifiers match nothing.

    ``claims``: (kind, value, id, full) of the store's identifiers; ``full`` if their publication has both.
    outcomes: (seq, id, publication, outcome); ``id`` is a stored publication, otherwise ``publication`` is the seq of
    the row that was added.  changes: (kind, value, id, publication, full) of identifiers that are new or full now.

    No row waits for its turn.  An identifier is unclaimed, *open* (its publication lacks the other) or *full*, and once
    full it never changes.  Rows with one identifier open it at best, so the first of them tells since when.  A row with
    both makes both full, unless one is full already or both are open; rows that come after both were opened change
    nothing.  So the rows that fill or add a pair are a greedy matching in order of ``seq`` (``greedy_matching``), and every row's
    outcome follows from the times at which its two identifiers were opened and filled.
    """
    spark = records.sparkSession
    blank = lambda c: F.nullif(F.col(c).cast("string"), F.lit("")).alias(c)
    rows = cut(records.select(F.col("seq").cast("long").alias("seq"), blank("doi"), blank("pmid")))
    if claims is None:
        claims = spark.createDataFrame([], "kind string, value string, id long, full boolean")
    known = cut(claims.groupBy("kind", "value").agg(F.max("id").alias("id"), F.max("full").alias("full")))

    state = {}
    for end, other in (("doi", "pmid"), ("pmid", "doi")):
        alone = rows.where(f"{end} is not null and {other} is null").groupBy(end).agg(F.min("seq").alias("opened"))
        stored = known.where(F.col("kind") == end).select(F.col("value").alias(end), "id", "full")
        state[end] = cut(alone.join(spread(stored), end, "full").select(end, F.when(F.col("id").isNull(), F.col("opened")).alias(f"{end}_opened"), F.col("id").alias(f"{end}_id"), F.coalesce("full", F.lit(False)).alias(f"{end}_full")))

    def open_before(end: str) -> Column:
        return F.col(f"{end}_id").isNotNull() | F.coalesce(F.col(f"{end}_opened") < F.col("seq"), F.lit(False))

    pairs = rows.where("doi is not null and pmid is not null").groupBy("doi", "pmid").agg(F.min("seq").alias("seq"))
    both = pairs.join(spread(state["doi"]), "doi", "left").join(spread(state["pmid"]), "pmid", "left")
    both = both.where(~F.coalesce("doi_full", F.lit(False)) & ~F.coalesce("pmid_full", F.lit(False)) & ~(open_before("doi") & open_before("pmid")))
    taken = greedy_matching(both.select("seq", "doi", "pmid"), rounds)
    owner = lambda end: F.when(open_before(end), F.struct(F.col(f"{end}_id").alias("id"), F.when(F.col(f"{end}_id").isNull(), F.col(f"{end}_opened")).alias("seq")))
    fresh = F.struct(F.lit(None).cast("long").alias("id"), F.col("seq"))
    matched = cut(taken.join(spread(state["doi"]), "doi", "left").join(spread(state["pmid"]), "pmid", "left").select("seq", "doi", "pmid", F.coalesce(owner("doi"), owner("pmid"), fresh).alias("owner")))

    held, changes = {}, []
    for end in ("doi", "pmid"):
        filled = matched.select(end, F.col("seq").alias(f"{end}_filled"), F.col("owner").alias(f"{end}_owner"))
        held[end] = cut(state[end].join(spread(filled), end, "full"))
        now = F.col(f"{end}_filled").isNotNull()
        mine = F.when(now, F.col(f"{end}_owner")).otherwise(F.struct(F.col(f"{end}_id").alias("id"), F.col(f"{end}_opened").alias("seq")))
        new = held[end].where(now | (F.col(f"{end}_id").isNull() & F.col(f"{end}_opened").isNotNull()))
        changes.append(new.select(F.lit(end).alias("kind"), F.col(end).alias("value"), mine["id"].alias("id"), mine["seq"].alias("publication"), now.alias("full")))

    joined = rows.join(spread(held["doi"]), "doi", "left").join(spread(held["pmid"]), "pmid", "left")
    full, by = {}, {}
    for end in ("doi", "pmid"):
        full[end] = F.coalesce(F.col(f"{end}_full"), F.lit(False)) | F.coalesce(F.col(f"{end}_filled") < F.col("seq"), F.lit(False))
        opened = F.when(open_before(end), F.struct(F.col(f"{end}_id").alias("id"), F.when(F.col(f"{end}_id").isNull(), F.col(f"{end}_opened")).alias("seq")))
        by[end] = F.when(F.coalesce(F.col(f"{end}_filled") < F.col("seq"), F.lit(False)), F.col(f"{end}_owner")).otherwise(opened)
    joined = joined.withColumns({"by_doi": by["doi"], "by_pmid": by["pmid"], "full_doi": full["doi"]})
    mine = F.col("doi_filled") == F.col("seq")
    target = F.when(mine, F.col("doi_owner")).otherwise(F.coalesce("by_doi", "by_pmid", F.struct(F.lit(None).cast("long").alias("id"), F.col("seq"))))
    failed = ~F.coalesce(mine, F.lit(False)) & ~F.col("full_doi") & F.col("by_doi").isNotNull() & F.col("by_pmid").isNotNull()
    done = joined.withColumn("target", target).select("seq", F.col("target.id").alias("id"), F.col("target.seq").alias("publication"), failed.alias("failed"))
    added = F.col("id").isNull() & (F.col("publication") == F.col("seq"))
    outcome = F.when(F.col("failed"), "failed").when(added, "added").otherwise("merged")
    return cut(done.select("seq", "id", "publication", outcome.alias("outcome"))), cut(changes[0].unionByName(changes[1]))


def merge_records(records: DataFrame) -> DataFrame:
    """The sequential merge on two keys without a store (``resolve``): every row's (seq, publication, outcome)."""
    return resolve(records)[0].select("seq", "publication", "outcome")
