import random
import re
import tempfile
from collections import Counter

import pytest

from pyspark.sql import functions as F

from marginalia.operators import merge, record_store
from marginalia.operators.record_store import FIELDS, RecordStore
from marginalia.operators.shared import Rounds, cut

from .test_merge import sequential


def records(spark, rows, source="s"):
    """(seq, doi, pmid) rows with the other fields made from ``seq``."""
    full = [(i, f"{source}{i % 3}", f"T{i}", doi, pmid, f"A{i}" if i % 4 else None, None, None, None, [f"w{i}"] if i % 5 else [], [], [], i % 7 == 0) for i, doi, pmid in rows]
    return spark.createDataFrame(full, FIELDS)


def store_at(spark, buckets=4):
    name = f"t{random.randrange(1 << 40):x}"
    return RecordStore(spark, name, tempfile.mkdtemp(prefix="spark-"), buckets)


def random_rows(seed, n, keys):
    rng = random.Random(seed)
    pick = lambda p: rng.choice([None, "", *[f"{p}{i}" for i in range(keys)]])
    return [(i, pick("d"), pick("p")) for i in range(n)]


def check(got, rows, ids):
    """Outcomes of the store against the sequential one; ids name the same publications."""
    want = sequential(rows)
    for r in got:
        publication, outcome = want[r["seq"]]
        assert r["outcome"] == outcome, r
        assert ids.setdefault(publication, r["id"]) == r["id"], r
    assert len(set(ids.values())) == len(ids)


@pytest.mark.parametrize("cuts", [(1, 60, 120)])
def test_batches_equal_one_batch(spark, cuts):
    rows, store, got, at = random_rows(4, 120, 25), store_at(spark), [], 0
    for n, end in enumerate(cuts):
        got += store.add(n, records(spark, rows[at:end])).collect()
        at = end
    ids = {}
    check(got, rows, ids)
    one = store_at(spark)
    one.add(0, records(spark, rows))
    fields = ["id", "title", "doi", "pmid", "abstract", "authors", "is_open_access", "sources", "first_seen_source", "n_rows"]
    view = lambda s: sorted(map(repr, s.publications().select(*fields).collect()))
    assert view(store) == view(one)
    # every identifier belongs to one publication, and is what the publication has
    index = {r["key"]: (r["id"], r["full"]) for r in store.identifiers().collect()}
    assert index == {f"{k}:{r[k]}": (r["id"], bool(r["doi"] and r["pmid"])) for r in store.publications().collect() for k in ("doi", "pmid") if r[k]}


def test_a_batch_that_runs_again_changes_nothing(spark):
    rows, store = random_rows(8, 80, 20), store_at(spark)
    store.add(0, records(spark, rows[:40]))
    first = store.add(1, records(spark, rows[40:])).collect()
    before = Counter(map(repr, store.publications().collect()))
    assert Counter(store.add(1, records(spark, rows[40:])).collect()) == Counter(first)
    assert Counter(map(repr, store.publications().collect())) == before


def test_batch_lost_between_its_writes(spark, monkeypatch):
    """The log is written, the identifiers are not: the batch runs again and gives what it would have given."""
    rows, store = random_rows(9, 60, 15), store_at(spark)
    store.add(0, records(spark, rows[:30]))
    write = store._write

    def lost(which, frame, batch):
        if which == "identifiers":
            raise RuntimeError("lost")
        write(which, frame, batch)

    monkeypatch.setattr(store, "_write", lost)
    with pytest.raises(RuntimeError, match="lost"):
        store.add(1, records(spark, rows[30:]))
    monkeypatch.setattr(store, "_write", write)
    check(store.add(0, records(spark, rows[:30])).collect() + store.add(1, records(spark, rows[30:])).collect(), rows, {})


def test_store_is_opened_again_with_its_number_of_buckets(spark):
    store = store_at(spark)
    store.add(0, records(spark, [(1, "a", None), (2, None, "x")]))
    again = RecordStore(spark, store.name + "b", store.path, 4)
    assert {(r["key"], r["id"]) for r in again.identifiers().collect()} == {("doi:a", 1), ("pmid:x", 2)}
    assert [r["outcome"] for r in again.add(1, records(spark, [(1, "a", "x"), (2, "a", "y")])).orderBy("seq").collect()] == ["failed", "merged"]
    with pytest.raises(ValueError, match="4 buckets"):
        RecordStore(spark, store.name + "c", store.path, 8)


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_store_is_not_shuffled(spark):
    """The batch's side is dealt to the buckets; between the scans of the store and the join there is no exchange."""
    store = store_at(spark)
    store.add(0, records(spark, random_rows(1, 60, 12)))
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        text = plan(store.claims(1, records(spark, random_rows(2, 10, 12))))
        scan = text.splitlines().index(next(x for x in text.splitlines() if "FileScan parquet" in x))
        depth = lambda line: len(re.match(r"[ :+|*-]*", line)[0])
        lines, at, above = text.splitlines(), scan, []
        for i in range(scan, -1, -1):  # from the scan up to the root
            if depth(lines[i]) < depth(lines[at]) or i == scan:
                at = i
                above.append(lines[i])
        assert any("Join" in x for x in above) and not any("Exchange" in x for x in above), text
        assert "Exchange hashpartitioning(key" in text  # the batch's side
        assert "Exchange" not in plan(store.publications())
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
        spark.conf.unset("spark.sql.adaptive.enabled")


def test_lookup_opens_one_bucket(spark):
    store = store_at(spark, 16)
    store.add(0, records(spark, [(i, f"d{i}", f"p{i}" if i % 2 else None) for i in range(64)]))
    found = store.find("doi", "d7")
    assert [(r["title"], r["doi"], r["pmid"]) for r in found.collect()] == [("T7", "d7", "p7")]
    assert re.search(r"SelectedBucketsCount: 1 out of 16", plan(found))
    named = store.identifiers().where("key = 'doi:d7'")
    assert "SelectedBucketsCount: 1 out of 16" in plan(named) and "EqualTo(key,doi:d7)" in plan(named)
    assert store.find("pmid", "d7").collect() == [] and store.find("doi", "").collect() == []


def test_full_text_addresses_are_kept_once(spark):
    store, ddl = store_at(spark), "publication_id long, url string, seq long, source string, format string, version string"
    store.add_sources(0, spark.createDataFrame([(1, "u", 2, "b", "pdf", None), (1, "u", 1, "a", "xml", None), (1, "v", 3, "a", "html", "v1")], ddl))
    store.add_sources(1, spark.createDataFrame([(1, "u", 0, "c", "pdf", None), (2, "u", 1, "c", "pdf", None)], ddl))
    assert {tuple(r) for r in store.sources().collect()} == {(1, "u", "a", "xml", None), (1, "v", "a", "html", "v1"), (2, "u", "c", "pdf", None)}


def test_empty_batches(spark):
    store = store_at(spark)
    assert store.add(0, records(spark, [])).collect() == []
    assert store.add(1, records(spark, [(5, None, None), (6, "", "")])).select("id", "outcome").orderBy("id").collect() == [(1, "added"), (2, "added")]
    assert store.add(2, records(spark, [])).collect() == [] and store.publications().count() == 2


@pytest.mark.parametrize("seed", [1, 3])
def test_resolve_equals_sequential_store(spark, seed):
    rows = random_rows(100 + seed, 250, (6, 20, 60, 120)[seed])
    got = merge.merge_records(records(spark, rows)).collect()
    assert {r["seq"]: (r["publication"], r["outcome"]) for r in got} == sequential(rows)


def sequential_chain(rows):
    """``sequential`` with dictionaries, for rows with both identifiers."""
    held, out = {}, {}
    for i, doi, pmid in rows:
        target = held.get(("d", doi), held.get(("p", pmid)))
        out[i] = (i, "added") if target is None else (target, "merged")
        if target is None:
            held["d", doi] = held["p", pmid] = i
    return out


def test_chain_of_ten_thousand_rows_takes_log_rounds(spark):
    rows = [(i, f"c{(i + 1) // 2}", f"q{i // 2}") for i in range(10_000)]
    frame = spark.createDataFrame(rows, "seq long, doi string, pmid string")
    rounds = Rounds(spark)
    got = {r["seq"]: (r["publication"], r["outcome"]) for r in merge.resolve(frame, rounds=rounds)[0].collect()}
    assert rounds.written <= 30
    assert got == sequential_chain(rows)


def test_rounds_leave_no_old_tables(spark):
    rounds = Rounds(spark)
    merge.greedy_matching(spark.createDataFrame([(i, f"d{(i + 1) // 2}", f"p{i // 2}") for i in range(40)], "seq long, doi string, pmid string"), rounds).count()
    assert rounds.paths == {} and rounds.written > 4


def test_hot_identifier(spark):
    """A DOI that two thirds of the rows share, and as many PMIDs."""
    rows = [(i, "hot" if i % 3 else f"d{i}", f"p{i % 50}") for i in range(300)]
    got = merge.merge_records(records(spark, rows)).collect()
    assert {r["seq"]: (r["publication"], r["outcome"]) for r in got} == sequential(rows)


def test_only_counts_of_partitions_are_broadcast(spark, monkeypatch):
    """Spark judges written tables by the bytes of their files, under which millions of rows would go through the driver."""
    seen = []

    class Seen(Rounds):
        def next(self, name, df):
            seen.append(plan(df))
            return super().next(name, df)

    for module in (merge, record_store):
        monkeypatch.setattr(module, "cut", lambda df: (seen.append(plan(df)), cut(df))[1])
    store = store_at(spark)
    write = store._write
    monkeypatch.setattr(store, "_write", lambda which, rows, batch: (seen.append(plan(rows)), write(which, rows, batch)))
    rows = random_rows(11, 80, 20)
    for batch, part in enumerate((rows[:40], rows[40:])):
        seen.clear()
        seen.append(plan(store.add(batch, records(spark, part), Seen(spark))))
        assert len(seen) > 12 and sum(x.count("Join") for x in seen) > 12
        assert [x for x in seen if "Broadcast" in x and "_before" not in x] == []
        assert sum(x.count("BroadcastExchange") for x in seen) == 1
