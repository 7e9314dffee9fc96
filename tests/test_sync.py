import os
import random
import tempfile
from collections import Counter

import pytest

from marginalia.operators.record_store import RecordStore
from marginalia.sources import registry
from marginalia.sources.sync import stored_days, sync

NOW = "2024-06-12 08:00:00"


@pytest.fixture
def store(spark):
    return RecordStore(spark, f"sync{random.randrange(1 << 40):x}", tempfile.mkdtemp(prefix="spark-"), 2)


@pytest.fixture
def sources():
    """Registers transports for one test."""
    before = dict(registry._SOURCES)
    yield lambda name, transport, **kw: registry.register_source(registry.SourceDescriptor(name, name.title(), **kw), transport)
    registry._SOURCES.clear()
    registry._SOURCES.update(before)


def record(n, **more):
    return {"title": f"Paper {n}", "doi": f"10.1/{n}", "authors": ["A", "B"]} | more


def ledger_of(store):
    return {(r["source"], r["day"].isoformat()): (r["status"], r["record_count"]) for r in stored_days(store).collect()}


def test_records_are_stored_and_the_day_is_noted(spark, store, sources):
    log = tempfile.mkdtemp(prefix="spark-")

    def pages(day, token, options):
        open(os.path.join(log, f"{day}-{token}-{random.random()}"), "w").close()
        page = int(token or 0)
        found = [record(f"{day}.{page}.{i}", fulltext_sources=[{"url": f"u{page}{i}"}, {"url": f"u{page}{i}", "format": "pdf"}]) for i in range(2)]
        return found, None if page == 1 else str(page + 1)

    sources("one", pages)
    done = sync(store, 0, "2024-06-10", "2024-06-11", NOW, ["one"])
    assert done.report.asDict() == {"sources_synced": ["one"], "days_processed": 2, "records_added": 8, "records_merged": 0, "records_failed": 0, "errors": []}
    assert ledger_of(store) == {("one", "2024-06-10"): ("completed", 4), ("one", "2024-06-11"): ("completed", 4)}
    assert len(os.listdir(log)) == 4  # each page is fetched once, however much is made of it
    assert [r["title"] for r in store.find("doi", "10.1/2024-06-10.1.0").collect()] == ["Paper 2024-06-10.1.0"]
    assert Counter((r["source"], r["format"]) for r in store.sources().collect()) == {("unknown", "html"): 8}
    # completed days are passed over, today is not
    again = sync(store, 1, "2024-06-10", "2024-06-12", NOW, ["one"])
    assert (again.report["days_processed"], len(os.listdir(log))) == (1, 6)


def test_a_failing_day_keeps_its_part_and_stops_nothing(spark, store, sources):
    def pages(day, token, options):
        if day.endswith("11") and token:
            raise TimeoutError("no answer")
        return [record(f"{day}{token}")], None if token else "more"

    sources("shaky", pages)
    done = sync(store, 0, "2024-06-10", "2024-06-12", NOW, ["shaky"])
    assert (done.report["days_processed"], done.report["records_added"]) == (3, 5)
    assert done.errors == ["shaky/2024-06-11: TimeoutError: no answer"]
    assert ledger_of(store)["shaky", "2024-06-11"] == ("failed", 1)
    assert ledger_of(store)["shaky", "2024-06-12"] == ("completed", 2)
    # the failed day is due again: its first record merges
    again = sync(store, 1, "2024-06-10", "2024-06-11", NOW, ["shaky"])
    assert (again.report["days_processed"], again.report["records_added"], again.report["records_merged"]) == (1, 0, 1)


def test_duplicates_merge_over_sources_in_their_order(spark, store, sources):
    sources("b", lambda day, token, options: ([record(1, abstract="of b", pmid="7")], None))
    sources("a", lambda day, token, options: ([record(1, abstract=options["word"])], None), params=(registry.SourceParam("word", required=True),))
    done = sync(store, 0, "2024-06-10", "2024-06-10", NOW, ["b", "a"], {"a": {"word": "of a"}})
    assert (done.report["records_added"], done.report["records_merged"], done.report["sources_synced"]) == (1, 1, ["a", "b"])
    r = store.publications().first()
    assert (r["abstract"], r["sources"], r["first_seen_source"], r["pmid"]) == ("of b", ["b", "a"], "b", "7")
    with pytest.raises(ValueError, match="word"):
        sync(store, 1, "2024-06-10", "2024-06-10", NOW, ["a"])


def test_empty_days_bad_records_and_unknown_sources(spark, store, sources):
    bad = ["no json", {"doi": "10.1/untitled"}, record(2, fulltext_sources=[{"format": "pdf"}]), record(3)]
    sources("none", lambda day, token, options: ([], None))
    sources("bad", lambda day, token, options: (bad, None))
    done = sync(store, 0, "2024-06-10", "2024-06-10", NOW, ["none", "nowhere", "bad"])
    assert (done.report["days_processed"], done.report["records_added"], done.report["records_failed"]) == (2, 1, 3)
    assert done.errors == ["No fetcher found for source: nowhere"] and done.report["sources_synced"] == ["bad", "none"]
    assert ledger_of(store) == {("none", "2024-06-10"): ("completed", 0), ("bad", "2024-06-10"): ("completed", 1)}
    nothing = sync(store, 1, "2024-06-10", "2024-06-10", NOW, ["none", "bad"])
    assert nothing.report["days_processed"] == 0 and nothing.report["sources_synced"] == ["bad", "none"]


def test_recheck(spark, store, sources):
    sources("old", lambda day, token, options: ([record(day)], None))
    sync(store, 0, "2024-06-01", "2024-06-02", "2024-06-03 00:00:00", ["old"])
    assert sync(store, 1, "2024-06-01", "2024-06-02", NOW, ["old"], recheck_days=30).report["days_processed"] == 0
    assert sync(store, 2, "2024-06-01", "2024-06-02", NOW, ["old"], recheck_days=5).report["records_merged"] == 2


def test_a_batch_that_runs_again(spark, store, sources):
    sources("s", lambda day, token, options: ([record(i) for i in range(3)], None))
    first = sync(store, 0, "2024-06-10", "2024-06-10", NOW, ["s"])
    again = sync(store, 0, "2024-06-10", "2024-06-10", NOW, ["s"])
    assert first.report == again.report and store.publications().count() == 3 and len(ledger_of(store)) == 1
