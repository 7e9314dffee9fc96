import json
import os
import random
import tempfile
import time

import pytest

from marginalia.operators.record_store import RecordStore
from marginalia.streaming.publications import ProgressTable, StreamTransport, into_store, read_stream, spans


class Days:
    """A source in a folder: a file of records for each day, which may grow; what is read is noted."""

    def __init__(self):
        self.path = tempfile.mkdtemp(prefix="spark-")
        self.log = tempfile.mkdtemp(prefix="spark-")

    def add(self, day, *names):
        with open(f"{self.path}/{day}", "a") as f:
            f.writelines(json.dumps({"title": n, "doi": f"10.1/{n}"}) + "\n" for n in names)

    def transport(self):
        path, log = self.path, self.log

        def lines(day):
            return open(f"{path}/{day}").read().splitlines() if os.path.exists(f"{path}/{day}") else []

        def records(day, start, stop):
            found = lines(day)[start:stop]
            for i in range(len(found)):
                open(f"{log}/{day}.{start + i}.{random.random()}", "w").close()
            return found

        def commit(day, cursor):
            open(f"{log}/commit.{day}.{cursor}", "w").close()

        return StreamTransport(lambda day: len(lines(day)), records, commit)

    def read(self):
        return sorted(x.rsplit(".", 2)[0] for x in os.listdir(self.log) if not x.startswith("commit"))


def test_spans():
    at = lambda day, cursor: {"s": {"day": f"2024-01-{day:02}", "cursor": cursor}}
    show = lambda a, b: [(x.day[-2:], x.start, x.stop) for x in spans(a, b)]
    assert show(at(1, 0), at(1, 0)) == [] and show(at(1, 2), at(1, 5)) == [("01", 2, 5)]
    assert show(at(1, 2), at(3, 4)) == [("01", 2, None), ("02", 0, None), ("03", 0, 4)]
    assert show(at(30, 1), at(31, 0)) == [("30", 1, None)]


@pytest.fixture
def listener(spark):
    table = ProgressTable(spark, f"{tempfile.mkdtemp(prefix='spark-')}/progress")
    spark.streams.addListener(table)
    yield table
    spark.streams.removeListener(table)


def test_restart_reads_nothing_twice(spark, listener):
    source, store = Days(), RecordStore(spark, f"stream{random.randrange(1 << 40):x}", tempfile.mkdtemp(prefix="spark-"), 2)
    checkpoint = tempfile.mkdtemp(prefix="spark-")

    def run(last):
        query = into_store(read_stream(spark, {"days": source.transport()}, "2024-06-01", last), store, checkpoint)
        query.awaitTermination()
        return str(query.id)

    source.add("2024-06-01", "a", "b")
    source.add("2024-06-02", "c")
    run("2024-06-02")
    assert source.read() == ["2024-06-01.0", "2024-06-01.1", "2024-06-02.0"]
    source.add("2024-06-02", "d")  # the open day grows
    source.add("2024-06-04", "e", "a")
    query = run("2024-06-04")
    assert source.read() == ["2024-06-01.0", "2024-06-01.1", "2024-06-02.0", "2024-06-02.1", "2024-06-04.0", "2024-06-04.1"]
    run("2024-06-04")
    assert len(source.read()) == 6
    assert sorted(r["doi"] for r in store.publications().collect()) == [f"10.1/{x}" for x in "abcde"]
    assert store.publications().where("doi = '10.1/a'").first()["n_rows"] == 2
    deadline = time.time() + 30
    while time.time() < deadline and listener.rows().count() < 2:
        time.sleep(0.5)
    told = listener.rows().orderBy("batch").collect()
    assert [(r["query"], r["rows"]) for r in told] == [(query, 3), (query, 3)]
    assert '2024-06-04' in told[1]["offsets"]


def test_a_batch_that_failed_is_read_again_and_stored_once(spark):
    source, store = Days(), RecordStore(spark, f"stream{random.randrange(1 << 40):x}", tempfile.mkdtemp(prefix="spark-"), 2)
    checkpoint, write = tempfile.mkdtemp(prefix="spark-"), store._write
    source.add("2024-06-01", "a", "b")

    def lost(which, frame, batch):
        if which == "identifiers":
            raise RuntimeError("lost")
        write(which, frame, batch)

    store._write = lost
    with pytest.raises(Exception, match="lost"):
        into_store(read_stream(spark, {"days": source.transport()}, "2024-06-01", "2024-06-01"), store, checkpoint).awaitTermination()
    store._write = write
    source.add("2024-06-01", "c")  # not part of the batch that is repeated
    for want in (["a", "b"], ["a", "b", "c"]):
        into_store(read_stream(spark, {"days": source.transport()}, "2024-06-01", "2024-06-01"), store, checkpoint).awaitTermination()
        assert sorted((r["doi"], r["n_rows"]) for r in store.publications().collect()) == [(f"10.1/{x}", 1) for x in want]
