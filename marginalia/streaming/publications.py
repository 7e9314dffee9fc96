"""Publication sources as a stream: offsets of (source, day, cursor), batches into the store, progress into a table.

An offset says, for each source, the day that is being read and how many of its records have been: all days before it
are complete.  A batch is the records between two offsets, a partition for each (source, day), which can be read again
as long as the log of offsets may ask for it; so a query that is stopped and started goes on where it was, and reads
nothing twice but what had not been committed.
"""

from __future__ import annotations

import datetime
import json
from collections.abc import Callable, Iterator
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceStreamReader, InputPartition
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.listener import StreamingQueryListener

from marginalia.operators.record_store import RecordStore
from marginalia.operators.shared import exists
from marginalia.sources.sync import DAY_RECORDS, decode

ROWS = "source string, day string, seq long, json string"
PROGRESS = "query string, run string, batch long, at timestamp, rows long, offsets string, ended boolean, error string"


@dataclass(frozen=True)
class StreamTransport:
    """How a source is read: how many records a day has so far, and the records from one number up to another (None: all)."""

    reach: Callable[[str], int]
    records: Callable[[str, int, int | None], list]
    commit: Callable[[str, int], None] | None = None


class Span(InputPartition):
    def __init__(self, no: int, source: str, day: str, start: int, stop: int | None):
        super().__init__(no)
        self.no, self.source, self.day, self.start, self.stop = no, source, day, start, stop


def spans(start: dict, end: dict) -> list[Span]:
    """What lies between two offsets: whole days up to the last, of which a part."""
    found = []
    for source in sorted(end):
        to = end[source]
        since = start.get(source, to)
        day, last = (datetime.date.fromisoformat(x["day"]) for x in (since, to))
        while day <= last:
            a = since["cursor"] if day.isoformat() == since["day"] else 0
            b = to["cursor"] if day == last else None
            if b is None or b > a:
                found.append(Span(len(found), source, day.isoformat(), a, b))
            day += datetime.timedelta(1)
    return found


def stream_source(transports: dict[str, StreamTransport]) -> type[DataSource]:
    """``format("publication_stream")``; options: first day, and the last (today by default)."""

    class PublicationStream(DataSource):
        @classmethod
        def name(cls) -> str:
            return "publication_stream"

        def schema(self) -> str:
            return ROWS

        def streamReader(self, schema) -> DataSourceStreamReader:
            first, last = self.options["first"], self.options.get("last")

            class Reader(DataSourceStreamReader):
                def initialOffset(self) -> dict:
                    return {s: {"day": first, "cursor": 0} for s in transports}

                def latestOffset(self) -> dict:
                    day = last or datetime.datetime.now(datetime.UTC).date().isoformat()
                    return {s: {"day": max(first, day), "cursor": t.reach(max(first, day))} for s, t in transports.items()}

                def partitions(self, start: dict, end: dict) -> list[Span]:
                    return spans(start, end)

                def read(self, partition: Span) -> Iterator[tuple]:
                    found = transports[partition.source].records(partition.day, partition.start, partition.stop)
                    for i, r in enumerate(found):
                        yield partition.source, partition.day, partition.no * DAY_RECORDS + i, r if isinstance(r, str) else json.dumps(r)

                def commit(self, end: dict) -> None:
                    for s, t in transports.items():
                        if t.commit and s in end:
                            t.commit(end[s]["day"], end[s]["cursor"])

            return Reader()

    return PublicationStream


def read_stream(spark: SparkSession, transports: dict[str, StreamTransport], first: str, last: str | None = None) -> DataFrame:
    spark.dataSource.register(stream_source(transports))
    reader = spark.readStream.format("publication_stream").option("first", first)
    return (reader.option("last", last) if last else reader).load()


def into_store(stream: DataFrame, store: RecordStore, checkpoint: str, first_batch: int = 0, available_now: bool = True, make: Callable[[DataFrame], DataFrame] = decode) -> StreamingQuery:
    """Adds each batch of a stream to the store under its number, from ``first_batch`` on.

    A batch that is delivered again overwrites its own partition of the store: it is there once.
    """

    def run(rows: DataFrame, n: int) -> None:
        good = make(rows).where("ok").drop("day", "fulltext", "ok")
        store.add(first_batch + n, good)

    writer = stream.writeStream.foreachBatch(run).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if available_now else writer).start()


class ProgressTable(StreamingQueryListener):
    """Writes what queries report to a table: every batch with rows and offsets, and each query's end.

    Register with ``spark.streams.addListener``; ``recentProgress`` of a query forgets, the table does not.
    """

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path

    def _note(self, *row: object) -> None:
        self.spark.createDataFrame([row], PROGRESS).coalesce(1).write.mode("append").parquet(self.path)

    def onQueryStarted(self, event) -> None:
        pass

    def onQueryProgress(self, event) -> None:
        p = event.progress
        ends = json.dumps([s.endOffset for s in p.sources])
        self._note(str(p.id), str(p.runId), p.batchId, datetime.datetime.fromisoformat(p.timestamp.replace("Z", "+00:00")), p.numInputRows, ends, False, None)

    def onQueryIdle(self, event) -> None:
        pass

    def onQueryTerminated(self, event) -> None:
        self._note(str(event.id), str(event.runId), None, datetime.datetime.now(datetime.UTC), None, None, True, event.exception)

    def rows(self) -> DataFrame:
        """(query, batch, rows, offsets) of the batches that were worked off, each once: a batch may be reported again."""
        if not exists(self.spark, self.path):
            return self.spark.createDataFrame([], "query string, batch long, rows long, offsets string")
        told = self.spark.read.schema(PROGRESS).parquet(self.path).where("not ended and rows > 0")
        return told.groupBy("query", "batch").agg(F.max_by("rows", "at").alias("rows"), F.max_by("offsets", "at").alias("offsets"))
