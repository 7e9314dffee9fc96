"""Synchronising sources with the store as one planned scan.

The ledger says which (source, day) pairs are due; each is a partition of the read, fetched where a task runs.  A day
ends with a row of its own that says how it went, so that one that fails keeps what it has fetched and stops nothing
else.  What was read is written once; records, outcomes, counts and the ledger's new rows follow from that table, and a
batch that is lost half way runs again under its number.
"""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from marginalia.operators import ledger
from marginalia.operators.record_store import FIELDS, RecordStore
from marginalia.operators.shared import cut, exists
from marginalia.sources import registry

#: What a transport gives for each record (as a dictionary or as JSON); more fields may follow.
RECORD = "title string, doi string, pmid string, pmc_id string, abstract string, authors array<string>, journal string, publication_date string, keywords array<string>, publication_types array<string>, is_open_access boolean, license string, fulltext_sources array<struct<url:string,format:string,source:string,version:string>>"
DAYS = "source string, day date, status string, record_count long, downloaded_at timestamp, last_verified timestamp"
ROWS = "no int, source string, day string, seq long, json string, status string, error string"
#: Records of a day, at most; a day's place and a record's place in it make its number.
DAY_RECORDS = 1 << 32


class DueDay(InputPartition):
    def __init__(self, no: int, source: str, day: str):
        super().__init__(no)
        self.no, self.source, self.day = no, source, day


def day_rows(no: int, source: str, day: str, transport: registry.Transport, options: dict[str, str]) -> Iterator[tuple]:
    """A day's records in order of arrival, then a row with its status and what went wrong."""
    token, at = None, 0
    try:
        while True:
            records, token = transport(day, token, options)
            for r in records:
                yield no, source, day, no * DAY_RECORDS + at, r if isinstance(r, str) else json.dumps(r), None, None
                at += 1
            if token is None:
                break
    except Exception as e:  # whatever a source does, the other days go on
        yield no, source, day, None, None, "failed", f"{type(e).__name__}: {e}"
    else:
        yield no, source, day, None, None, "completed", None


def days_source(transports: dict[str, registry.Transport]) -> type[DataSource]:
    """``format("due_days")``: a partition for each (source, day) of the option ``due``; ``configs`` holds each source's options."""

    class DueDays(DataSource):
        @classmethod
        def name(cls) -> str:
            return "due_days"

        def schema(self) -> str:
            return ROWS

        def reader(self, schema) -> DataSourceReader:
            due, configs = json.loads(self.options["due"]), json.loads(self.options["configs"])

            class Reader(DataSourceReader):
                def partitions(self) -> list[DueDay]:
                    return [DueDay(i, s, d) for i, (s, d) in enumerate(due)]

                def read(self, partition: DueDay) -> Iterator[tuple]:
                    yield from day_rows(partition.no, partition.source, partition.day, transports[partition.source], configs.get(partition.source, {}))

            return Reader()

    return DueDays


def fetch(spark: SparkSession, due: Sequence[tuple[str, str]], transports: dict[str, registry.Transport], configs: dict[str, dict[str, str]] | None = None) -> DataFrame:
    """Rows of all due days (``ROWS``): fetched once, and written."""
    if not due:
        return spark.createDataFrame([], ROWS)
    spark.dataSource.register(days_source(transports))
    return cut(spark.read.format("due_days").options(due=json.dumps(due), configs=json.dumps(configs or {})).load())


def decode(rows: DataFrame) -> DataFrame:
    """Records of ``rows`` as the store takes them, with ``fulltext``; ``ok`` is false for one without a title, for what is no JSON object, and where an address is missing."""
    r = F.from_json("json", RECORD)
    texts = {n: F.col("r")[n].alias(n) for n in ("title", "doi", "pmid", "abstract", "journal", "publication_date", "license")}
    lists = {n: F.coalesce(F.col("r")[n], F.array().cast("array<string>")).alias(n) for n in ("authors", "publication_types", "keywords")}
    addresses = F.coalesce(F.col("r.fulltext_sources"), F.array())
    ok = F.col("r.title").isNotNull() & F.forall(addresses, lambda x: x["url"].isNotNull())
    columns = texts | lists | {"is_open_access": F.coalesce(F.col("r.is_open_access"), F.lit(False)).alias("is_open_access")}
    names = [f.strip().split(" ")[0] for f in FIELDS.split(", ") if not f.startswith(("seq ", "source "))]
    return rows.withColumn("r", r).select("seq", "source", "day", *[columns[n] for n in names], addresses.alias("fulltext"), F.coalesce(ok, F.lit(False)).alias("ok"))


def stored_days(store: RecordStore, before: int | None = None) -> DataFrame:
    """The ledger (``DAYS``): the last word on each (source, day), of the batches before one, or of all."""
    path = f"{store.path}/days"
    if not exists(store.spark, path):
        return store.spark.createDataFrame([], DAYS)
    rows = store.spark.read.schema(f"{DAYS}, batch long").parquet(path)
    rows = rows if before is None else rows.where(F.col("batch") < before)
    rest = [c.split(" ")[0] for c in DAYS.split(", ")][2:]
    return rows.groupBy("source", "day").agg(F.max_by(F.struct(*rest), "batch").alias("r")).select("source", "day", *[F.col("r")[c].alias(c) for c in rest])


@dataclass
class Synced:
    """What a run did: one row of totals, outcomes (seq, source, day, id, outcome) and counts by day."""

    report: Row
    outcomes: DataFrame
    days: DataFrame
    errors: list[str] = field(default_factory=list)


def sync(store: RecordStore, batch: int, first: str, last: str, now: str, sources: Sequence[str] | None = None, configs: dict[str, dict[str, str]] | None = None, recheck_days: int = 0, make: Callable[[DataFrame], DataFrame] = decode) -> Synced:
    """Fetches what is due from ``first`` to ``last``, stores it as ``batch`` and notes the days.

    Sources come in the order given (all registered ones otherwise), days ascend, and so do records: the order in which
    they reach the store.  An unknown source, or one without a transport, is an error of its own; the others go on.
    ``now`` is a parameter, so that a rerun notes the same; its date is today, which is always due.
    """
    spark = store.spark
    wanted = list(dict.fromkeys(registry.source_names() if sources is None else sources))
    known = {n: t for n in wanted if n in registry.source_names() and (t := registry.get_source(n)[1]) is not None}
    errors = [f"No fetcher found for source: {n}" for n in wanted if n not in known]
    options = {n: registry.source_options(n, (configs or {}).get(n, {})) for n in known}
    place = {n: i for i, n in enumerate(known)}
    names = spark.createDataFrame([(n,) for n in known], "source string")
    due = ledger.days_needing_fetch(names, stored_days(store, batch), first, last, now[:10], recheck_days).collect()  # a row per source and day
    rows = fetch(spark, sorted(((r["source"], r["day"].isoformat()) for r in due), key=lambda x: (place[x[0]], x[1])), known, options)

    made = cut(make(rows.where("status is null")))
    good = made.where("ok")
    stored = store.add(batch, good.drop("day", "fulltext", "ok")).select("seq", "id", "outcome")
    kept = made.select("seq", "source", "day").join(stored, "seq", "left").withColumn("outcome", F.coalesce("outcome", F.lit("failed")))
    kept = cut(kept)
    links = good.select("seq", F.posexplode("fulltext").alias("at", "f")).join(kept.where("outcome <> 'failed'").select("seq", F.col("id").alias("publication_id")), "seq")
    store.add_sources(batch, links.select("publication_id", F.col("f.url").alias("url"), F.struct("seq", "at").alias("seq"), F.coalesce("f.source", F.lit("unknown")).alias("source"), F.coalesce("f.format", F.lit("html")).alias("format"), F.col("f.version").alias("version")))

    ends = rows.where("status is not null").select("source", "day", "status", "error")
    counts = ends.join(ledger.day_counters(kept), ["source", "day"], "left").na.fill(0, ["added", "merged", "failed", "record_count"])
    counts = cut(counts)
    stamp = F.to_timestamp(F.lit(now))
    noted = counts.select("source", F.to_date("day").alias("day"), "status", "record_count", stamp.alias("downloaded_at"), stamp.alias("last_verified"))
    noted.coalesce(1).write.mode("overwrite").parquet(f"{store.path}/days/batch={batch}")
    said = counts.where("error is not null").select(F.concat_ws("/", "source", F.concat_ws(": ", "day", "error")).alias("error"))
    errors += [r["error"] for r in said.orderBy("error").collect()]  # a row per failed day
    total = ledger.report(counts).first().asDict() | {"sources_synced": sorted(known), "errors": errors}
    return Synced(Row(**total), kept, counts, errors)
