"""A store of publications with two unique identifiers, to which batches are added.

Two tables, both only ever added to, a partition for each batch:

- ``log``: the rows that were stored, with the id of their publication, bucketed by that id.  The publications are a fold
  of it (first values stay, later ones fill), which needs no shuffle.
- ``identifiers``: key ("doi:..." or "pmid:...") -> id, bucketed by key.  A batch is joined to it bucket by bucket, so that only the
  batch moves; a lookup opens one bucket, and Parquet's bloom filters tell which row groups of it to read.

A batch is numbered by its caller.  It sees the batches before it and overwrites its own partition, so that one that was
lost half way runs again with the same result; and two batches give what one of both would.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from marginalia.operators import merge
from marginalia.operators.shared import Rounds, cut, exists, spread

FIELDS = "seq long, source string, title string, doi string, pmid string, abstract string, journal string, publication_date string, license string, authors array<string>, publication_types array<string>, keywords array<string>, is_open_access boolean"
_COLUMNS = [f.strip().split(" ")[0] for f in FIELDS.split(", ")]
TABLES = {"log": (f"id long, {FIELDS}", "id"), "identifiers": ("key string, id long, full boolean", "key"), "sources": ("publication_id long, url string, source string, format string, version string", "publication_id")}


class RecordStore:
    """The store at ``path``, known to the session's catalog as ``name``_log and so on.

    ``buckets`` is part of the layout: it is written with the store when that is made, and another number is refused.
    """

    def __init__(self, spark: SparkSession, name: str, path: str, buckets: int = 256):
        self.spark, self.name, self.path, self.buckets = spark, name, path.rstrip("/"), buckets
        layout = f"{self.path}/layout"
        if exists(spark, layout):
            made = spark.read.schema("buckets int").json(layout).first()["buckets"]
        else:
            made = buckets
            spark.range(1).select(F.lit(buckets).cast("int").alias("buckets")).coalesce(1).write.json(layout)
        if made != buckets:
            raise ValueError(f"the store at {path} has {made} buckets, not {buckets}")
        for table, (columns, key) in TABLES.items():
            spark.sql(f"CREATE TABLE IF NOT EXISTS {self.table(table)} ({columns}, batch long) USING parquet OPTIONS ('parquet.bloom.filter.enabled#{key}' 'true') PARTITIONED BY (batch) CLUSTERED BY ({key}) SORTED BY ({key}) INTO {buckets} BUCKETS LOCATION '{self.path}/{table}'")
            if exists(spark, f"{self.path}/{table}"):
                spark.sql(f"MSCK REPAIR TABLE {self.table(table)}")

    def table(self, which: str) -> str:
        return f"{self.name}_{which}"

    def _write(self, which: str, rows: DataFrame, batch: int) -> None:
        """Replaces a batch's partition, a file for each bucket."""
        key, spark = TABLES[which][1], rows.sparkSession  # a stream's batches have a session of their own
        columns = [c.split(" ")[0] for c in TABLES[which][0].split(", ")]
        rows.select(*columns).repartition(self.buckets, key).createOrReplaceTempView("_incoming")
        spark.sql(f"INSERT OVERWRITE TABLE {self.table(which)} PARTITION (batch = {int(batch)}) SELECT * FROM _incoming")
        spark.catalog.dropTempView("_incoming")
        self.spark.catalog.refreshTable(self.table(which))

    def identifiers(self, before: int | None = None) -> DataFrame:
        """(key, id, full), the last word on each identifier; of the batches before one, or of all."""
        rows = self.spark.table(self.table("identifiers"))
        rows = rows if before is None else rows.where(F.col("batch") < before)
        return rows.groupBy("key").agg(F.max("id").alias("id"), F.max("full").alias("full"))

    def claims(self, batch: int, records: DataFrame) -> DataFrame:
        """The store's identifiers that a batch holds: each bucket meets its part of the batch, and does not move."""
        wanted = None
        for kind in ("doi", "pmid"):
            some = records.where(f"nullif({kind}, '') is not null").select(key_of(kind, F.col(kind)).alias("key"))
            wanted = some if wanted is None else wanted.unionByName(some)
        kind = F.substring_index("key", ":", 1)
        found = self.identifiers(batch).join(spread(wanted.distinct()), "key", "left_semi")
        return found.select(kind.alias("kind"), F.expr("substr(key, instr(key, ':') + 1)").alias("value"), "id", "full")

    def add(self, batch: int, records: DataFrame, rounds: Rounds | None = None) -> DataFrame:
        """Stores the rows of ``records`` (``FIELDS``; ``seq`` distinct) in order of ``seq``: (seq, source, id, outcome).

        ``outcome`` is *added*, *merged*, or *failed* for a row that would give a publication an identifier of another;
        its id is the one it would have joined, and nothing of it is stored.
        """
        blank = {c: F.nullif(F.col(c), F.lit("")) for c in ("doi", "pmid")}
        records = cut(records.select(*_COLUMNS).withColumns(blank))
        outcomes, changes = merge.resolve(records, self.claims(batch, records), rounds)
        last = self.spark.table(self.table("log")).where(F.col("batch") < batch).agg(F.max("id")).first()[0] or 0
        ids = cut(numbered(outcomes.where("outcome = 'added'").select("seq"), last).withColumnRenamed("seq", "publication"))
        named = lambda rows: rows.join(spread(ids.withColumnRenamed("id", "new_id")), "publication", "left").withColumn("id", F.coalesce("id", "new_id"))
        done = cut(named(outcomes).select("seq", "id", "outcome"))
        self._write("log", records.join(spread(done.where("outcome <> 'failed'")), "seq"), batch)
        self._write("identifiers", named(changes).withColumn("key", key_of(F.col("kind"), F.col("value"))), batch)  # last: who looks up an identifier finds its rows
        return records.select("seq", "source").join(spread(done), "seq")

    def add_sources(self, batch: int, rows: DataFrame) -> None:
        """Full-text addresses (publication_id, url, seq, source, format, version); the first row of an address counts.

        ``seq`` may be of any type that has an order; it orders the rows of one batch only.
        """
        first = rows.groupBy("publication_id", "url").agg(F.min_by(F.struct("source", "format", "version"), "seq").alias("r"))
        self._write("sources", first.select("publication_id", "url", "r.*"), batch)

    def sources(self) -> DataFrame:
        """One row for each (publication, address): the first that came, batch by batch."""
        rest = ["source", "format", "version"]
        rows = self.spark.table(self.table("sources")).groupBy("publication_id", "url").agg(F.min_by(F.struct(*rest), "batch").alias("r"))
        return rows.select("publication_id", "url", *[F.col("r")[c].alias(c) for c in rest])

    def publications(self) -> DataFrame:
        """The publications: title of the first row, first values of the other fields, sources in order of arrival."""
        rows = self.spark.table(self.table("log")).withColumn("at", F.struct("batch", "seq"))
        return merge.fold_by_key(rows, ["id"], seq="at", filled=merge.FILLED, lists=merge.LISTS, flags=["is_open_access"], firsts=["title"])

    def find(self, kind: str, value: str) -> DataFrame:
        """The publication with an identifier, or no row: one bucket of either table is opened."""
        found = self.identifiers().where(F.col("key") == f"{kind}:{value}").first()
        return self.publications().where(F.col("id") == (found["id"] if found else -1))


def key_of(kind: str | Column, value: Column) -> Column:
    return F.concat(F.lit(kind) if isinstance(kind, str) else kind, F.lit(":"), value)


def numbered(rows: DataFrame, start: int) -> DataFrame:
    """``rows`` with ``id``: start + 1, start + 2 and so on in the order of ``seq``, by range partitions and their counts."""
    ranged = cut(rows.repartitionByRange("seq").sortWithinPartitions("seq").withColumn("_at", F.monotonically_increasing_id()))
    ranged = ranged.withColumns({"_part": F.shiftright("_at", 33), "_at": F.col("_at").bitwiseAND((1 << 33) - 1)})
    counts = ranged.groupBy("_part").agg(F.count("*").alias("n"))  # a row per partition
    before = counts.select("_part", (F.sum("n").over(Window.orderBy("_part")) - F.col("n") + start + 1).alias("_before"))
    return ranged.join(F.broadcast(before), "_part").withColumn("id", F.col("_before") + F.col("_at")).drop("_part", "_at", "_before")
