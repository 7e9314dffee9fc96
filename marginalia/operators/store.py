"""The publications table: inserting rows, reading dumped rows, and records as JSON text."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from marginalia.operators.shared import cut

TEXTS = ("title", "doi", "pmid", "abstract", "journal", "publication_date", "license", "first_seen_source")
LISTS = ("authors", "publication_types", "keywords", "sources")
#: A record as JSON: dates are ISO texts.
RECORD = "id long, title string, doi string, pmid string, abstract string, authors array<string>, journal string, publication_date string, publication_types array<string>, keywords array<string>, is_open_access boolean, license string, sources array<string>, first_seen_source string, created_at string, updated_at string"


def insert_rows(stored: DataFrame, incoming: DataFrame, now: str, seq: str = "seq") -> DataFrame:
    """The rows to append for ``incoming``: ids above all stored ones in order of ``seq``, both timestamps ``now``.

    Ids are dense: ranges of ``seq`` are numbered side by side and shifted by the rows before them, of which a count
    for each range reaches every task.  ``now`` is a parameter, so that the job gives the same rows when it runs again.
    """
    last = stored.agg(F.coalesce(F.max("id"), F.lit(0)).cast("long").alias("_last"))
    # cut, since ranges are drawn from a sample and must not be drawn twice
    ranged = cut(incoming.repartitionByRange(seq).withColumn("_part", F.spark_partition_id()))
    before = ranged.groupBy("_part").agg(F.count(F.lit(1)).alias("_n")).withColumn("_before", F.coalesce(F.sum("_n").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    placed = ranged.withColumn("_at", F.row_number().over(Window.partitionBy("_part").orderBy(seq)))
    numbered = placed.join(F.broadcast(before.select("_part", "_before")), "_part").join(F.broadcast(last))
    stamp = F.to_timestamp(F.lit(now))
    return numbered.withColumn("id", F.col("_last") + F.col("_before") + F.col("_at")).drop("_part", "_before", "_at", "_last", seq).withColumn("created_at", stamp).withColumn("updated_at", stamp)


def decode_rows(raw: DataFrame) -> DataFrame:
    """Rows of a dumped table, typed: lists from JSON text (none for null or blank), 0 and 1 to false and true, ISO texts to timestamps."""
    lists = {c: F.coalesce(F.from_json(F.nullif(c, F.lit("")), "array<string>"), F.array().cast("array<string>")) for c in LISTS}
    return raw.withColumns(lists | {"is_open_access": F.coalesce(F.col("is_open_access").cast("boolean"), F.lit(False))} | {c: F.to_timestamp(c) for c in ("created_at", "updated_at")})


def encode_rows(rows: DataFrame) -> DataFrame:
    """The opposite of ``decode_rows``."""
    iso = {c: F.date_format(c, "yyyy-MM-dd'T'HH:mm:ss.SSSSSS") for c in ("created_at", "updated_at")}
    return rows.withColumns({c: F.to_json(c) for c in LISTS} | {"is_open_access": F.col("is_open_access").cast("int")} | iso)


def record_json(fields: dict[str, Column]) -> Column:
    """A record as one line of JSON, nulls included."""
    return F.to_json(F.struct(*[c.alias(n) for n, c in fields.items()]), {"ignoreNullFields": "false"})


def record_from_json(text: Column) -> Column:
    """A record (struct of ``RECORD``) from its JSON; missing lists are empty, a missing flag is false."""
    r = F.from_json(text, RECORD)
    fixed = {c: F.coalesce(r[c], F.array().cast("array<string>")) for c in LISTS} | {"is_open_access": F.coalesce(r["is_open_access"], F.lit(False))}
    names = [x.strip().split(" ")[0] for x in RECORD.split(", ")]
    return F.when(r.isNotNull(), F.struct(*[fixed.get(n, r[n]).alias(n) for n in names]))
