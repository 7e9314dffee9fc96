"""The full-text cache on disk: bodies by identifier, in a partition for the hash of the identifier.

Writes and deletions only add rows, so that a run that is lost, or runs again, harms nothing that is there; of each
(identifier, kind) the row with the largest ``seq`` counts, a deletion being one without a body.  A read of some
identifiers opens the partitions of their hashes and no others, and works on any file system that Spark writes.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from marginalia.functions.text import sanitize_identifier
from marginalia.operators.fulltext import cache_rows
from marginalia.operators.shared import exists, remove

#: Partitions of a cache; written into the path, so that a cache of another number is another cache.
BUCKETS = 256
ROWS = "identifier string, kind string, html string, pdf binary, seq long, bucket int"


def bucket_of(identifier: Column) -> Column:
    return F.pmod(F.xxhash64(identifier), F.lit(BUCKETS)).cast("int")


def _append(rows: DataFrame, path: str) -> None:
    rows = rows.withColumn("bucket", bucket_of(F.col("identifier"))).select(*[c.split(" ")[0] for c in ROWS.split(", ")])
    rows.repartition("bucket").write.mode("append").partitionBy("bucket").parquet(f"{path}/of-{BUCKETS}")


def save(papers: DataFrame, path: str) -> None:
    """Adds ``html`` and ``pdf`` of (identifier, html, pdf, seq); what is no PDF is left out, and so is a null identifier."""
    named = papers.where("identifier is not null").withColumn("identifier", sanitize_identifier(F.col("identifier")))
    _append(cache_rows(named), path)


def delete(spark: SparkSession, path: str, identifiers: Sequence[str], seq: int) -> None:
    """Hides HTML and PDF of some identifiers from readers; what is not there is no error."""
    none = F.lit(None)
    gone = spark.createDataFrame([(i,) for i in identifiers], "identifier string").withColumn("identifier", sanitize_identifier(F.col("identifier")))
    kinds = F.explode(F.array(F.lit("html"), F.lit("pdf"))).alias("kind")
    _append(gone.select("identifier", kinds, none.cast("string").alias("html"), none.cast("binary").alias("pdf"), F.lit(seq).cast("long").alias("seq")), path)


def clear(spark: SparkSession, path: str) -> None:
    remove(spark, f"{path}/of-{BUCKETS}")


def load(spark: SparkSession, path: str, identifiers: Sequence[str] | None = None) -> DataFrame:
    """(identifier, kind, html, pdf, seq) of some identifiers, or of all; identifiers come in their sanitised form."""
    where = f"{path}/of-{BUCKETS}"
    if not exists(spark, where):
        return spark.createDataFrame([], ROWS).drop("bucket")
    rows = spark.read.schema(ROWS).parquet(where)
    if identifiers is not None:
        wanted = spark.createDataFrame([(i,) for i in identifiers], "identifier string").select(sanitize_identifier(F.col("identifier")).alias("identifier"))
        listed = wanted.select("identifier", bucket_of(F.col("identifier")).alias("b")).collect()
        rows = rows.where(F.col("bucket").isin(sorted({r["b"] for r in listed})) & F.col("identifier").isin(sorted({r["identifier"] for r in listed})))
    last = rows.groupBy("identifier", "kind").agg(F.max_by(F.struct("html", "pdf", "seq"), "seq").alias("r"))
    return last.where("r.html is not null or r.pdf is not null").select("identifier", "kind", "r.*")


def with_cached(papers: DataFrame, path: str) -> DataFrame:
    """``papers`` with ``cached_html`` and ``cached_pdf`` of their identifiers, as ``fulltext_cascade`` takes them."""
    cache = load(papers.sparkSession, path)
    bodies = cache.groupBy("identifier").agg(F.max("html").alias("cached_html"), F.max("pdf").alias("cached_pdf"))
    return papers.join(bodies.withColumnRenamed("identifier", "_name"), sanitize_identifier(F.col("identifier")) == F.col("_name"), "left").drop("_name")
