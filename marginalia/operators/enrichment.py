"""Enrichment of papers by lookups: an as-of join to the newest one that is not too old, and calls for what is missing."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from marginalia.operators.shared import cut, exists

LOOKUPS = "key string, at timestamp, answer string"


def as_of(rows: DataFrame, lookups: DataFrame, key: str, days: int, at: str = "at") -> DataFrame:
    """``rows`` with ``lookup`` (at, answer): the newest lookup of the key at or before ``at`` and at most ``days`` older.

    A lookup without an answer is a lookup, too: it says that nothing is known.  Of lookups at one time the one with the
    largest answer counts.  Time is cut into bins of ``days``; a bin holds its own rows and lookups and the last lookup
    of the bin before, which is all that its rows may need, so that a frequent key is many groups.  A row without a key
    or a time finds nothing.
    """
    width = days * 86_400_000_000
    micros = lambda c: F.unix_micros(F.col(c).cast("timestamp"))
    place = lambda c: F.floor(micros(c) / F.lit(width)).cast("long")
    found = lookups.where(F.col(key).isNotNull() & F.col(at).isNotNull()).select(F.col(key).alias("_key"), F.struct(F.col(at).alias("at"), F.col("answer")).alias("_lookup"))
    found = found.withColumn("_bin", place("_lookup.at"))
    carried = found.groupBy("_key", (F.col("_bin") + 1).alias("_bin")).agg(F.max("_lookup").alias("_lookup"))
    whole = F.struct(*rows.columns)
    left = rows.select(F.col(key).alias("_key"), place(at).alias("_bin"), F.col(at).alias("_at"), F.lit(1).alias("_side"), whole.alias("_row"))
    right = found.unionByName(carried).select("_key", "_bin", F.col("_lookup.at").alias("_at"), F.lit(0).alias("_side"), "_lookup")
    line = Window.partitionBy("_key", "_bin").orderBy("_at", "_side", "_lookup")
    both = left.unionByName(right, allowMissingColumns=True).withColumn("_last", F.last("_lookup", ignorenulls=True).over(line))
    fresh = (micros("_at") - micros("_last.at") <= width) & F.col("_key").isNotNull()
    return both.where("_side = 1").select("_row.*", F.when(fresh, F.col("_last")).alias("lookup"))


def stored_lookups(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(LOOKUPS).parquet(path) if exists(spark, path) else spark.createDataFrame([], LOOKUPS)


def look_up(keys: DataFrame, get: Callable[[str], str | None], now: str) -> DataFrame:
    """Lookups (``LOOKUPS``) of distinct keys; a key for which the transport raises has no row, and is asked for again."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            rows = []
            for k in f["key"]:
                try:
                    rows.append((k, get(k)))
                except Exception:  # not an answer: the next run asks again
                    pass
            yield pd.DataFrame(rows, columns=["key", "answer"])

    return keys.select("key").mapInPandas(run, "key string, answer string").select("key", F.to_timestamp(F.lit(now)).alias("at"), "answer")


def enrich(papers: DataFrame, key: str, path: str, get: Callable[[str], str | None], now: str, days: int) -> DataFrame:
    """``papers`` with ``lookup`` as of ``now``; only keys without a lookup of the last ``days`` reach the transport, each once."""
    spark = papers.sparkSession
    stamp = F.to_timestamp(F.lit(now))
    keys = papers.where(F.col(key).isNotNull()).select(F.col(key).alias("key")).distinct().withColumn("at", stamp)
    missing = as_of(keys, stored_lookups(spark, path), "key", days).where("lookup is null")
    cut(look_up(missing, get, now)).write.mode("append").parquet(path)
    known = as_of(keys, stored_lookups(spark, path), "key", days).select(F.col("key").alias("_key"), "lookup")
    return papers.join(known, F.col(key) == F.col("_key"), "left").drop("_key")
