"""The sync ledger: which (source, day) pairs to fetch, and what happened."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def upsert(stored: DataFrame, incoming: DataFrame, seq: str = "seq") -> DataFrame:
    """Last writer wins on (source, day); stored rows come before all incoming ones."""
    columns = [c for c in stored.columns if c not in ("source", "day")]
    both = stored.withColumn("_o", F.struct(F.lit(0).alias("b"), F.lit(0).cast("long").alias("s"))).unionByName(incoming.withColumn("_o", F.struct(F.lit(1).alias("b"), F.col(seq).cast("long").alias("s"))).select("source", "day", *columns, "_o"))
    last = both.groupBy("source", "day").agg(F.max_by(F.struct(*columns), "_o").alias("_r"))
    return last.select("source", "day", *[F.col("_r")[c].alias(c) for c in columns])


def days_needing_fetch(sources: DataFrame, ledger: DataFrame, first: str, last: str, today: str, recheck_days: int = 0) -> DataFrame:
    """(source, day) to fetch: today, days not in the ledger, failed days, and days verified too long ago or never.

    ``today`` is a parameter, so the plan is the same whenever it runs.
    """
    days = sources.select("source", F.explode(F.sequence(F.to_date(F.lit(first)), F.to_date(F.lit(last)))).alias("day"))
    known = ledger.select("source", "day", "status", "last_verified", F.lit(True).alias("_known"))
    both = days.join(known, ["source", "day"], "left")
    due = (F.col("day") == F.to_date(F.lit(today))) | F.col("_known").isNull() | (F.col("status") == "failed")
    if recheck_days > 0:
        due = due | F.col("last_verified").isNull() | (F.to_date("last_verified") < F.date_sub(F.to_date(F.lit(today)), recheck_days))
    return both.where(due).select("source", "day")


def day_counters(outcomes: DataFrame) -> DataFrame:
    """Per source and day: rows added, merged and failed; ``record_count`` is what was stored."""
    n = lambda kind: F.count_if(F.col("outcome") == kind).alias(kind)
    return outcomes.groupBy("source", "day").agg(n("added"), n("merged"), n("failed")).withColumn("record_count", F.col("added") + F.col("merged"))


def report(counters: DataFrame, errors: DataFrame | None = None) -> DataFrame:
    """One row: sources synced, days, totals, errors."""
    total = counters.agg(F.array_sort(F.collect_set("source")).alias("sources_synced"), F.count(F.lit(1)).alias("days_processed"), F.coalesce(F.sum("added"), F.lit(0)).alias("records_added"), F.coalesce(F.sum("merged"), F.lit(0)).alias("records_merged"), F.coalesce(F.sum("failed"), F.lit(0)).alias("records_failed"))
    said = F.array().cast("array<string>") if errors is None else errors.agg(F.array_sort(F.collect_list("error"))).scalar()
    return total.withColumn("errors", said)
