"""Token usage and cost of model calls."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def with_cost(calls: DataFrame, prices: DataFrame, fallback: tuple[float, float]) -> DataFrame:
    """Adds ``cost`` in USD: tokens per million times the model's prices, or the fallback prices."""
    priced = calls.join(F.broadcast(prices), "model", "left")
    return priced.withColumn("cost", F.col("input_tokens") / 1e6 * F.coalesce("input_price", F.lit(fallback[0])) + F.col("output_tokens") / 1e6 * F.coalesce("output_price", F.lit(fallback[1]))).drop("input_price", "output_price")


def by_model(calls: DataFrame) -> DataFrame:
    """Calls, tokens and cost per model, and (model null) in all, in one pass."""
    sums = [F.sum("input_tokens").alias("input_tokens"), F.sum("output_tokens").alias("output_tokens"), F.round(F.sum("cost"), 9).alias("cost"), F.count(F.lit(1)).alias("calls")]
    return calls.groupingSets([["model"], []], "model").agg(*sums)


def recent(calls: DataFrame, n: int, seq: str = "seq") -> DataFrame:
    """The last n calls, the oldest first; none for n = 0."""
    return calls.orderBy(F.desc(seq)).limit(n).orderBy(seq)


def with_cost_at(calls: DataFrame, prices: DataFrame, fallback: DataFrame, default: tuple[float, float], at: str = "at") -> DataFrame:
    """Adds ``cost`` in USD by the prices that were valid at the call, else the model's fallback prices, else the default.

    ``prices``: (model, valid_from, valid_to, input_price, output_price), from inclusive, to exclusive, null for open.
    Where two overlap, the later one holds from its start.  Both sides are cut into months, so that the join is one on
    (model, month) with the bounds as a condition behind it, and a model of many prices meets those of a month.
    ``fallback``: (model, input_price, output_price).
    """
    month = lambda c: (F.year(c) * 12 + F.month(c)).cast("int")
    last = calls.agg(F.max(at)).scalar()
    after = F.lead("valid_from").over(Window.partitionBy("model").orderBy("valid_from", "valid_to", "input_price", "output_price"))
    spans = prices.where("valid_to is null or valid_to > valid_from").withColumn("valid_to", F.least(F.coalesce("valid_to", after), F.coalesce(after, "valid_to"))).where("valid_to is null or valid_to > valid_from")
    spans = spans.withColumn("_last", last).withColumn("_stop", F.coalesce("valid_to", "_last")).where("valid_from <= _last and valid_from <= _stop")
    spans = spans.withColumn("_month", F.explode(F.sequence(month(F.col("valid_from")), month(F.least("_stop", "_last")))))
    spans = spans.select(F.col("model").alias("_model"), "_month", F.col("valid_from").alias("_from"), F.col("valid_to").alias("_to"), F.col("input_price").alias("_in"), F.col("output_price").alias("_out"))
    within = (F.col("_from") <= F.col(at)) & (F.col("_to").isNull() | (F.col(at) < F.col("_to")))
    priced = calls.withColumn("_m", month(F.col(at))).join(spans, (F.col("model") == F.col("_model")) & (F.col("_m") == F.col("_month")) & within, "left")
    backed = priced.join(fallback.select(F.col("model").alias("_named"), F.col("input_price").alias("_in2"), F.col("output_price").alias("_out2")), F.col("model") == F.col("_named"), "left")
    price = lambda x, i: F.coalesce(x, f"{x}2", F.lit(default[i]))
    cost = F.col("input_tokens") / 1e6 * price("_in", 0) + F.col("output_tokens") / 1e6 * price("_out", 1)
    return backed.withColumn("cost", cost).drop("_m", "_model", "_month", "_from", "_to", "_in", "_out", "_named", "_in2", "_out2")
