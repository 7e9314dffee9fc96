"""Foreign keys of tables that are files: found, counted and set apart in the pass that writes."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F


def foreign_keys(rows: DataFrame, parents: DataFrame, key: str, parent_key: str) -> DataFrame:
    """``rows`` with ``orphan``: true where ``key`` is not null and no parent has it; a null key refers to nothing, as in SQL."""
    known = parents.select(F.col(parent_key).alias("_parent")).where("_parent is not null").distinct().withColumn("_known", F.lit(True))
    found = rows.join(known, F.col(key) == F.col("_parent"), "left")
    return found.withColumn("orphan", F.col(key).isNotNull() & F.col("_known").isNull()).drop("_parent", "_known")


@dataclass(frozen=True)
class Checked:
    rows: int
    orphans: int
    kept: DataFrame
    quarantine: DataFrame


def write_checked(rows: DataFrame, parents: DataFrame, key: str, parent_key: str, path: str) -> Checked:
    """Writes ``rows`` to ``path``, orphans into a partition of their own; both are counted as they are written.

    ``rows`` is scanned once.  The parents' keys are distinct, so that a frequent key multiplies nothing; what is written
    can be read again after the parents have come, and judged anew.
    """
    seen = Observation()
    counts = F.count(F.lit(1)).alias("rows"), F.count_if(F.col("orphan")).alias("orphans")
    foreign_keys(rows, parents, key, parent_key).observe(seen, *counts).write.mode("overwrite").partitionBy("orphan").parquet(path)
    back = rows.sparkSession.read.schema(rows.schema.add("orphan", "boolean")).parquet(path)
    return Checked(seen.get["rows"], seen.get["orphans"], back.where("not orphan").drop("orphan"), back.where("orphan").drop("orphan"))
