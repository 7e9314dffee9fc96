"""Pass-through SQL and migrations."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass
from typing import Any

from pyspark.sql import DataFrame, Row, SparkSession


def execute(spark: SparkSession, statement: str, args: Sequence[Any] = ()) -> DataFrame:
    """A statement with positional ``?`` parameters."""
    return spark.sql(statement, args=list(args))


def execute_many(spark: SparkSession, table: str, rows: Sequence[Sequence[Any]]) -> None:
    """Appends rows to a table, as one write."""
    schema = spark.table(table).schema
    spark.createDataFrame([tuple(r) for r in rows], schema).write.mode("append").insertInto(table)


def fetch_all(spark: SparkSession, statement: str, args: Sequence[Any] = ()) -> list[Row]:
    return execute(spark, statement, args).collect()


def fetch_one(spark: SparkSession, statement: str, args: Sequence[Any] = ()) -> Row | None:
    return execute(spark, statement, args).first()


def fetch_scalar(spark: SparkSession, statement: str, args: Sequence[Any] = ()) -> Any:
    row = fetch_one(spark, statement, args)
    return None if row is None else row[0]


def table_exists(spark: SparkSession, name: str) -> bool:
    return spark.catalog.tableExists(name)


def create_tables(spark: SparkSession, ddl: str) -> None:
    """Statements parted by semicolons; empty ones are passed over."""
    for statement in filter(None, map(str.strip, ddl.split(";"))):
        spark.sql(statement)


@dataclass(frozen=True)
class Migration:
    version: int
    name: str
    up: Callable[[SparkSession], None]


def pending(spark: SparkSession, migrations: Sequence[Migration], table: str) -> list[Migration]:
    done = {r["version"] for r in spark.table(table).select("version").collect()} if table_exists(spark, table) else set()
    return sorted((m for m in migrations if m.version not in done), key=lambda m: m.version)


def migrate(spark: SparkSession, migrations: Sequence[Migration], table: str = "schema_version") -> int:
    """Runs what is pending in order of version and records each; returns how many ran."""
    spark.sql(f"CREATE TABLE IF NOT EXISTS {table} (version INT, name STRING, applied_at TIMESTAMP) USING parquet")
    todo = pending(spark, migrations, table)
    for m in todo:
        m.up(spark)
        spark.sql(f"INSERT INTO {table} SELECT ?, ?, current_timestamp()", args=[m.version, m.name])
    return len(todo)
