"""Host databases through Spark's JDBC source: reads split by bounds taken from the source, and writes that may run again."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession


def quoted(name: str) -> str:
    return '"' + name.replace('"', '""') + '"'


def read_table(spark: SparkSession, url: str, table: str, key: str, partitions: int = 32, **options: str) -> DataFrame:
    """A table read in ``partitions`` ranges of a numeric, date or timestamp column, from its least to its largest value.

    Filters and column selection reach the database.  Rows with a null key are in the first range; a table without a key
    value is read by one task.  ``options`` are those of Spark's JDBC source (driver, user, fetchsize ...).
    """
    source = lambda: spark.read.format("jdbc").options(url=url, **options)
    ends = source().option("query", f"SELECT MIN({quoted(key)}) AS low, MAX({quoted(key)}) AS high FROM {table}").load().first()
    low, high = ends[0], ends[1]
    whole = source().option("dbtable", table)
    if low is None or low == high:
        return whole.load()
    stop = high + 1 if isinstance(high, int) else high  # the last range has its end open
    return whole.options(partitionColumn=key, lowerBound=str(low), upperBound=str(stop), numPartitions=partitions).load()


def execute(spark: SparkSession, url: str, statements: Sequence[str]) -> list[int]:
    """Statements in one transaction; rows changed by each."""
    connection = spark._jvm.java.sql.DriverManager.getConnection(url)
    try:
        connection.setAutoCommit(False)
        statement = connection.createStatement()
        changed = [statement.executeUpdate(s) for s in statements]
        connection.commit()
        return changed
    except Exception:
        connection.rollback()
        raise
    finally:
        connection.close()


def table_exists(spark: SparkSession, url: str, table: str) -> bool:
    """Whether the database has a table of that (unquoted, so upper-case) name."""
    connection = spark._jvm.java.sql.DriverManager.getConnection(url)
    try:
        return connection.getMetaData().getTables(None, None, table.upper(), None).next()
    finally:
        connection.close()


def upsert(rows: DataFrame, url: str, table: str, key: Sequence[str], batch: str, **options: str) -> int:
    """Writes ``rows`` (distinct keys) into ``table``: rows with a known key are updated, others are added; returns how many.

    Tasks write side by side into a staging table of the batch, made anew by each run; a task that runs twice leaves its
    rows there twice, which the next step joins to one.  Then a single MERGE at the database, in one transaction with the
    staging tables' end, makes all rows seen at once.  A run that is lost at any point may run again.
    """
    spark = rows.sparkSession
    names, stage, once = [quoted(c) for c in rows.columns], f"stage_{batch}", f"once_{batch}"
    old = [t for t in (stage, once) if table_exists(spark, url, t)]
    listed = ", ".join(names)
    execute(spark, url, [f"DROP TABLE {t}" for t in old] + [f"CREATE TABLE {t} AS SELECT {listed} FROM {table} WITH NO DATA" for t in (stage, once)])
    rows.write.format("jdbc").options(url=url, dbtable=stage, **options).mode("append").save()
    same = " AND ".join(f"t.{quoted(c)} = s.{quoted(c)}" for c in key)
    rest = [quoted(c) for c in rows.columns if c not in key]
    update = f"WHEN MATCHED THEN UPDATE SET {', '.join(f'{c} = s.{c}' for c in rest)} " if rest else ""
    insert = f"WHEN NOT MATCHED THEN INSERT ({listed}) VALUES ({', '.join('s.' + c for c in names)})"
    changed = execute(spark, url, [f"INSERT INTO {once} SELECT DISTINCT {listed} FROM {stage}", f"MERGE INTO {table} t USING {once} s ON {same} {update}{insert}", f"DROP TABLE {stage}", f"DROP TABLE {once}"])
    return changed[1]
