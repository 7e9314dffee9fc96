"""Tables of a job's own in the folder that the cluster shares: they cut lineage and survive lost executors."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def fresh_path(spark: SparkSession, name: str) -> str:
    """A new path in ``spark.checkpoint.dir``; where the session names none, a local master may do with a temporary folder."""
    root = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not root:
        if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise ValueError("spark.checkpoint.dir must name a folder that the cluster shares")
        root = f"file://{tempfile.mkdtemp(prefix='spark-')}"
        spark.conf.set("spark.checkpoint.dir", root)
    return f"{root.rstrip('/')}/{name}-{uuid.uuid4().hex[:12]}"


def _at(spark: SparkSession, path: str):
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark._jsc.hadoopConfiguration()), where


def exists(spark: SparkSession, path: str) -> bool:
    """Whether there is a file or folder, in whatever file system it is."""
    system, where = _at(spark, path)
    return system.exists(where)


def remove(spark: SparkSession, path: str) -> None:
    """Deletes a path of this job's own."""
    system, where = _at(spark, path)
    system.delete(where, True)


def cut(df: DataFrame) -> DataFrame:
    """``df`` written as Parquet and read again: its lineage ends there."""
    path = fresh_path(df.sparkSession, "round")
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def spread(df: DataFrame) -> DataFrame:
    """``df`` as a side of a join that is made by sorting, not by a broadcast through the driver.

    Spark judges a written table by the size of its files, and a few MB of Parquet may hold millions of rows.
    """
    return df.hint("merge")


class Rounds:
    """Tables of a loop: each ``next`` of a name replaces the last one, whose files go once the new ones are written."""

    def __init__(self, spark: SparkSession):
        self.spark, self.paths, self.written = spark, {}, 0

    def next(self, name: str, df: DataFrame) -> DataFrame:
        path = fresh_path(self.spark, name)
        df.write.parquet(path)
        self.written += 1
        if name in self.paths:
            remove(self.spark, self.paths[name])
        self.paths[name] = path
        return self.spark.read.schema(df.schema).parquet(path)

    def drop(self, *names: str) -> None:
        for name in names:
            if name in self.paths:
                remove(self.spark, self.paths.pop(name))
