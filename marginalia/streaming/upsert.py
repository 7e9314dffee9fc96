"""Records that arrive in a stream, merged into a Parquet table batch by batch.

Late rows merge like all others: nothing is dropped by a watermark.  Each batch, folded by key, is a partition of its
own (the stream's label and the batch's number), and the table is a fold of all of them.  A batch that is delivered
again, or that was lost between its parts, writes the same partition again; nothing that another batch wrote is touched.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from marginalia.operators.shared import exists


def fold_batch(path: str, key: Sequence[str], seq: str = "seq", label: str = "stream") -> Callable[[DataFrame, int], None]:
    """A ``foreachBatch`` function that writes a batch as ``label``'s partition of that number.

    The first row of a key stays, later rows fill its nulls: of each column the first value is written, with its ``seq``.
    """

    def run(batch: DataFrame, n: int) -> None:
        firsts(batch, key, seq).write.mode("overwrite").parquet(f"{path}/label={label}/batch={n}")

    return run


def firsts(rows: DataFrame, key: Sequence[str], seq: str = "seq") -> DataFrame:
    """For each key its smallest ``seq``, and of each other column the first value with its ``seq``."""
    columns = [c for c in rows.columns if c not in (*key, seq)]
    return rows.groupBy(*key).agg(F.min(seq).alias(seq), *[F.min(F.when(F.col(c).isNotNull(), F.struct(F.col(seq).alias("at"), F.col(c).alias("value")))).alias(c) for c in columns])


def read_table(spark: SparkSession, path: str, schema: str, key: Sequence[str], seq: str = "seq") -> DataFrame:
    """The table as it is, with the columns of ``schema``; empty where nothing has been written yet."""
    plain = spark.createDataFrame([], schema)
    if not exists(spark, path):
        return plain
    columns = [c for c in plain.columns if c not in (*key, seq)]
    rows = spark.read.schema(firsts(plain, key, seq).schema).parquet(path)
    table = rows.groupBy(*key).agg(F.min(seq).alias(seq), *[F.min(c).getField("value").alias(c) for c in columns])
    return table.select(*plain.columns)


def start_upsert(stream: DataFrame, path: str, key: Sequence[str], checkpoint: str, seq: str = "seq") -> StreamingQuery:
    """Works off what is there, then ends; run it again for what came since.  Batches are labelled by their checkpoint."""
    label = hashlib.sha256(checkpoint.encode()).hexdigest()[:12]
    return stream.writeStream.foreachBatch(fold_batch(path, key, seq, label)).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def progress(query: StreamingQuery) -> list[tuple[int, int]]:
    """(batch, rows read) of the batches that a query has worked off lately; ``publications.ProgressTable`` keeps them all."""
    return [(p["batchId"], p["numInputRows"]) for p in query.recentProgress]
