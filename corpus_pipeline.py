"""A training-data pipeline over ``documents``: filter, deduplicate, mix, encode."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from marginalia.llm import bpe_codec, mixing, near_dedup, quality_classifier, quality_rules
from marginalia.llm.common import scratch, staged, with_ids
from marginalia.llm.queries import table, vocabulary

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass the quality rules."""
    trusted = table(spark, sf_dir, "labels").where("quality = 1").select("doc_id")
    return quality_rules.quality_rules(docs, trusted).where("kept").select(*COLUMNS)


def classifier(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier takes for good ones; it learns from those that reached this stage or not."""
    everything = table(spark, sf_dir, "documents")
    labels = table(spark, sf_dir, "labels").where(~quality_classifier.held_out(F.col("doc_id"))).select("doc_id", "quality")
    model = quality_classifier.train(everything, labels)
    return quality_classifier.quality_scores(docs.select(*COLUMNS), model, score="_score", predicted="_predicted").where("_predicted = 1").select(*COLUMNS)


def near_dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates, that with the smallest id."""
    gone = staged(near_dedup.near_duplicates(docs).where("not kept").select("doc_id").distinct(), "gone")
    return with_ids(docs, gone, "doc_id", "left_anti").select(*COLUMNS)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The mix of sources by target weight: a row for each pass over a document; n_chars follows the text."""
    return mixing.mixed_documents(docs.select(*COLUMNS)).withColumn("n_chars", F.length("text").cast("long")).select(*COLUMNS)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of every text (packed little-endian unsigned 32-bit integers) and what they decode to."""
    coded = bpe_codec.bpe_encode_decode(docs, vocabulary("word_bpe_49k.json"))
    return coded.select("doc_id", (F.octet_length("ids") / 4).cast("long").alias("n_tokens"), "ids", "decoded")


STAGES = [("quality_rules", rules), ("quality_classifier", classifier), ("minhash_dedup", near_dedup_stage), ("mixing", mix), ("bpe", encode)]

#: Hash functions, learned scores and tokens of the stages are not SQL; tests/llm checks each stage by brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages on ``documents``; each result is written as Parquet and read again."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        path = scratch(spark, f"pipeline-{name}")
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
