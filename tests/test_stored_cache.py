import re
import tempfile

from pyspark.sql import functions as F

from marginalia.operators import records, stored_cache

PAPER = "identifier string, html string, pdf binary, seq long"


def test_bodies_round_trip(spark):
    path = tempfile.mkdtemp(prefix="spark-")
    assert stored_cache.load(spark, path).count() == 0
    rows = [("10.1/a b", "<p>é</p>", b"%PDF-1", 1), ("x", None, b"<html>", 1), ("y", "<p>y</p>", None, 1), (None, "<p>", b"%PDF", 1), ("z", None, None, 1)]
    stored_cache.save(spark.createDataFrame(rows, PAPER), path)
    show = lambda *ids: sorted((r["identifier"], r["kind"], r["html"] or bytes(r["pdf"])) for r in stored_cache.load(spark, path, *ids).collect())
    assert show() == [("10.1_a_b", "html", "<p>é</p>"), ("10.1_a_b", "pdf", b"%PDF-1"), ("y", "html", "<p>y</p>")]
    assert show(["10.1/a b", "nobody"]) == show()[:2] and show([]) == []
    stored_cache.save(spark.createDataFrame([("y", "<p>new</p>", b"%PDF-y", 2)], PAPER), path)
    stored_cache.save(spark.createDataFrame([("y", "<p>new</p>", b"%PDF-y", 2)], PAPER), path)  # a rerun
    assert show(["y"]) == [("y", "html", "<p>new</p>"), ("y", "pdf", b"%PDF-y")]
    stored_cache.delete(spark, path, ["y", "nobody"], 3)
    assert show(["y"]) == [] and len(show()) == 2
    stored_cache.save(spark.createDataFrame([("y", "<p>again</p>", None, 4)], PAPER), path)
    assert show(["y"]) == [("y", "html", "<p>again</p>")]
    joined = stored_cache.with_cached(spark.createDataFrame([("10.1/a b",), ("w",)], "identifier string"), path)
    assert {r["identifier"]: r["cached_html"] for r in joined.collect()} == {"10.1/a b": "<p>é</p>", "w": None}
    stored_cache.clear(spark, path)
    assert show() == []


def test_one_identifier_opens_one_partition(spark):
    path = tempfile.mkdtemp(prefix="spark-")
    stored_cache.save(spark.range(300).select(F.concat(F.lit("i"), "id").alias("identifier"), F.lit("<p>").alias("html"), F.lit(None).cast("binary").alias("pdf"), F.lit(1).cast("long").alias("seq")), path)
    found = stored_cache.load(spark, path, ["i7"])
    assert found.count() == 1
    plan = found._jdf.queryExecution().executedPlan()
    text = plan.toString()
    assert re.search(r"PartitionFilters: \[isnotnull\(bucket#\d+\), \(bucket#\d+ = \d+\)\]", text) and "PushedFilters: [IsNotNull(identifier), EqualTo(identifier,i7)]" in text
    files = spark.read.schema(stored_cache.ROWS).parquet(f"{path}/of-{stored_cache.BUCKETS}").where("identifier = 'i7'").select("bucket").distinct()
    assert files.count() == 1


def test_citation_files_at_any_split(spark):
    """The same records whether the file is read by one task or cut in many places, inside articles and tags."""
    path = tempfile.mkdtemp(prefix="spark-")
    one = "<PubmedArticle><MedlineCitation><PMID>{}</PMID><Article><ArticleTitle>Title é {} &lt;PubmedArticle&gt;</ArticleTitle></Article></MedlineCitation>\n</PubmedArticle>"
    other = '<PubmedArticle Status="x"><MedlineCitation><PMID>{}</PMID></MedlineCitation></PubmedArticle>'
    body = "\n".join(one.format(i, "w" * (i % 50)) if i % 3 else other.format(i) for i in range(400))
    with open(f"{path}/a.xml", "w", encoding="utf-8") as f:
        f.write(f'<?xml version="1.0"?>\n<!DOCTYPE PubmedArticleSet>\n<PubmedArticleSet>\n{body}\n</PubmedArticleSet>\n')
    with open(f"{path}/b.xml", "w", encoding="utf-8") as f:
        f.write("<PubmedArticleSet></PubmedArticleSet>")
    seen, parts = [], []
    for size in ("100m", "1k"):
        spark.conf.set("spark.sql.files.maxPartitionBytes", size)
        spark.conf.set("spark.sql.files.openCostInBytes", "0")
        try:
            files = records.citation_files(spark, path)
            parts.append(files.rdd.getNumPartitions())
            seen.append(sorted((r["pmid"], r["title"]) for r in records.citations(files).collect()))
        finally:
            spark.conf.unset("spark.sql.files.maxPartitionBytes")
            spark.conf.unset("spark.sql.files.openCostInBytes")
    assert seen[0] == seen[1] and len(seen[0]) == 400 and parts[1] >= 50 > parts[0]
    assert ("1", "Title é w <PubmedArticle>") in seen[0] and all(p for p, _ in seen[0])
