import re
import tempfile

import pytest

from pyspark.sql import functions as F

from marginalia.operators.integrity import write_checked
from marginalia.sources import jdbc

DRIVER = "org.apache.derby.jdbc.EmbeddedDriver"


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.fixture
def url(spark):
    url = f"jdbc:derby:{tempfile.mkdtemp(prefix='spark-')}/db;create=true"
    jdbc.execute(spark, url, ['CREATE TABLE papers ("id" BIGINT PRIMARY KEY, "title" VARCHAR(200), "score" DOUBLE)'])
    return url


def papers(spark, low, high, title="T"):
    return spark.range(low, high).select("id", F.concat(F.lit(title), "id").alias("title"), (F.col("id") / 2).alias("score"))


def test_reads_are_split_and_filters_reach_the_database(spark, url):
    assert jdbc.read_table(spark, url, "papers", "id", driver=DRIVER).count() == 0
    assert jdbc.upsert(papers(spark, 100, 300), url, "papers", ["id"], "b1", driver=DRIVER) == 200
    read = jdbc.read_table(spark, url, "papers", "id", partitions=4, driver=DRIVER)
    assert sorted(map(tuple, read.collect())) == sorted(map(tuple, papers(spark, 100, 300).collect()))
    sizes = [r["n"] for r in read.groupBy(F.spark_partition_id()).agg(F.count("*").alias("n")).collect()]
    assert sizes == [50] * 4
    some = read.where("id > 290 and title = 'T295'").select("score")
    assert re.search(r"PushedFilters: \[.*GreaterThan\(id,290\).*EqualTo\(title,T295\).*\], ReadSchema: struct<score:double>", plan(some))
    assert [r["score"] for r in some.collect()] == [147.5]


def test_a_rerun_adds_no_row(spark, url):
    jdbc.upsert(papers(spark, 0, 10), url, "papers", ["id"], "b1", driver=DRIVER)
    for _ in range(2):
        assert jdbc.upsert(papers(spark, 5, 15, "new "), url, "papers", ["id"], "b2", driver=DRIVER) == 10
        got = {r["id"]: r["title"] for r in jdbc.read_table(spark, url, "papers", "id", driver=DRIVER).collect()}
        assert got == {i: f"T{i}" if i < 5 else f"new {i}" for i in range(15)}


def test_a_run_lost_after_staging(spark, url, monkeypatch):
    """Rows staged twice by a lost run and a task that ran twice: the table has them once, and had none before."""
    run = jdbc.execute

    def lost(session, where, statements):
        if any(s.startswith("MERGE") for s in statements):
            raise RuntimeError("lost")
        return run(session, where, statements)

    monkeypatch.setattr(jdbc, "execute", lost)
    with pytest.raises(RuntimeError, match="lost"):
        jdbc.upsert(papers(spark, 0, 8), url, "papers", ["id"], "b1", driver=DRIVER)
    monkeypatch.setattr(jdbc, "execute", run)
    assert jdbc.table_exists(spark, url, "stage_b1") and jdbc.read_table(spark, url, "papers", "id", driver=DRIVER).count() == 0
    assert jdbc.upsert(papers(spark, 0, 8).unionByName(papers(spark, 3, 5)), url, "papers", ["id"], "b1", driver=DRIVER) == 8
    assert not jdbc.table_exists(spark, url, "stage_b1") and jdbc.read_table(spark, url, "papers", "id", driver=DRIVER).count() == 8


def test_statements_are_one_transaction(spark, url):
    with pytest.raises(Exception, match="duplicate"):
        jdbc.execute(spark, url, ["INSERT INTO papers VALUES (1, 'a', 0)", "INSERT INTO papers VALUES (1, 'b', 0)"])
    assert jdbc.read_table(spark, url, "papers", "id", driver=DRIVER).count() == 0


def test_orphans_are_counted_and_kept(spark):
    parents = spark.createDataFrame([(1,), (2,), (2,), (None,)], "id long")
    path = tempfile.mkdtemp(prefix="spark-")
    spark.createDataFrame([(1, "a"), (2, "b"), (9, "c"), (None, "d"), (9, "e"), (2, "f")], "publication_id long, url string").write.mode("overwrite").parquet(f"{path}/in")
    scanned = spark.sparkContext.accumulator(0)

    def count(frames):
        for f in frames:
            scanned.add(len(f))
            yield f

    rows = spark.read.parquet(f"{path}/in").mapInPandas(count, "publication_id long, url string")
    done = write_checked(rows, parents, "publication_id", "id", f"{path}/out")
    assert (done.rows, done.orphans, scanned.value) == (6, 2, 6)  # one scan
    assert sorted(r["url"] for r in done.kept.collect()) == ["a", "b", "d", "f"]
    assert sorted(map(tuple, done.quarantine.collect())) == [(9, "c"), (9, "e")]
    later = write_checked(done.quarantine, parents.unionByName(spark.createDataFrame([(9,)], "id long")), "publication_id", "id", f"{path}/later")
    assert (later.rows, later.orphans) == (2, 0)
    assert write_checked(rows.limit(0), parents, "publication_id", "id", f"{path}/none").orphans == 0
