"""Repeated rows, labels in conflict, and pages as they are found: what one key or one bad tag must not do."""

import time
from fractions import Fraction

import numpy as np
import pytest

from pyspark.sql import functions as F

from marginalia.llm import html_text, mixing, quality_classifier


def labels_of(docs, labels, **options):
    """Labels of the sample that training fits on, by id."""
    return {r["_id"]: r["label"] for r in quality_classifier.sample(docs, labels, **options).collect()}


def test_rows_of_one_labelled_id_are_one_example(spark):
    docs = spark.range(5001).select(F.when(F.col("id") < 5000, 1).otherwise(2).alias("doc_id"), F.concat(F.lit("text "), F.col("id")).alias("text"))
    labels = spark.createDataFrame([(1, 1), (2, 0)], "doc_id long, quality int")
    assert quality_classifier.sample(docs, labels).count() == 2 and labels_of(docs, labels) == {1: 1, 2: 0}


def test_labels_in_conflict_do_not_depend_on_order(spark):
    docs = spark.createDataFrame([(i, f"word {i}") for i in range(4)], "doc_id long, text string")
    for rows in ([(1, 0), (1, 1), (2, 1), (3, None), (None, 1), (0, 7)], [(2, 1), (1, 1), (1, 0), (0, 7)]):
        assert labels_of(docs, spark.createDataFrame(rows, "doc_id long, quality int")) == {1: 0, 2: 1}


def test_training_is_bounded_and_fits_in_a_task(spark):
    docs = spark.range(50).select(F.col("id").alias("doc_id"), F.concat_ws(" ", F.transform(F.sequence(F.lit(0), F.lit(40)), lambda x: F.md5((x + F.col("id") * 100).cast("string")))).alias("text"))
    labels = docs.select("doc_id", (F.col("doc_id") % 2).cast("int").alias("quality"))
    assert len(labels_of(docs, labels)) == 50 and len(labels_of(docs, labels, rows=7)) == 7
    assert 0 < len(labels_of(docs, labels, max_bytes=100_000)) < 20
    rows = sorted(quality_classifier.sample(docs, labels).collect())
    plain = quality_classifier.fit([(np.frombuffer(r["buckets"], np.uint16), np.frombuffer(r["counts"], np.uint32)) for r in rows], np.array([r["label"] for r in rows]))
    model = quality_classifier.train(docs, labels)
    assert all(np.array_equal(a, b) for a, b in ((model.vectors, plain.vectors), (model.weights, plain.weights), (model.bias, plain.bias)))
    assert not quality_classifier.train(docs.limit(0), labels).vectors.any()


def test_shards_of_repeated_rows_stay_alike(spark, monkeypatch):
    monkeypatch.setattr(mixing, "SHARD_DOCS", 512)
    monkeypatch.setattr(mixing, "COPIES", 1000)
    equal = spark.range(20_000).select(F.lit(7).cast("long").alias("doc_id"), F.lit("a b c").alias("text"), F.lit("s").alias("source"))
    other = spark.range(20_000).select((F.col("id") + 100).alias("doc_id"), F.concat(F.lit("w"), F.col("id"), F.lit(" x y")).alias("text"), F.lit("s").alias("source"))
    docs = equal.unionByName(other)
    copies = mixing.repeated(spark.createDataFrame([(1, 5), (2, 2500), (3, 1000)], "key long, n long"))
    assert {(r["key"], r["n"], r["top"]) for r in copies.groupBy("key").agg(F.countDistinct("copy").alias("n"), F.max("copy").alias("top")).collect()} == {(1, 5, 4), (2, 2500, 2499), (3, 1000, 999)}
    assert copies.count() == 3505
    captured = {}
    staged = mixing.staged
    monkeypatch.setattr(mixing, "staged", lambda df, name: captured.setdefault(name, staged(df, name)) if name == "placed" else staged(df, name))
    plan = mixing.taken(mixing.mix_plan(docs))
    assert plan.count() == 40_000
    sizes = sorted(r["count"] for r in captured["placed"].groupBy("shard").count().collect())
    assert sizes[-1] <= 2 * sizes[len(sizes) // 2]
    shards = len(sizes)  # a last block that is not full takes a seat, too
    assert abs(plan.agg(F.sum("taken")).first()[0] - 120_000) <= shards * mixing.BLOCK


def plain_targets(sizes, weights, total, most=3):
    """Round after round: whoever is above the limit gets it, the rest share anew."""
    share, free, left = [Fraction(0)] * len(sizes), {i for i, s in enumerate(sizes) if s > 0}, Fraction(total)
    while free:
        each = left / sum(weights[i] for i in free)
        over = {i for i in free if each * weights[i] > most * sizes[i]}
        for i in over or free:
            share[i] = Fraction(most * sizes[i]) if over else each * weights[i]
        if not over:
            break
        left -= sum(share[i] for i in over)
        free -= over
    return [float(x) for x in share]


def test_targets_of_many_sources():
    import random

    rng = random.Random(1)
    for n in (0, 1, 2, 7, 40, 200):
        sizes = [rng.choice([0, 1, 5, rng.randrange(10_000)]) for _ in range(n)]
        weights = [(5, 2, 1)[i % 3] for i in range(n)]
        assert mixing.capped_targets(sizes, weights, sum(sizes)) == plain_targets(sizes, weights, sum(sizes))
    start = time.perf_counter()
    targets = mixing.capped_targets([1000] * 100_000, [(5, 2, 1)[i % 3] for i in range(100_000)], 10**8)
    seats = mixing.sainte_lague(targets, 10**8 // 64, [47] * 100_000)
    assert sum(seats) == 10**8 // 64 and time.perf_counter() - start < 10
    assert sum(mixing.sainte_lague([1.0] * 50_000, 75_000, [9] * 50_000)) == 75_000


@pytest.mark.parametrize(
    ("page", "text"),
    [
        ("<article><p class=it's>One</p><p>Two's here</p><p>Three</p></article>", "One\n\nTwo's here\n\nThree"),
        ('<a href="x"">the "quoted" link</a>', 'the "quoted" link'),
        ('before<p title="x>text</p>', "before"),
        ("a < b <3 <!-- c --> d <!doctype x> e </> f <!---->g<!-->h<br/>i", "a < b <3 d e f gh i"),
        ("x<!-- never", "x"),
        ("<script>a</script>t<textarea>u", "t"),
        ("<a href=a/b>q</a><b a=1/>z</b>", "qz"),
        ("<p class='a\"b' id=c>r", "r"),
        ("<p a = 'x > y' b=\">\">s</p>", "s"),
        ("<p =x>t</p><p/ y>u", "t\n\nu"),
        ("tail <", "tail <"),
        ("tail <b", "tail"),
    ],
)
def test_tags_end_where_browsers_end_them(page, text):
    assert html_text.main_text(page) == text


@pytest.mark.parametrize("page", ['<a href="' * 120_000, "<b>" * 200_000 + "</i>" * 200_000, "<" * 1_000_000, "<a " * 300_000, "<p x='" * 150_000, "<!--" * 250_000, "<script>" * 100_000])
def test_bad_pages_take_linear_time(page):
    start = time.perf_counter()
    html_text.main_text(page)
    assert time.perf_counter() - start < 8  # about a megabyte each; a second or two alone


NAMES = ["user-comments", "comment-section", "commentlist", "reader-comments", "sidebar", "related-links", "site-notice"]


@pytest.mark.parametrize("n_pages", [40, 3])
def test_apparatus_inside_articles_goes(spark, n_pages):
    """Blocks whose words differ on every page, at the article's end: on hosts with and without counts."""
    rows = []
    for name in NAMES:
        for i in range(n_pages):
            block = f'<div class="{name}"><p>{name} says {i * 37} of {i}</p><p>more {i * 91}</p></div>'
            rows.append((len(rows), f"https://{name}.example/{i}", f"<body><article><h1>Title {i}</h1><p>Text number {i} of the host.</p>{block}</article></body>"))
    got = html_text.extract(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()
    for r in got:
        i = int(r["url"].rsplit("/", 1)[1])
        assert r["text"] == f"Title {i}\n\nText number {i} of the host.", r


def test_apparatus_of_other_names_goes_by_its_shape(spark):
    rows = [(i, f"https://h.example/{i}", f'<article><p>Text {i}.</p><div class="post-comments-{i}"><p>said {i * 7}</p></div><section class="discussion"><p>Discussion {i}.</p></section><div class="article-header"><h2>Head {i}</h2></div></article>') for i in range(30)]
    got = html_text.extract(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()
    assert all(r["text"] == f"Text {r['page_id']}.\n\nDiscussion {r['page_id']}.\n\nHead {r['page_id']}" for r in got)
