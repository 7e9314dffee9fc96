"""Each stage of the pipeline against a plain version, on what the stage before it kept."""

from collections import Counter

import pytest

import corpus_pipeline as pipeline
from marginalia.llm import quality_rules
from marginalia.llm.common import scratch

from . import brute

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def stages(spark):
    """(input, output) rows of each stage."""
    out, docs = {}, pipeline.table(spark, SF, "documents")
    for name, stage in pipeline.STAGES:
        path = scratch(spark, name)
        stage(spark, docs, SF).write.parquet(path)
        after = spark.read.parquet(path)
        out[name] = (docs.collect(), after.collect(), after.columns)
        docs = after
    return out


def test_columns(stages):
    for name, (_, _, columns) in list(stages.items())[:-1]:
        assert tuple(columns) == pipeline.COLUMNS, name


def test_rules_drop_what_they_reject(spark, stages):
    before, after, _ = stages["quality_rules"]
    trusted = pipeline.table(spark, SF, "labels").where("quality = 1").select("doc_id")
    kept = {r["doc_id"] for r in quality_rules.quality_rules(pipeline.table(spark, SF, "documents"), trusted).collect() if r["kept"]}
    assert {r["doc_id"] for r in after} == kept
    for r in after:
        n, *_, repeated = brute.statistics(r["text"])
        assert n >= 50 and 100 * repeated <= 50 * n
    assert 0 < len(after) < len(before)


def test_classifier_keeps_good_documents(spark, stages):
    before, after, _ = stages["quality_classifier"]
    label = {r["doc_id"]: r["quality"] for r in pipeline.table(spark, SF, "labels").collect()}
    good = [r["doc_id"] for r in before if label.get(r["doc_id"]) == 1]
    kept = {r["doc_id"] for r in after}
    assert sum(i in kept for i in good) >= 0.95 * len(good)
    assert kept <= {r["doc_id"] for r in before}


def test_one_of_each_group_stays(stages):
    before, after, _ = stages["minhash_dedup"]
    want, _ = brute.components([(r["doc_id"], r["text"]) for r in before], 5, 80)
    assert sorted(r["doc_id"] for r in after) == sorted(i for i, c in want.items() if i == c)


def test_mix_repeats_documents_at_most_three_times(stages):
    before, after, _ = stages["mixing"]
    size = {r["doc_id"]: len(brute.words(r["text"])) for r in before}
    taken = Counter()
    for r in after:
        taken[r["doc_id"]] += len(brute.words(r["text"]))
        assert r["n_chars"] == len(r["text"])
    assert all(n <= 3 * size[i] for i, n in taken.items())
    assert sum(taken.values()) == pytest.approx(sum(size.values()), rel=0.05)


def test_encoding_matches_library(stages):
    from tokenizers import Tokenizer

    library = Tokenizer.from_file(pipeline.vocabulary("word_bpe_49k.json"))
    before, after, _ = stages["bpe"]
    want = Counter((r["doc_id"], tuple(library.encode(r["text"], add_special_tokens=False).ids)) for r in before)
    assert Counter((r["doc_id"], tuple(memoryview(bytes(r["ids"])).cast("I"))) for r in after) == want
    assert all(r["n_tokens"] == len(r["ids"]) // 4 for r in after)
