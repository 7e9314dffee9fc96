import random

import pytest
from pyspark.sql import functions as F

from marginalia.operators import ledger, merge


def sequential(rows):
    """A store with two unique columns, row by row."""
    stored, out = [], {}
    for seq, doi, pmid in sorted(rows):
        doi, pmid = doi or None, pmid or None
        hit = next((s for s in stored if doi and s["doi"] == doi), None) or next((s for s in stored if pmid and s["pmid"] == pmid), None)
        if hit is None:
            stored.append({"seq": seq, "doi": doi, "pmid": pmid})
            out[seq] = (seq, "added")
            continue
        new = {"doi": hit["doi"] or doi, "pmid": hit["pmid"] or pmid}
        clash = any(o is not hit and ((new["doi"] and o["doi"] == new["doi"]) or (new["pmid"] and o["pmid"] == new["pmid"])) for o in stored)
        if clash:
            out[seq] = (hit["seq"], "failed")
        else:
            hit.update(new)
            out[seq] = (hit["seq"], "merged")
    return out


@pytest.mark.parametrize("seed", range(3))
def test_merge_equals_sequential_store(spark, seed):
    rng = random.Random(seed)
    pick = lambda p, n: rng.choice([None, "", *[f"{p}{i}" for i in range(n)]])
    rows = [(i, pick("d", 25), pick("p", 25)) for i in range(120)]
    got = merge.merge_records(spark.createDataFrame(rows, "seq long, doi string, pmid string")).collect()
    assert {r["seq"]: (r["publication"], r["outcome"]) for r in got} == sequential(rows)


def test_bridging_row_fails(spark):
    rows = [(1, "a", None), (2, None, "x"), (3, "a", "x"), (4, "a", "y"), (5, "", ""), (6, None, None)]
    got = merge.merge_records(spark.createDataFrame(rows, "seq long, doi string, pmid string")).collect()
    assert {r["seq"]: (r["publication"], r["outcome"]) for r in got} == {1: (1, "added"), 2: (2, "added"), 3: (1, "failed"), 4: (1, "merged"), 5: (5, "added"), 6: (6, "added")}


def test_merge_of_one_large_component(spark):
    """No Python group holds a component, and a chain of identifiers is followed to its end."""
    rows = [(i, f"d{i % 4}" if i % 4 else None, f"p{i // 3}" if i % 3 else None) for i in range(300)]
    rows += [(1000 + i, f"c{(i + 1) // 2}", f"q{i // 2}") for i in range(24)]
    merged = merge.merge_records(spark.createDataFrame(rows, "seq long, doi string, pmid string"))
    assert "InPandas" not in merged._jdf.queryExecution().toString()
    assert {r["seq"]: (r["publication"], r["outcome"]) for r in merged.collect()} == sequential(rows)


def test_fold_fills_but_keeps_the_first(spark):
    rows = [(2, "k", "s2", "T2", "A2", ["x"], True), (1, "k", "s1", "T1", None, [], False), (3, "k", "s1", "T3", "A3", ["y"], False)]
    r = merge.fold_by_key(spark.createDataFrame(rows, "seq long, key string, source string, title string, abstract string, authors array<string>, oa boolean"), ["key"], filled=["abstract"], lists=["authors"], flags=["oa"], firsts=["title"]).first()
    assert (r["title"], r["abstract"], r["authors"], r["oa"], r["sources"], r["n_rows"], r["first_seen_source"]) == ("T1", "A2", ["x"], True, ["s1", "s2"], 3, "s1")


def test_find_existing_prefers_doi(spark):
    stored = spark.createDataFrame([(1, "a", None), (2, None, "x"), (3, "", "")], "id long, doi string, pmid string")
    rows = spark.createDataFrame([(1, "a", "x"), (2, None, "x"), (3, "b", "x"), (4, "", ""), (5, None, None)], "seq long, doi string, pmid string")
    assert {r["seq"]: r["existing_id"] for r in merge.find_existing(stored, rows).collect()} == {1: 1, 2: 2, 3: 2, 4: None, 5: None}


def test_outcomes_of_keys_with_nulls(spark):
    rows = [(1, "a", None), (2, "a", None), (3, None, "x"), (4, None, "x"), (5, "b", "x"), (6, None, None)]
    frame = spark.createDataFrame(rows, "seq long, k string, l string")
    got = {r["seq"]: r["outcome"] for r in merge.outcomes(frame, ["k", "l"]).collect()}
    assert got == {1: "added", 2: "merged", 3: "added", 4: "merged", 5: "added", 6: "added"}


def test_insert_ignore(spark):
    key = "pub long, url string, seq long"
    got = merge.insert_ignore(spark.createDataFrame([(1, "u", 0)], key), spark.createDataFrame([(1, "u", 1), (1, "v", 3), (1, "v", 2), (2, "u", 4)], key), ["pub", "url"])
    assert {tuple(r) for r in got.collect()} == {(1, "v", 2), (2, "u", 4)}


def days(spark, ledger_rows, recheck):
    rows = spark.createDataFrame(ledger_rows, "source string, day string, status string, last_verified string").withColumn("day", F.to_date("day"))
    got = ledger.days_needing_fetch(spark.createDataFrame([("s",)], "source string"), rows, "2024-03-01", "2024-03-05", "2024-03-05", recheck)
    return sorted(str(r["day"])[-1] for r in got.collect())


def test_days_needing_fetch(spark):
    done = [("s", f"2024-03-0{i}", "completed", "2024-03-01") for i in (1, 2, 3)] + [("s", "2024-03-04", "failed", None), ("s", "2024-03-05", "completed", "2024-03-05")]
    assert days(spark, [], 0) == list("12345")
    assert days(spark, done, 0) == list("45")
    assert days(spark, done, 3) == list("12345")
    assert days(spark, done, 4) == list("45")  # verified exactly at the cutoff: not due
    assert days(spark, [("s", "2024-03-01", "completed", None)], 9) == list("12345")


def test_ledger_last_writer_wins(spark):
    stored = spark.createDataFrame([("s", "d1", "completed"), ("s", "d2", "failed")], "source string, day string, status string")
    new = spark.createDataFrame([("s", "d1", "failed", 5), ("s", "d1", "completed", 7), ("s", "d1", "failed", 6)], "source string, day string, status string, seq long")
    assert {tuple(r) for r in ledger.upsert(stored, new).collect()} == {("s", "d1", "completed"), ("s", "d2", "failed")}
