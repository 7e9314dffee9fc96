import bisect
import datetime
import os
import random
import tempfile

from pyspark.sql import functions as F

from marginalia.operators import enrichment, usage

DAY = datetime.timedelta(days=1)
START = datetime.datetime(2024, 1, 1)


def test_as_of_equals_a_search_per_row(spark):
    """One key holds most rows; times lie on days, so that bounds and ties occur; some keys and times are null."""
    rng = random.Random(2)
    pick = lambda: rng.choice(["hot"] * 6 + ["a", "b", None])
    when = lambda: rng.choice([None, *[START + i * DAY for i in range(60)]])
    rows = [(i, pick(), when()) for i in range(400)]
    lookups = [(pick(), when(), rng.choice([None, "x", "y"])) for _ in range(80)]
    want, sets = {}, {}
    for k, t, a in lookups:
        if k is not None and t is not None:
            sets.setdefault(k, []).append((t, (a is not None, a or "")))
    for s in sets.values():
        s.sort()
    for i, k, t in rows:
        s = sets.get(k, []) if t is not None else []
        at = bisect.bisect_right(s, (t, (True, "zz"))) if s else 0
        want[i] = (s[at - 1][0], s[at - 1][1][1] or None) if at and t - s[at - 1][0] <= 7 * DAY else None
    got = enrichment.as_of(spark.createDataFrame(rows, "id int, key string, at timestamp"), spark.createDataFrame(lookups, "key string, at timestamp, answer string"), "key", 7).collect()
    assert len(got) == 400 and {r["id"]: None if r["lookup"] is None else tuple(r["lookup"]) for r in got} == want
    assert sum(x is not None for x in want.values()) > 50


def test_only_missing_keys_are_looked_up(spark):
    log, path = tempfile.mkdtemp(prefix="spark-"), f"{tempfile.mkdtemp(prefix='spark-')}/lookups"

    def get(key):
        open(f"{log}/{key}.{random.random()}", "w").close()
        if key == "down":
            raise TimeoutError
        return None if key == "none" else key.upper()

    papers = spark.createDataFrame([(1, "a"), (2, "none"), (3, "down"), (4, "a"), (5, None)], "id int, doi string")
    asked = lambda: sorted(x.split(".")[0] for x in os.listdir(log))

    def run(now):
        return {r["id"]: None if r["lookup"] is None else r["lookup"]["answer"] or "" for r in enrichment.enrich(papers, "doi", path, get, now, 3).collect()}

    assert run("2024-01-01 00:00:00") == {1: "A", 2: "", 3: None, 4: "A", 5: None} and asked() == ["a", "down", "none"]
    assert run("2024-01-03 00:00:00")[2] == "" and asked() == ["a", "down", "down", "none"]  # "none" is known not to be known
    run("2024-01-09 00:00:00")
    assert asked() == ["a", "a", "down", "down", "down", "none", "none"]
    assert enrichment.enrich(papers.limit(0), "doi", path, get, "2024-01-09 00:00:00", 3).count() == 0


def test_prices_hold_from_their_day(spark):
    d = lambda m, n=1: datetime.datetime(2024, m, n)
    prices = [("m", d(1), d(3), 1.0, 0.0), ("m", d(2, 10), None, 2.0, 0.0), ("m", d(5), d(6), 3.0, 0.0), ("k", d(4), None, 9.0, 0.0), ("k", d(4), d(4), 5.0, 0.0)]
    calls = [(1, "m", d(1)), (2, "m", d(2, 9)), (3, "m", d(2, 10)), (4, "m", d(4, 30)), (5, "m", d(5, 31)), (6, "m", d(6)), (7, "k", d(3)), (8, "k", d(12)), (9, "z", d(1)), (10, None, d(1)), (11, "m", None)]
    made = usage.with_cost_at(
        spark.createDataFrame(calls, "id int, model string, at timestamp").withColumns({"input_tokens": F.lit(1_000_000), "output_tokens": F.lit(0)}),
        spark.createDataFrame(prices, "model string, valid_from timestamp, valid_to timestamp, input_price double, output_price double"),
        spark.createDataFrame([("m", 7.0, 0.0)], "model string, input_price double, output_price double"), (4.0, 4.0),
    )
    assert {r["id"]: r["cost"] for r in made.collect()} == {1: 1.0, 2: 1.0, 3: 2.0, 4: 2.0, 5: 3.0, 6: 7.0, 7: 4.0, 8: 9.0, 9: 4.0, 10: 4.0, 11: 7.0}
    text = made._jdf.queryExecution().executedPlan().toString()
    assert "HashJoin" in text or "SortMergeJoin" in text
    assert "NestedLoop" not in text and "Cartesian" not in text
