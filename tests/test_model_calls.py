import glob
import os
import tempfile

import pytest

from pyspark.sql import functions as F

from marginalia.operators import model_calls, usage

ROW = "id int, model string, prompt string"


@pytest.fixture
def folders():
    return tempfile.mkdtemp(prefix="spark-"), f"{tempfile.mkdtemp(prefix='spark-')}/answers"


def logged(log, fail=lambda prompt, n: False):
    """A transport that notes each call as a file and fails as told."""

    def call(model, prompt):
        name = prompt.replace(" ", "_")
        n = len(glob.glob(f"{log}/{name}.*"))
        open(f"{log}/{name}.{n}", "w").close()
        if fail(prompt, n):
            raise TimeoutError("slow")
        return f'{{"said": "{prompt}"}}', 10, 3

    return call


def calls(log, prompt):
    return len(glob.glob(f"{log}/{prompt}.*"))


def test_each_prompt_is_called_once(spark, folders):
    log, path = folders
    rows = spark.createDataFrame([(1, "m", "a"), (2, "m", "b"), (3, "m", "a"), (4, "m", None), (5, None, "a"), (6, "k", "a")], ROW)
    got = {r["id"]: r["reply"] for r in model_calls.answered(rows, logged(log), path, parts=3).collect()}
    assert (calls(log, "a"), calls(log, "b")) == (2, 1)  # "a" of two models
    assert got[1] == got[3] and got[1]["answer"] == '{"said": "a"}' and got[4] is None and got[5] is None
    assert (got[2]["input_tokens"], got[2]["output_tokens"], got[2]["attempts"], got[2]["cached"]) == (10, 3, 1, False)
    again = model_calls.answered(rows, logged(log), path, parts=3)
    assert all(r["reply"]["cached"] for r in again.where("reply is not null").collect()) and calls(log, "b") == 1
    assert model_calls.usage(again).count() == 0
    assert model_calls.answered(rows.limit(0), logged(log), path).count() == 0


def test_two_failures_then_an_answer(spark, folders):
    log, path = folders
    waits = tempfile.mkdtemp(prefix="spark-")

    def pause(seconds):
        open(f"{waits}/{len(os.listdir(waits))}-{seconds}", "w").close()

    rows = spark.createDataFrame([(1, "m", "a"), (2, "m", "never")], ROW)
    call = logged(log, lambda prompt, n: prompt == "never" or n < 2)
    got = {r["id"]: r["reply"] for r in model_calls.answered(rows, call, path, parts=1, pause=pause).collect()}
    assert (got[1]["answer"], got[1]["attempts"], got[1]["error"]) == ('{"said": "a"}', 3, None)
    assert (got[2]["answer"], got[2]["attempts"], got[2]["error"]) == (None, 3, "TimeoutError: slow")
    assert sorted(x.split("-")[1] for x in os.listdir(waits)) == ["1.0", "1.0", "2.0", "2.0"]
    later = {r["id"]: r["reply"] for r in model_calls.answered(rows, logged(log), path, parts=1).collect()}
    assert later[2]["answer"] and not later[2]["cached"] and later[1]["cached"]  # a failure is tried again


def test_a_lost_job_repeats_no_stored_call(spark, folders):
    log, path = folders
    rows = spark.range(40).select(F.col("id").cast("int").alias("id"), F.lit("m").alias("model"), F.concat(F.lit("p"), "id").alias("prompt"))
    call = logged(log)

    def dies(model, prompt):
        if len(os.listdir(log)) >= 20:
            raise SystemExit("killed")  # no Exception: the worker ends
        return call(model, prompt)

    with pytest.raises(Exception, match="killed|SystemExit|Worker|crashed"):
        model_calls.answered(rows, dies, path, parts=8).count()
    stored = {r["key"] for r in model_calls.stored(spark, path).collect()}
    assert 0 < len(stored) < 40
    done = [r["prompt"] for r in rows.withColumn("key", model_calls.key(F.col("model"), F.col("prompt"))).collect() if r["key"] in stored]
    before = {p: calls(log, p) for p in done}
    got = model_calls.answered(rows, call, path, parts=8).collect()
    assert all(r["reply"]["answer"] for r in got) and {p: calls(log, p) for p in done} == before


def test_answers_without_json_are_asked_for_again(spark, folders):
    log, path = folders
    told = ["", "no object here", 'Sure: {"a": 1} done']

    def call(model, prompt):
        n = len(os.listdir(log))
        open(f"{log}/{n}", "w").close()
        return told[n], 5, 1

    rows = spark.createDataFrame([(1, "m", "a")], ROW)
    got = model_calls.decoded(model_calls.answered(rows, call, path, json_only=True, pause=lambda s: None), "a int").first()
    assert (got["value"]["a"], got["reply"]["attempts"], got["reply"]["input_tokens"]) == (1, 3, 15)


def test_prompts_and_costs(spark, folders):
    log, path = folders
    rows = spark.createDataFrame([(1, "m", "x{y}z"), (2, "m", None)], ROW).withColumn("prompt", model_calls.prompt("Say {p} of {id}, {other} and {p}.", p=F.col("prompt"), id=F.col("id")))
    assert [r["prompt"] for r in rows.orderBy("id").collect()] == ["Say x{y}z of 1, {other} and x{y}z.", None]
    made = model_calls.usage(model_calls.answered(rows, logged(log), path))
    prices = spark.createDataFrame([("m", 2.0, 10.0)], "model string, input_price double, output_price double")
    assert [(r["input_tokens"], r["output_tokens"], round(r["cost"], 9)) for r in usage.with_cost(made, prices, (0.0, 0.0)).collect()] == [(10, 3, 0.00005)]
