"""Calls of language models from tasks: retried, answered once for each prompt, and accounted for.

The answer table is keyed by a hash of model and prompt.  Only prompts that it lacks are called, each once however many
rows ask it; a call's answer goes to the table of its part as soon as that part is done, so that what is lost with an
executor or a job is at most the parts under way.
"""

from __future__ import annotations

import json
import time
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from marginalia.functions import text as T
from marginalia.operators.shared import cut, exists

#: (model, prompt) -> (answer, input tokens, output tokens); an exception where there is none.
Call = Callable[[str, str], tuple[str, int, int]]
ANSWERS = "key string, model string, answer string, input_tokens long, output_tokens long, attempts int, error string"


def key(model: Column, prompt: Column) -> Column:
    return F.sha2(F.concat_ws("\x1f", model, prompt), 256)


def ask(call: Call, model: str, prompt: str, attempts: int, json_only: bool, pause: Callable[[float], None] = time.sleep) -> tuple:
    """(answer, input tokens, output tokens, attempts, error) of one prompt; tokens are those of all its attempts.

    An empty answer counts as a failure, and so does one that holds no JSON object if that is asked for; before the
    second attempt it waits a second, before each further one twice as long.
    """
    tokens, error = [0, 0], None
    for n in range(attempts):
        if n:
            pause(2.0 ** (n - 1))
        try:
            answer, given, made = call(model, prompt)
        except Exception as e:  # a transport's failure is told in the answer's row
            error = f"{type(e).__name__}: {e}"
            continue
        tokens = [tokens[0] + given, tokens[1] + made]
        if not answer or not answer.strip():
            error = "empty response from model"
        elif json_only and not holds_object(answer):
            error = "unparseable response"
        else:
            return answer, *tokens, n + 1, None
    return None, *tokens, attempts, error


def holds_object(answer: str) -> bool:
    """Whether an answer is JSON, or has a block or an object of it inside (``functions.text.extract_json`` takes it out)."""
    inner = [answer]
    if "```" in answer:
        inner.append(answer.split("```", 2)[1].removeprefix("json"))
    if "{" in answer and "}" in answer:
        inner.append(answer[answer.index("{") : answer.rindex("}") + 1])
    for text in inner:
        try:
            json.loads(text)
            return True
        except ValueError:
            pass
    return False


def stored(spark, path: str) -> DataFrame:
    """The answer table: one row for each key, an answer before a failure."""
    if not exists(spark, path):
        return spark.createDataFrame([], ANSWERS)
    rows = spark.read.schema(f"{ANSWERS}, part int").parquet(path).drop("part")
    rest = [c.split(" ")[0] for c in ANSWERS.split(", ")][1:]
    best = F.min_by(F.struct(*rest), F.struct(F.col("answer").isNull(), "attempts", "answer"))
    return rows.groupBy("key").agg(best.alias("r")).select("key", *[F.col("r")[c].alias(c) for c in rest])


def answered(prompts: DataFrame, call: Call, path: str, parts: int = 32, attempts: int = 3, json_only: bool = False, pause: Callable[[float], None] = time.sleep) -> DataFrame:
    """``prompts`` (model, prompt, and more) with ``reply`` (answer, input_tokens, output_tokens, attempts, error, cached).

    Prompts without an answer in the table at ``path`` are called, a part of them (by their hash) after the other, each
    part by all tasks at once.  Failed ones are tried again by the next run.  ``cached`` marks answers that were there
    before; a null prompt or model gets a null reply.
    """
    spark = prompts.sparkSession
    rows = cut(prompts.withColumn("_key", F.when(F.col("prompt").isNotNull() & F.col("model").isNotNull(), key(F.col("model"), F.col("prompt")))))
    before = cut(stored(spark, path).where("answer is not null").select("key"))
    asked = rows.where("_key is not null").groupBy(F.col("_key").alias("key")).agg(F.first("model").alias("model"), F.first("prompt").alias("prompt"))
    todo = cut(asked.join(before, "key", "left_anti").withColumn("part", F.pmod(F.xxhash64("key"), F.lit(parts)).cast("int")))

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            for k, model, prompt in zip(f["key"], f["model"], f["prompt"], strict=True):
                yield pd.DataFrame([(k, model, *ask(call, model, prompt, attempts, json_only, pause))], columns=[c.split(" ")[0] for c in ANSWERS.split(", ")])

    for part in sorted(r["part"] for r in todo.select("part").distinct().collect()):  # ``parts`` at most
        mine = todo.where(F.col("part") == part).repartition(spark.sparkContext.defaultParallelism, "key")
        mine.select("key", "model", "prompt").mapInPandas(run, ANSWERS).write.mode("append").parquet(f"{path}/part={part}")
    table = stored(spark, path).join(before.withColumnRenamed("key", "_old"), F.col("key") == F.col("_old"), "left")
    reply = F.struct("answer", "input_tokens", "output_tokens", "attempts", "error", F.col("_old").isNotNull().alias("cached"))
    return rows.join(table.select(F.col("key").alias("_key"), reply.alias("reply")), "_key", "left").drop("_key")


def prompt(template: str, **columns: Column) -> Column:
    """A prompt from a template with ``{name}`` places, each filled by a column; null if one of them is."""
    parts, rest = [], template
    while rest:
        at = min((i for n in columns if (i := rest.find("{" + n + "}")) >= 0), default=-1)
        if at < 0:
            parts.append(F.lit(rest))
            break
        name = next(n for n in columns if rest.startswith("{" + n + "}", at))
        parts += [F.lit(rest[:at]), columns[name].cast("string")]
        rest = rest[at + len(name) + 2 :]
    return F.concat(*parts) if parts else F.lit("")


def usage(replies: DataFrame) -> DataFrame:
    """(model, input_tokens, output_tokens) of the calls that were made, a row for each distinct prompt: what is paid for."""
    made = replies.where("reply is not null and not reply.cached")
    once = made.groupBy("model", key(F.col("model"), F.col("prompt")).alias("key")).agg(F.first("reply").alias("r"))
    return once.select("model", F.col("r.input_tokens").alias("input_tokens"), F.col("r.output_tokens").alias("output_tokens"))


def decoded(replies: DataFrame, schema: str, name: str = "value") -> DataFrame:
    """``replies`` with the JSON object of each answer as a struct; null where there is none."""
    return replies.withColumn(name, F.from_json(T.extract_json(F.col("reply.answer")), schema))
