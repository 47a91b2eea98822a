"""Batches that can be stopped and taken up again, and their outcome.

A batch is a folder: answers/run=N holds what run N asked, a row a key with its
answer or error, and log what runs there were. A run takes its number from the
log before it asks anything, so none writes where another wrote. Tasks commit
their files one by one: what a stopped run had finished is there for the next.
"""

from __future__ import annotations

import time
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.utils import AnalysisException

from quaystone.session import small_batches

_LOG = "run long, state string, done long, skipped long, failed long"
#: Files of a task are there once the task is done, not only once the job is.
_TASK_COMMITS = {"mapreduce.fileoutputcommitter.algorithm.version": "2"}


def saved(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """The table at path, empty where there is none yet."""
    try:
        return spark.read.schema(schema).parquet(path)
    except AnalysisException:
        return spark.createDataFrame([], schema)


def _asked(spark: SparkSession, path: str, key: str, kind: str) -> DataFrame:
    """Every row that a run wrote: key, answer, error, run."""
    return saved(spark, f"{path}/answers", f"`{key}` {kind}, answer string, error string, seconds double, run long")


def _log(spark: SparkSession, path: str, *entry) -> None:
    spark.createDataFrame([entry], _LOG).coalesce(1).write.mode("append").parquet(f"{path}/log")


def run(rows: DataFrame, key: str, prompt: str, model: Callable[[str], str | None], path: str, at_once: int | None = None) -> DataFrame:
    """Asks model for each key of rows (key, prompt: columns) that has no answer
    at path yet, and gives one row: done, skipped and failed keys.

    A key whose prompt is null, whose model raises or says nothing fails: its
    error is kept, and the next run asks again. One that was answered is never
    asked again, also not after a run that was stopped. A key that comes twice
    is asked once, by the least of its prompts; rows without a key are left
    out. at_once: how many may be asked at the same time.
    """
    spark = rows.sparkSession
    small_batches(spark)
    kind = rows.schema[key].dataType.simpleString()
    # read before this run is in the log: what it writes is no part of what it skips
    before = answers(spark, path, key, kind).select(key)
    number = (saved(spark, f"{path}/log", _LOG).agg(F.max("run")).first()[0] or 0) + 1
    _log(spark, path, number, "begun", None, None, None)

    def ask(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            out = []
            for k, text in zip(pdf[key], pdf["_prompt"], strict=True):
                answer, error, began = None, None, time.monotonic()
                try:
                    answer = None if text is None else model(text)
                    error = None if answer is not None else "no prompt" if text is None else "no answer"
                except Exception as e:  # noqa: BLE001  a row that fails fails alone
                    error = f"{type(e).__name__}: {e}"
                out.append((k, answer, error, time.monotonic() - began))
            yield pd.DataFrame(out, columns=[key, "answer", "error", "seconds"])

    keys = rows.where(F.col(key).isNotNull()).groupBy(key).agg(F.min(prompt).alias("_prompt"))
    todo = keys.join(before, key, "left_anti")
    todo = todo.repartition(at_once, key) if at_once else todo
    at = f"{path}/answers/run={number}"
    todo.mapInPandas(ask, f"`{key}` {kind}, answer string, error string, seconds double").write.options(**_TASK_COMMITS).parquet(at)
    n = saved(spark, at, "answer string").agg(F.count("answer").alias("done"), F.count("*").alias("all")).first()
    skipped = keys.count() - n["all"]
    _log(spark, path, number, "ended", n["done"], skipped, n["all"] - n["done"])
    return spark.createDataFrame([(n["done"], skipped, n["all"] - n["done"])], "done long, skipped long, failed long")


def answers(spark: SparkSession, path: str, key: str, kind: str) -> DataFrame:
    """key, answer, run: what each key was answered, by the first run that got
    an answer."""
    found = _asked(spark, path, key, kind).where("answer is not null")
    return found.groupBy(key).agg(F.min(F.struct("run", "answer")).alias("a")).select(key, "a.answer", "a.run")


def failures(spark: SparkSession, path: str, key: str, kind: str) -> DataFrame:
    """key, error, tries: the keys without an answer, why the last run that
    asked them got none, and how many runs did."""
    held = _asked(spark, path, key, kind).groupBy(key).agg(F.count("answer").alias("n"), F.max_by("error", "run").alias("error"), F.count_distinct("run").alias("tries"))
    return held.where("n = 0").select(key, "error", "tries")


def runs(spark: SparkSession, path: str) -> DataFrame:
    """run, ended, done, skipped, failed of every run; of one that was stopped,
    no numbers."""
    held = saved(spark, f"{path}/log", _LOG).groupBy("run").agg(F.max(F.col("state") == "ended").alias("ended"), *[F.max(c).alias(c) for c in ("done", "skipped", "failed")])
    return held.orderBy("run")


def remembered(rows: DataFrame, prompt: str, model: Callable[[str], str | None], path: str, name: str = "answer") -> DataFrame:
    """rows with what model answers to prompt, by a store at path that is keyed
    by the prompt's SHA-256: a text that any earlier call, or another row, had
    answered is not asked again. Null where there is no answer."""
    spark = rows.sparkSession
    keyed = rows.withColumn("_key", F.sha2(F.col(prompt), 256))
    run(keyed, "_key", prompt, model, path)
    held = answers(spark, path, "_key", "string").select("_key", F.col("answer").alias("_answer"))
    return keyed.join(held, "_key", "left").drop("_key").withColumnRenamed("_answer", name)


def tally(rows: DataFrame, column: str) -> DataFrame:
    """column, n: its values by how often they occur, ties by value."""
    return rows.groupBy(column).agg(F.count("*").alias("n")).orderBy(F.desc("n"), column)


def newest(messages: DataFrame, n: int = 20) -> DataFrame:
    """The newest n messages, by id from the last down: a top-k listing."""
    return messages.orderBy(F.desc("email_id")).limit(n)


def in_order(messages: DataFrame, *keys: str) -> DataFrame:
    """Messages in ascending order of their ids, or of other keys."""
    return messages.orderBy(*(keys or ("email_id",)))


def by_id(messages: DataFrame, email_id: str) -> DataFrame:
    """The message of an id."""
    return messages.where(F.col("email_id") == email_id)


def comparable(results: DataFrame) -> DataFrame:
    """Results that have field rows and both documents."""
    return results.where(F.col("rows").isNotNull() & (F.size("rows") > 0) & F.col("si_path").isNotNull() & F.col("bl_path").isNotNull())


def shared_keys(one: DataFrame, other: DataFrame, key: str) -> DataFrame:
    """The keys that both tables have, each once."""
    return one.select(key).intersect(other.select(key))


def offenders(trials: DataFrame, by: list[str], holds: Column, key: str, most: int = 20) -> DataFrame:
    """by, trials, held, missed: over groups of trials, how many there are, how
    many hold, and the least keys of those that do not, at most so many. The
    list is a bounded top-n: each task keeps most keys a group before they are
    dealt, so no group is gathered."""
    rows = trials.withColumn("_holds", F.coalesce(holds, F.lit(False)))
    counted = rows.groupBy(*by).agg(F.count("*").alias("trials"), F.count_if("_holds").alias("held"))
    rank = F.row_number().over(Window.partitionBy(*by).orderBy(key))
    first = rows.where("not _holds").select(*by, key).withColumn("_n", rank).where(F.col("_n") <= most)
    listed = first.groupBy(*by).agg(F.array_sort(F.collect_list(key)).alias("missed"))
    same = [counted[c].eqNullSafe(listed[c]) for c in by]
    kind = trials.schema[key].dataType.simpleString()
    return counted.join(listed, same, "left").select(*[counted[c] for c in by], "trials", "held", F.coalesce("missed", F.array().cast(f"array<{kind}>")).alias("missed"))
