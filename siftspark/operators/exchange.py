"""A durable exchange with a reviewer: what was asked, what came back, what is still open.

The exchange is a folder of events that only grows. A request is opened, asked, and answered or answered badly;
its state follows from its events by a maximum, so an event that is written twice, by a repeated task or by a
second run over the same folder, changes nothing. A run that is broken off is started again with the same
folder and asks what is still open.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from siftspark.operators.external import parse_responses

EVENTS = "request_id string, state string, attempt int, text string"
# An answer that can be read settles a request; else its last attempt counts.
_WEIGHT = "CASE state WHEN 'answered' THEN 1000000 WHEN 'bad' THEN 2 * attempt + 1 WHEN 'asked' THEN 2 * attempt ELSE 0 END"
ATTEMPTS = 2


def _append(events: DataFrame, folder: str) -> None:
    events.select("request_id", "state", F.col("attempt").cast("int").alias("attempt"), "text").write.mode("append").parquet(folder)


def events_of(spark: SparkSession, folder: str) -> DataFrame:
    try:
        return spark.read.schema(EVENTS).parquet(folder)
    except AnalysisException:
        return spark.createDataFrame([], EVENTS)


def states(events: DataFrame) -> DataFrame:
    """(request_id, state, attempts, text): one row per request, text of the answer that holds.

    Of several readable answers the one of the earliest attempt holds, then the least text.
    """
    weighed = events.withColumn("weight", F.expr(_WEIGHT))
    latest = weighed.groupBy("request_id").agg(
        F.max_by("state", "weight").alias("state"), F.max("attempt").alias("attempts"),
        F.min(F.when(F.col("state") == "answered", F.struct("attempt", "text"))).alias("held"))
    return latest.selectExpr("request_id", "state", "attempts", "held.text AS text")


def judged(answers: DataFrame) -> DataFrame:
    """Answers (request_id, attempt, text) as events: answered if the text holds a JSON object, else bad."""
    parsed = parse_responses(answers.selectExpr("'' AS repo", "request_id", "text"))
    good = parsed.groupBy("request_id").agg(F.min("valid_json").alias("valid"))
    empty = F.lit(True)      # an object without findings leaves no row behind
    return answers.join(good, "request_id", "left").select(
        "request_id", F.when(F.coalesce("valid", empty), "answered").otherwise("bad").alias("state"), "attempt", "text")


def exchange(requests: DataFrame, reviewer: Callable[[Iterator], Iterator], folder: str,
             known: DataFrame | None = None, attempts: int = ATTEMPTS) -> DataFrame:
    """``requests`` with state, attempts and text after asking at most ``attempts`` times.

    ``reviewer`` is a ``mapInPandas`` function from (request_id, attempt, prompt) to (request_id, text).
    ``known`` holds answers of earlier runs by request id: these are not asked. Requests with one id are
    asked once. Rounds are as many as attempts; each writes what it asked before it asks, and what came
    back before the next begins. Rounds move ids: prompts stay where they are if ``requests`` are bucketed by
    ``request_id``, else those of a round that asks anything are shuffled once in it.
    """
    spark = requests.sparkSession
    ids = requests.select("request_id").distinct()
    opened = ids.selectExpr("request_id", "'open' AS state", "0 AS attempt", "cast(NULL AS string) AS text")
    _append(opened.join(events_of(spark, folder).select("request_id").distinct(), "request_id", "left_anti"), folder)
    if known is not None:
        cached = known.join(ids, "request_id", "left_semi")
        _append(judged(cached.selectExpr("request_id", "0 AS attempt", "text")).where("state = 'answered'"), folder)
    for attempt in range(1, attempts + 1):
        # Asked without an answer: a run that was broken off; asked again under the same number.
        left = states(events_of(spark, folder)).where(
            f"state = 'open' OR (state = 'bad' AND attempts < {attempt}) OR (state = 'asked' AND attempts <= {attempt})")
        # The events are written from a table of their own: the folder they are read from grows meanwhile.
        path = f"{folder}-round-{attempt}"
        ids.join(left.select("request_id"), "request_id", "left_semi").write.mode("overwrite").parquet(path)
        due = spark.read.schema("request_id string").parquet(path)
        if due.isEmpty():
            continue
        _append(due.selectExpr("request_id", "'asked' AS state", f"{attempt} AS attempt", "cast(NULL AS string) AS text"), folder)
        asked = requests.select("request_id", "prompt").join(due, "request_id", "left_semi").groupBy("request_id").agg(
            F.lit(attempt).alias("attempt"), F.min("prompt").alias("prompt"))
        answers = asked.mapInPandas(reviewer, "request_id string, text string")
        came = f"{folder}-answers-{attempt}"
        answers.write.mode("overwrite").parquet(came)
        answers = spark.read.schema("request_id string, text string").parquet(came)
        _append(judged(answers.where("request_id IS NOT NULL").selectExpr("request_id", f"{attempt} AS attempt", "coalesce(text, '') AS text")), folder)
    return requests.join(states(events_of(spark, folder)), "request_id")
