"""Streams of chapters and mentions.

Event time needs a TIMESTAMP column: a timestamp without zone is cast first.  State is kept per key in Spark's state
store, so it survives lost executors with the checkpoint location of the query.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout


def chapter_stream(spark: SparkSession, path: str, schema: str, files_per_trigger: int = 100) -> DataFrame:
    """New Parquet files of a folder as a stream."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger).parquet(path)


def running_frequencies(mentions: DataFrame, keys: list[str]) -> DataFrame:
    """Mentions per key so far (complete or update mode)."""
    return mentions.groupBy(*keys).agg(F.count(F.lit(1)).alias("frequency"))


def windowed_activity(events: DataFrame, time: str, keys: list[str], width: str = "1 hour", late: str = "2 hours") -> DataFrame:
    """Mentions per key and window; rows later than the watermark are left out and old windows are dropped from state."""
    timed = events.withColumn("_time", F.col(time).cast("timestamp")).withWatermark("_time", late)
    return timed.groupBy(F.window("_time", width), *keys).agg(F.count(F.lit(1)).alias("n"))


def streamed_promotions(mentions: DataFrame, key: str, order: str, at: int = 3) -> DataFrame:
    """(key, n, order): each key once, with the mention that makes it permanent; counts survive chapters."""

    def step(k: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        n = state.get[0] if state.exists else 0
        places = sorted(x for pdf in batches for x in pdf[order])
        if n < at <= n + len(places):
            yield pd.DataFrame({key: [k[0]], "n": [at], order: [places[at - n - 1]]})
        state.update((n + len(places),))

    kinds = {f.name: f.dataType.simpleString() for f in mentions.schema}
    return mentions.groupBy(key).applyInPandasWithState(step, f"{key} {kinds[key]}, n long, {order} {kinds[order]}", "n long", "append", GroupStateTimeout.NoTimeout)


def cold_start(chapters: DataFrame, project: str, text: str, least: int = 3000) -> DataFrame:
    """(project, chars): each project once, when its texts reach `least` characters."""

    def step(k: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        chars = state.get[0] if state.exists else 0
        more = chars + sum(int(pdf["n"].sum()) for pdf in batches)
        if chars < least <= more:
            yield pd.DataFrame({project: [k[0]], "chars": [more]})
        state.update((more,))

    kinds = {f.name: f.dataType.simpleString() for f in chapters.schema}
    sized = chapters.select(project, F.length(text).cast("long").alias("n"))
    return sized.groupBy(project).applyInPandasWithState(step, f"{project} {kinds[project]}, chars long", "chars long", "append", GroupStateTimeout.NoTimeout)
