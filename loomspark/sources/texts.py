"""Text files, inline texts and their guards."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

MAX_CHARS = 10 * 1024 * 1024


def _gbk(content: pd.Series) -> pd.Series:
    """Bytes as GBK (which Spark's own decode doesn't know), or null."""

    def one(raw: bytes | None) -> str | None:
        try:
            return None if raw is None else bytes(raw).decode("gbk")
        except UnicodeDecodeError:
            return None

    return content.map(one)


def read_texts(spark: SparkSession, path: str, pattern: str = "*.txt") -> DataFrame:
    """(id, title, text, error): whole files as UTF-8, else GBK; a blank or undecodable file has an error and no text (files of no bytes give no row)."""
    raw = spark.read.format("binaryFile").option("pathGlobFilter", pattern).load(path).select("path", "content")
    utf8 = F.when(F.is_valid_utf8(F.col("content").cast("string")), F.col("content").cast("string"))
    rows = raw.withColumn("_utf8", utf8).withColumn("_gbk", F.when(F.col("_utf8").isNull(), F.pandas_udf(_gbk, T.StringType())("content")))
    text = F.coalesce("_utf8", "_gbk")
    title = F.regexp_replace(F.regexp_extract("path", r"([^/]+)$", 1), r"\.txt$", "")
    rows = rows.select(F.substring(F.sha2(F.col("path").cast("binary"), 256), 1, 8).alias("id"), F.url_decode(title).alias("title"), text.alias("text"))
    return guarded(rows)


def guarded(rows: DataFrame, most: int = MAX_CHARS) -> DataFrame:
    """Adds error: undecodable, empty, or longer than allowed; such rows have no text."""
    error = F.when(F.col("text").isNull(), "encoding").when(F.trim("text") == "", "empty").when(F.length("text") > most, "too long")
    return rows.withColumn("error", error).withColumn("text", F.when(error.isNull(), F.col("text")))


def inline_text(spark: SparkSession, title: str, text: str) -> DataFrame:
    """A text given in the call; blank content is one empty chapter later on."""
    return spark.createDataFrame([(title, text)], "title string, text string").select(F.substring(F.sha2(F.concat_ws("\n", "title", "text").cast("binary"), 256), 1, 8).alias("id"), "title", "text")
