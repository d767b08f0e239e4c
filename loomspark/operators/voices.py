"""Speech jobs: voices, prompts and the timeline of segments."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

NARRATOR = "narrator"


def job_plan(segments: DataFrame, voices: DataFrame, default_voice: str, prompts: dict[str, str] | None = None) -> DataFrame:
    """Voice, emotion, vector and prompt of every segment: narration is neutral in the narrator's voice; a role without a voice gets the default.

    voices: (speaker, voice).
    """
    told = F.col("type") == "narration"
    rows = segments.withColumn("speaker", F.when(told, F.lit(NARRATOR)).otherwise(F.col("speaker"))).join(voices, "speaker", "left")
    rows = rows.withColumn("voice", F.coalesce("voice", F.lit(default_voice)))
    if "emotion" in segments.columns:
        rows = rows.withColumn("emotion", F.when(told, F.lit("neutral")).otherwise(F.col("emotion")))
    if "emotion_vector" in segments.columns:
        rows = rows.withColumn("emotion_vector", F.when(~told, F.col("emotion_vector")))
    return rows.withColumn("prompt", prompt_of(F.col("emotion"), prompts)) if prompts and "emotion" in segments.columns else rows


def prompt_of(emotion: Column, prompts: dict[str, str]) -> Column:
    return F.coalesce(*(F.when(emotion == k, F.lit(v)) for k, v in prompts.items()), F.lit(""))


def duration(frames: Column, rate: Column, size: Column) -> Column:
    """Seconds: frames at a rate, or estimated from the size."""
    return F.coalesce(F.try_divide(frames.cast("double"), rate.cast("double")), size / 172.0 / 1000.0)


def timeline(segments: DataFrame, by: list[str], order: str, seconds: Column, text: str = "text", failed: Column | None = None) -> DataFrame:
    """Start and end of each segment; blank or failed ones have no length."""
    empty = F.coalesce(F.trim(F.col(text)), F.lit("")) == ""
    if failed is not None:
        empty = empty | failed
    rows = segments.withColumn("_d", F.when(empty, 0).otherwise(seconds))
    end = F.sum("_d").over(Window.partitionBy(*by).orderBy(order).rowsBetween(Window.unboundedPreceding, 0))
    return rows.withColumn("end_time", end).withColumn("start_time", F.col("end_time") - F.col("_d")).drop("_d")


# The voices on offer (id, name, gender, description, tags).
VOICES = (
    (1, "云深", "male", "沉稳磁性，适合旁白和成熟男性角色", ("磁性", "沉稳", "旁白")),
    (2, "凌风", "male", "清朗少年音，适合年轻男性角色", ("少年", "清朗", "热血")),
    (3, "若水", "female", "温婉知性，适合女性角色和内心独白", ("温婉", "知性", "柔美")),
    (4, "铁马", "male", "豪迈刚毅，适合武将和豪爽角色", ("豪迈", "刚毅", "霸气")),
    (5, "素心", "female", "清冷空灵，适合仙侠女性角色", ("清冷", "空灵", "仙侠")),
    (6, "墨言", "neutral", "中性沉稳，适合旁白和叙述", ("中性", "沉稳", "叙述")),
)


def voice_list(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([(*v[:4], list(v[4])) for v in VOICES], "id int, name string, gender string, description string, tags array<string>")
