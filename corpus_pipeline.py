"""The corpus pipeline: language, near copies, personal data, source mix, packing.

Every stage takes (spark, docs, sf_dir) and returns a DataFrame that is written as Parquet and read again as the
next stage's docs; all but the last return the columns of documents.  An empty table goes through all of them as such, and columns beyond
those of documents are kept by all but the last.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomspark.llm import language_id
from loomspark.llm.exchange import kept
from loomspark.llm.minhash_dedup import near_duplicates
from loomspark.llm.mixing import mix_sources, mixed_rows
from loomspark.llm.packing import pack_documents
from loomspark.llm.pii import redact

#: A text whose commonest language has less than this share of its words is rejected, as is one without a letter.
MIXED_BELOW = 0.5
SHINGLE, PERCENT = 5, 80


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps texts with one prevailing language; a missing lang becomes the prediction.

    Null texts and those without a letter have no language and go; repeated rows and rows without an id are judged each by itself;
    a share that ties with MIXED_BELOW stays.
    """
    columns = docs.columns
    found = language_id.predict(docs, language_id.learn(docs), carry=tuple(columns))
    good = found.where((F.col("lang_pred") != language_id.UNKNOWN) & (F.col("score") >= MIXED_BELOW))
    return good.select(*(F.coalesce("_lang", "lang_pred").alias(c) if c == "lang" else F.col(f"_{c}").alias(c) for c in columns))


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one document of each group of near copies (five-word shingles, similarity 0.8), the one with the least id.

    Rows of one id are one document with several texts and share its fate; of its equal texts one row stays.  Rows without an
    id, and empty texts, are nobody's copies and stay.
    """
    gone = near_duplicates(docs, shingle=SHINGLE, percent=PERCENT).where("not kept").select("doc_id").distinct()
    again = docs.where("doc_id is not null").groupBy("doc_id").count().where("count > 1").select("doc_id")
    gone, again = kept(gone, "gone"), kept(again, "again")
    single = docs.join(gone.unionByName(again).distinct(), "doc_id", "left_anti")
    several = docs.join(again.join(gone, "doc_id", "left_anti"), "doc_id", "left_semi").dropDuplicates(["doc_id", "text"])
    return single.select(docs.columns).unionByName(several.select(docs.columns))


def mask_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Masks personal data in the texts, whole ones of any length; null stays null, and every row stays."""
    return redact(docs).withColumn("n_chars", F.length("text").cast("long")).select(docs.columns)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row for each draw of the mix, in shard order.  Texts without words are not drawn; rows without a source are one of their own; repeated rows share their fate."""
    return mixed_rows(mix_sources(docs), docs.columns)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token sequences: the pieces of every row with their ids and places; a null or empty text is its end id alone."""
    return pack_documents(docs)


STAGES = [("language_id", identify_language), ("near_dedup", drop_near_copies), ("pii", mask_personal_data), ("source_mix", mix), ("packing", pack)]

ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last stage's rows."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = kept(stage(spark, docs, sf_dir), f"stage-{name}")
    return docs
