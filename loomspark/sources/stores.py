"""Project stores, lexicons, answer keys, and the exports."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def read_project_store(spark: SparkSession, path: str, schema: str = "id string, title string, text string") -> DataFrame:
    """Projects as JSON; the schema is given, so nothing is scanned to find it."""
    return spark.read.schema(schema).option("multiLine", True).json(path)


def write_project_store(projects: DataFrame, path: str) -> None:
    projects.write.mode("overwrite").json(path)


def read_answer_key(spark: SparkSession, path: str, schema: str) -> DataFrame:
    return spark.read.schema(schema).option("multiLine", True).json(path)


def read_table_lines(spark: SparkSession, path: str, columns: list[str]) -> DataFrame:
    """Rows of pipe tables in a text file, without rules and header."""
    cells = F.transform(F.split(F.regexp_replace("value", r"^\s*\||\|\s*$", ""), r"\|"), lambda c: F.trim(c))
    rows = spark.read.text(path).where(F.col("value").rlike(r"^\s*\|") & ~F.col("value").rlike(r"^\s*\|[\s:|-]+$")).select(cells.alias("c")).where(F.size("c") == len(columns))
    return rows.select(*(F.col("c")[i].alias(n) for i, n in enumerate(columns))).where(F.col(columns[0]) != columns[0])


def read_lexicon(spark: SparkSession, path: str, defaults: list[str] = ()) -> DataFrame:
    """Distinct words of a JSON list or of its "words", with defaults."""
    text = spark.read.text(path, wholetext=True)
    words = F.coalesce(F.from_json("value", "array<string>"), F.from_json("value", "words array<string>")["words"])
    found = text.select(F.explode(words).alias("word"))
    return (found.union(spark.createDataFrame([(w,) for w in defaults], "word string")) if defaults else found).where("word is not null").distinct()


def save_table(df: DataFrame, name: str, by: list[str] = ()) -> None:
    """A Parquet table, created if it isn't there, appended to if it is."""
    writer = df.write.mode("append").format("parquet")
    (writer.partitionBy(*by) if by else writer).saveAsTable(name)


def role_store(names: DataFrame) -> DataFrame:
    """(doc, name, positions) -> one JSON row per document with a map of names."""
    return names.groupBy("doc_id").agg(F.to_json(F.map_from_entries(F.sort_array(F.collect_list(F.struct("name", "positions"))))).alias("named_characters"))


def read_role_store(rows: DataFrame) -> DataFrame:
    return rows.select("doc_id", F.explode(F.from_json("named_characters", "map<string,array<int>>")).alias("name", "positions"))


def chapters_json(sentences: DataFrame, by: list[str], order: str, fields: list[str]) -> DataFrame:
    """One JSON document per chapter with statistics and its sentences in order."""
    rows = F.sort_array(F.collect_list(F.struct(F.col(order).alias("_o"), *fields)))
    listed = F.transform(rows, lambda x: F.struct(*(x[f].alias(f) for f in fields)))
    return sentences.groupBy(*by).agg(F.to_json(F.struct(F.count(F.lit(1)).alias("total_sentences"), listed.alias("sentences"))).alias("json"))


def escaped(text: Column) -> Column:
    return F.replace(F.replace(F.replace(text, F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;")), F.lit(">"), F.lit("&gt;"))


def chapters_ssml(sentences: DataFrame, by: list[str], order: str, text: str, title: Column, escape: bool = False) -> DataFrame:
    """A paragraph per chapter with a comment and one element per sentence."""
    body = F.transform(F.sort_array(F.collect_list(F.struct(order, F.col(text).alias("t")))), lambda x: F.concat(F.lit("<s>"), escaped(x["t"]) if escape else x["t"], F.lit("</s>")))
    return sentences.groupBy(*by).agg(F.concat(F.lit("<p><!-- "), F.first(title), F.lit(" -->"), F.array_join(body, ""), F.lit("</p>")).alias("ssml"))
