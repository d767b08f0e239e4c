"""Which character of a library a name means: by itself, an alias, a title that ends one name alone, the end of the name, or its core word.

Everything is an equality on (project, text): the ends of names and of candidates are keys, so no candidate is held against a library
name by name.  Candidates are matched once for each different text and project, however often one is there.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: What a match is worth.
SURE = {"name": 1.0, "alias": 0.9, "title": 0.85, "suffix": 0.85, "core": 0.85}


def endings(text: Column, least: int = 1, whole: bool = True) -> Column:
    """The ends of a text of `least` characters or more, longest first; whole: itself too."""
    first = F.lit(1 if whole else 2)
    last = F.length(text) - least + 1
    return F.when(last >= first, F.transform(F.sequence(first, last), lambda i: F.substring(text, i, F.length(text)))).otherwise(F.array().cast("array<string>"))


def _keyed(characters: DataFrame, by: list[str], key: Column, how: str, rank: int) -> DataFrame:
    return characters.select(*by, key.alias("_key"), F.struct(F.lit(rank).alias("rank"), F.lit(0).alias("place"), F.col("id"), F.col("name"), F.lit(how).alias("how")).alias("_m"))


def titles(characters: DataFrame, by: list[str]) -> DataFrame:
    """(by, key, id, name) for every text that is the end of one character's name, or an alias of theirs, and of no other's."""
    ends = F.array_distinct(F.concat(endings(F.col("name")), F.coalesce("aliases", F.array().cast("array<string>"))))
    keyed = characters.select(*by, "id", "name", F.explode(ends).alias("_key")).where("_key is not null")
    return keyed.groupBy(*by, "_key").agg(F.count_distinct("id").alias("_n"), F.min(F.struct("id", "name")).alias("_p")).where("_n = 1").select(*by, "_key", F.col("_p.id").alias("id"), F.col("_p.name").alias("name"))


def _resolved(wanted: DataFrame, found: DataFrame, by: list[str], key: str) -> DataFrame:
    best = found.groupBy(*by, key).agg(F.min("_m").alias("_m"))
    sure = F.coalesce(*(F.when(F.col("_m.how") == h, F.lit(s)) for h, s in SURE.items()))
    best = best.select(*by, key, F.col("_m.id").alias("id"), F.col("_m.name").alias("standard_name"), sure.alias("confidence"), F.col("_m.how").alias("how"))
    return wanted.join(best, [*by, key], "left")


def match_titles(wanted: DataFrame, characters: DataFrame, by: list[str], key: str = "key") -> DataFrame:
    """Adds id, standard_name, confidence and how (nulls without a match) to rows (by, key): by name, then alias, then a title that is unambiguous.

    characters: (by, id, name, aliases).  Of several characters with one name or alias the least id is taken.
    """
    texts = wanted.select(*by, F.col(key).alias("_key")).where("_key is not null").distinct()
    exact = _keyed(characters, by, F.col("name"), "name", 1).unionByName(_keyed(characters, by, F.explode("aliases"), "alias", 2)).unionByName(_keyed(titles(characters, by), by, F.col("_key"), "title", 3))
    return _resolved(wanted, texts.join(exact, [*by, "_key"]).withColumnRenamed("_key", key), by, key)


def match_candidates(wanted: DataFrame, characters: DataFrame, by: list[str], core_words: tuple[str, ...], key: str = "key", longest: int = 64) -> DataFrame:
    """As match_titles, for speaker candidates: by name, alias, a library name that ends a candidate of four characters or more, and the longest core word that ends it.

    A core word means the character of that name, else the least id whose name contains it.  Names longer than `longest` end no candidate.
    """
    texts = wanted.select(*by, F.col(key).alias("_key")).where("_key is not null").distinct()
    exact = texts.join(_keyed(characters, by, F.col("name"), "name", 1).unionByName(_keyed(characters, by, F.explode("aliases"), "alias", 2)), [*by, "_key"])
    text = F.col("_key")
    ends = texts.where(F.length(text) >= 4).select(*by, text.alias("_whole"), F.explode(endings(F.expr(f"right(_key, {longest + 1})"), 2, whole=False)).alias("_key"))
    named = ends.join(_keyed(characters.where(F.length("name") >= 2), by, F.col("name"), "suffix", 3), [*by, "_key"]).select(*by, F.col("_whole").alias("_key"), "_m")
    ordered = sorted(set(core_words), key=lambda w: (-len(w), w))
    placed = [F.struct(F.lit(i).alias("place"), F.lit(w).alias("word")) for i, w in enumerate(ordered)]
    words = F.filter(F.array(*placed), lambda w: F.endswith(text, w["word"]) & (F.length(text) > F.length(w["word"]))) if ordered else F.array().cast("array<struct<place:int,word:string>>")
    cored = texts.select(*by, "_key", F.explode(words).alias("_w")).select(*by, "_key", "_w.place", "_w.word")
    holds = F.filter(F.array(*(F.lit(w) for w in ordered)), lambda w: F.contains(F.col("name"), w)) if ordered else F.array().cast("array<string>")
    by_word = characters.select(*by, "id", "name", F.explode(holds).alias("word")).groupBy(*by, "word").agg(F.min(F.struct((F.col("name") != F.col("word")).alias("other"), F.col("id"), F.col("name"))).alias("_p"))
    core = cored.join(by_word, [*by, "word"]).select(*by, "_key", F.struct(F.lit(4).alias("rank"), F.col("place"), F.col("_p.id").alias("id"), F.col("_p.name").alias("name"), F.lit("core").alias("how")).alias("_m"))
    return _resolved(wanted, exact.unionByName(named).unionByName(core).withColumnRenamed("_key", key), by, key)
