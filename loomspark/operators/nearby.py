"""Names near verbs: who a narration tells of, where speech verbs are, and the name before each of them."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from loomspark.functions.dictionary import name_hits
from loomspark.functions.text import quote_pattern


def library_in_narration(texts: DataFrame, characters: DataFrame, by: list[str], keys: list[str], verbs: tuple[str, ...], text_col: str = "text", around: int = 20) -> DataFrame:
    """(by, keys, id, name, acts): of each text the library's first character whose name has a verb within `around` characters of its first place, else the first that it names at all.

    characters: (by, id, name, aliases), first by id; aliases count for the second only.  A project's names meet a text as one array and only those that it has go on,
    by equality, to the library.  Texts that name nobody have no row.
    """
    own = characters.select(*by, "id", "name", F.col("name").alias("_key"), F.lit(True).alias("_own"))
    known = own.unionByName(characters.select(*by, "id", "name", F.explode("aliases").alias("_key"), F.lit(False).alias("_own"))).where(F.length("_key") > 0)
    library = known.groupBy(*by).agg(F.collect_set("_key").alias("_keys"))
    hits = name_hits(F.col(text_col), F.col("_keys"), before=around, after=around, found_only=True)
    found = texts.select(*by, *keys, text_col).join(library, by).select(*by, *keys, F.explode(hits).alias("h")).select(*by, *keys, F.col("h.name").alias("_key"), F.col("h.windows")[0].alias("_window"))
    acts = F.col("_own") & F.col("_window").rlike(quote_pattern(verbs))
    best = found.join(known, [*by, "_key"]).groupBy(*by, *keys).agg(F.min(F.struct((~acts).alias("rest"), "id", "name")).alias("b"))
    return best.select(*by, *keys, "b.id", "b.name", (~F.col("b.rest")).alias("acts"))


def verb_places(docs: DataFrame, verbs: tuple[str, ...], id_cols: list[str], text_col: str = "text") -> DataFrame:
    """(ids, verb, start) of every place of every verb, each verb for itself without overlap."""
    words = F.split(F.lit("\x1f".join(verbs)), "\x1f")
    hits = docs.select(*id_cols, F.explode(name_hits(F.col(text_col), words, found_only=True)).alias("h"))
    return hits.select(*id_cols, F.col("h.name").alias("verb"), F.explode("h.starts").alias("start"))


def nearest_names(docs: DataFrame, names: DataFrame, verbs: tuple[str, ...], id_cols: list[str], text_col: str = "text", reach: int = 20) -> DataFrame:
    """(ids, verb, start, name, gap): the last name that ends at most `reach` characters before each verb's place, the longest of those that end there.

    An as-of join in one window over a text's names and verbs in order of place; verbs without such a name have nulls.
    """
    per_text = names.groupBy(*id_cols).agg(F.collect_set("name").alias("_names"))
    hits = docs.select(*id_cols, text_col).join(per_text, id_cols).select(*id_cols, F.explode(name_hits(F.col(text_col), F.col("_names"), found_only=True)).alias("h"))
    ends = hits.select(*id_cols, F.lit(None).cast("string").alias("verb"), F.explode(F.transform("h.starts", lambda s: s + F.length("h.name"))).alias("start"), F.col("h.name").alias("name"))
    events = verb_places(docs, verbs, id_cols, text_col).withColumn("name", F.lit(None).cast("string")).unionByName(ends)
    order = Window.partitionBy(*id_cols).orderBy("start", F.col("verb").isNotNull(), F.length("name"), "name").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    last = F.last(F.when(F.col("name").isNotNull(), F.struct(F.col("start").alias("end"), F.col("name"))), ignorenulls=True).over(order)
    rows = events.withColumn("_last", last).where("verb is not null").withColumn("gap", F.col("start") - F.col("_last.end"))
    near = F.col("gap") <= reach
    return rows.select(*id_cols, "verb", "start", F.when(near, F.col("_last.name")).alias("name"), F.when(near, F.col("gap")).alias("gap"))
