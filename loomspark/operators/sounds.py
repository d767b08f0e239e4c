"""Onomatopoeia."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomspark.functions.text import SPAN, let, matches, quote_pattern, running
from loomspark.packs import Pack


def sound_type(word: Column, pack: Pack) -> Column:
    """The first type whose list has the word."""
    return F.coalesce(*(F.when(word.isin(*words), F.lit(kind)) for kind, words in pack.sounds), F.lit("other"))


def longest_at_starts(text: Column, words: list[str]) -> Column:
    """The longest word at every start; spans may overlap.  A lookahead finds each start in one scan."""
    pattern = f"(?=({quote_pattern(words)}))"
    hits = F.regexp_extract_all(text, F.lit(pattern), F.lit(1))
    gaps = F.split(text, f"(?={quote_pattern(words)})", -1)
    # A zero-width split cuts before every start, so the starts are the running lengths of the pieces.
    leading = text.rlike(f"^(?:{quote_pattern(words)})")
    ends = let(gaps, lambda g: running(F.transform(F.slice(g, F.lit(1), F.size(g) - 1), F.length)))
    starts = F.when(leading, F.array_distinct(F.concat(F.array(F.lit(0)), ends))).otherwise(ends)
    spans = F.zip_with(starts, hits, lambda s, h: F.struct(s.alias("start"), (s + F.length(h)).alias("end"), h.alias("text")))
    return F.when(text.isNull() | (F.size(hits) == 0), F.array().cast(SPAN)).otherwise(spans)


def without_contained(spans: Column) -> Column:
    """Drops spans that lie in another one."""
    return F.filter(spans, lambda x: ~F.exists(spans, lambda k: (k["start"] <= x["start"]) & (k["end"] >= x["end"]) & ((k["end"] - k["start"]) > (x["end"] - x["start"]))))


def detect_sounds(docs: DataFrame, pack: Pack, id_cols: list[str], text_col: str = "text", extra: tuple[str, ...] = (), removed: tuple[str, ...] = (), repeats: str | None = None) -> DataFrame:
    """(ids, word, start, end, type): lexicon words, then runs of sound characters where no word is; contained spans dropped."""
    words = [w for w in dict.fromkeys([*(w for _, ws in pack.sounds for w in ws), *extra]) if w not in removed]
    found = longest_at_starts(F.col(text_col), words)
    if repeats:
        more = F.filter(matches(F.col(text_col), repeats), lambda x: ~F.exists(found, lambda k: (k["start"] < x["end"]) & (x["start"] < k["end"])))
        found = F.concat(found, more)
    rows = docs.select(*id_cols, F.explode(without_contained(found)).alias("s"))
    return rows.select(*id_cols, F.col("s.text").alias("word"), F.col("s.start").alias("start"), F.col("s.end").alias("end"), sound_type(F.col("s.text"), pack).alias("type"))
