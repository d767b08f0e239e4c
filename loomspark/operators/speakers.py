"""Who speaks a quote: candidates from several sources, ranking, and the ordered state of a chapter."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loomspark.functions.text import after, before, last_index, quote_pattern
from loomspark.operators.characters import lookup_names
from loomspark.operators.entities import cleaned_hint
from loomspark.packs import Pack

DECAY = 0.05
CONFIDENCE = {"hint": 0.88, "after": 0.82, "title": 0.80, "pronoun": 0.80, "context": 0.75, "library": 0.60}


def quote_contexts(docs: DataFrame, quotes: DataFrame, id_cols: list[str], text_col: str = "text") -> DataFrame:
    """Adds prefix (from the quote before) and suffix (to the quote after)."""
    w = Window.partitionBy(*id_cols).orderBy("start")
    rows = quotes.join(docs.select(*id_cols, F.col(text_col).alias("_t")), id_cols)
    rows = rows.withColumn("_from", F.coalesce(F.lag("end").over(w), F.lit(0))).withColumn("_to", F.coalesce(F.lead("start").over(w), F.length("_t")))
    return rows.withColumn("prefix", F.expr("substring(_t, _from + 1, start - _from)")).withColumn("suffix", F.expr("substring(_t, end + 1, _to - end)")).drop("_t", "_from", "_to")


def speaker_hint(text: Column, pack: Pack) -> Column:
    """The last name that a speech pattern gives, by tiers; cleaned; null if none."""
    tiers = [F.try_element_at(F.regexp_extract_all(text, F.lit(p), F.lit(1)), F.lit(-1)) for p in pack.hint_patterns]
    name = cleaned_hint(F.coalesce(*tiers, F.lit("")), pack)
    return F.when((F.length(name) >= 2) & ~name.isin(*pack.speech_verbs, *pack.pronouns), name)


def proximity_bonus(distance: Column) -> Column:
    return F.greatest(F.lit(0.10) - 0.005 * distance, F.lit(0.0))


def context_candidates(quotes: DataFrame, characters: DataFrame, pack: Pack, id_cols: list[str], project: str = "project", window: int = 120) -> DataFrame:
    """All candidates (ids, quote_index, name, confidence, source, source_rank) of quotes with prefix and suffix.

    Library names meet the prefix by their first character, so the contains test runs on few pairs.
    """
    keys = [*id_cols, "quote_index"]
    q = quotes.withColumn("_tail", F.substring("prefix", -window, window))
    one = lambda name, source, rank, sure: q.select(*keys, name.alias("name"), F.lit(sure).alias("confidence"), F.lit(source).alias("source"), F.lit(rank).alias("source_rank"))
    hint = one(speaker_hint(F.col("prefix"), pack), "hint", 1, CONFIDENCE["hint"])
    post = one(speaker_hint(F.substring(F.regexp_extract("suffix", r"^[^\n]*", 0), 1, 50), pack), "after", 2, CONFIDENCE["after"])
    role = one(F.try_element_at(F.regexp_extract_all("_tail", F.lit(quote_pattern(pack.role_words)), F.lit(0)), F.lit(-1)), "title", 3, CONFIDENCE["title"])
    chars = q.select(*keys, *([project] if project in q.columns and project not in keys else []), "_tail", F.explode(F.array_distinct(F.filter(F.split("_tail", ""), lambda c: c != ""))).alias("_c"))
    names = lookup_names(characters).withColumn("_c", F.substring("key", 1, 1))
    on = ["_c", project] if project in chars.columns else ["_c"]
    met = chars.join(names if project in chars.columns else names.drop("project"), on).where(F.contains("_tail", "key"))
    gap = F.length("_tail") - last_index(F.col("_tail"), F.col("key")) - F.length("key")
    library = met.groupBy(*keys, "name").agg(F.min(gap).alias("gap")).select(*keys, "name", F.least(F.lit(CONFIDENCE["context"]) + proximity_bonus(F.col("gap")), F.lit(0.9)).alias("confidence"), F.lit("context").alias("source"), F.lit(4).alias("source_rank"))
    return hint.unionByName(post).unionByName(role).unionByName(library).where(F.col("name").isNotNull() & (F.col("name") != ""))


def rank_candidates(candidates: DataFrame, keys: list[str], exclude: tuple[str, ...] = ()) -> DataFrame:
    """Of each name the first source stays; then by confidence, ties by source; adds rank."""
    first = candidates.where(~F.col("name").isin(*exclude)) if exclude else candidates
    first = first.groupBy(*keys, "name").agg(F.min_by(F.struct("confidence", "source", "source_rank"), "source_rank").alias("c")).select(*keys, "name", "c.*")
    order = [F.desc("confidence"), F.asc("source_rank"), F.asc("name")]
    return first.withColumn("rank", F.row_number().over(Window.partitionBy(*keys).orderBy(*order)))


def select_speaker(ranked: DataFrame, characters: DataFrame, keys: list[str]) -> DataFrame:
    """The top candidate looked up in the library; if it isn't there, there is no speaker."""
    known = lookup_names(characters).groupBy("key").agg(F.min(F.struct("priority", "id", "name")).alias("b"))
    top = ranked.where("rank = 1")
    return top.join(known, top["name"] == known["key"], "left").select(*keys, F.col("b.name").alias("speaker"), F.when(F.col("b").isNotNull(), F.col("confidence")).otherwise(0.0).alias("confidence"))


def activity_weights(mentions: DataFrame, keys: list[str], who: str, time: str) -> DataFrame:
    """Each speaker's activity at the group's last time: the fold w*exp(-d*gap)+1 is the sum of exp(-d*(last-t))."""
    last = Window.partitionBy(*keys)
    return mentions.withColumn("_last", F.max(time).over(last)).groupBy(*keys, who).agg(F.sum(F.exp(-DECAY * (F.col("_last") - F.col(time)))).alias("activity"))


def activity_weights_by_join(mentions: DataFrame, keys: list[str], who: str, time: str) -> DataFrame:
    """As activity_weights, for groups that may hold much of the table: maxima are aggregated first, no window gathers a group."""
    last = mentions.groupBy(*keys).agg(F.max(time).alias("_last"))
    per = mentions.groupBy(*keys, who, time).agg(F.count(F.lit(1)).alias("_n"))
    return per.join(last, keys).groupBy(*keys, who).agg(F.sum(F.col("_n") * F.exp(-DECAY * (F.col("_last") - F.col(time)))).alias("activity"))


def first_seen_ranks(turns: DataFrame, keys: list[str], who: str, time: str) -> DataFrame:
    """Speakers by first appearance (a repeat doesn't move one to the end)."""
    first = turns.groupBy(*keys, who).agg(F.min(time).alias("first_time"))
    return first.withColumn("rank", F.row_number().over(Window.partitionBy(*keys).orderBy("first_time", who)))


def last_mentions(turns: DataFrame, keys: list[str], order: str, text: str, n: int = 3) -> DataFrame:
    """Each row with the n texts up to it, joined."""
    w = Window.partitionBy(*keys).orderBy(order).rowsBetween(-(n - 1), 0)
    return turns.withColumn("recent", F.array_join(F.collect_list(text).over(w), ","))


def instability(turns: DataFrame, keys: list[str], order: str, who: str, last: int = 6, at: int = 2) -> DataFrame:
    """Adds changes (of speaker among the last rows) and unstable."""
    w = Window.partitionBy(*keys).orderBy(order)
    change = F.coalesce((F.lag(who).over(w) != F.col(who)).cast("int"), F.lit(0))
    rows = turns.withColumn("_change", change).withColumn("changes", F.sum("_change").over(w.rowsBetween(-(last - 2), 0)))
    return rows.withColumn("unstable", F.col("changes") >= at).drop("_change")


def backfill_unknown(sentences: DataFrame, names: DataFrame, by: list[str]) -> DataFrame:
    """Sentences without a speaker get the longest confirmed name they contain."""
    blank = F.coalesce(F.col("speaker"), F.lit("")).rlike("^$|^未知")
    key = [*by, "sentence"]  # what a sentence says decides, so equal ones are looked at once
    chars = sentences.where(blank).select(*key).distinct().withColumn("_c", F.explode(F.array_distinct(F.split("sentence", ""))))
    hits = chars.join(names.select(*by, "name", F.substring("name", 1, 1).alias("_c")), [*by, "_c"]).where(F.contains("sentence", "name"))
    best = hits.groupBy(*key).agg(F.max_by("name", F.struct(F.length("name"), F.col("name"))).alias("_best"))
    return sentences.join(best, key, "left").withColumn("speaker", F.when(blank, F.coalesce("_best", "speaker")).otherwise(F.col("speaker"))).select(sentences.columns)


def semantic_confidence(similarity: Column) -> Column:
    return F.greatest(F.lit(0.6), F.least(F.lit(0.8), F.lit(0.6) + (similarity - 0.7) * 0.5))


def hybrid_choice(ranked: DataFrame, keys: list[str], library: float = 0.55, threshold: float = 0.7) -> DataFrame:
    """The rule's top candidate; library matches count library at most; needs_model marks those below the threshold."""
    top = ranked.where("rank = 1").withColumn("confidence", F.when(F.col("source") == "library", F.least("confidence", F.lit(library))).otherwise(F.col("confidence")))
    return top.select(*keys, "name", "confidence", (F.col("confidence") < threshold).alias("needs_model"))


def model_prompt(quote: Column, prefix: Column, suffix: Column, options: Column, most: int = 60) -> Column:
    """A multiple-choice question for a pluggable model."""
    listed = F.array_join(F.transform(F.slice(options, 1, 6), lambda o, i: F.concat((i + 1).cast("string"), F.lit(". "), o)), "\n")
    return F.concat(before(prefix, F.length(prefix), most), F.lit("「"), quote, F.lit("」"), after(suffix, F.lit(0), most), F.lit("\n"), listed)


def parse_choice(response: Column, options: Column) -> Column:
    """The option whose number a model's answer starts with, else the first it contains."""
    n = F.try_to_number(F.nullif(F.regexp_extract(response, r"^\s*(\d{1,3})", 1), F.lit("")), F.lit("999")).cast("int")
    return F.coalesce(F.when(n > 0, F.try_element_at(options, n)), F.try_element_at(F.filter(options, lambda o: F.contains(response, o)), F.lit(1)))



def pronoun_confidence(index: Column, n: Column, activity: Column, subject: Column, objective: Column) -> Column:
    """Confidence of a recent name for a pronoun: nearness, activity, and whether it was subject or object."""
    score = F.lit(1.0) - index / n + F.least(activity * 0.05, F.lit(0.2)) + F.when(subject, 0.15).otherwise(0.0) - F.when(objective, 0.10).otherwise(0.0)
    return F.least(F.lit(0.85) + score * 0.1, F.lit(0.95))


def address_confidence(activity: Column, mentioned: Column) -> Column:
    """Confidence of someone other than the addressee of a form of address: 0.4 to 0.6 by activity."""
    base = F.when(mentioned, F.lit(0.5) + activity * 0.03).otherwise(F.lit(0.6) + activity * 0.05)
    return F.greatest(F.lit(0.4), F.least(base, F.lit(0.6)))


def self_introduction(text: Column) -> Column:
    """The name in 我是X or 我叫X, else null."""
    name = F.regexp_extract(text, "我(?:是|叫)([一-龥]{2,4}?)(?:[，。！？\\s]|$)", 1)
    return F.when(name != "", name)


def action_boost(confidence: Column, name: Column, narration: Column, actions: tuple[str, ...]) -> Column:
    """0.10 more, 0.95 at most, for a name that acts in the narration."""
    acts = F.regexp_like(narration, F.concat(F.lit("\\Q"), name, F.lit(f"\\E[^，。]{{0,3}}(?:{quote_pattern(actions)})")))
    return F.when(acts, F.least(confidence + 0.10, F.lit(0.95))).otherwise(confidence)


def pronoun_placeholders(text: Column, genders: dict[str, str], labels: dict[str, str]) -> Column:
    """A placeholder (name, confidence) for every pronoun in a text: 0.5 where its gender is known, else 0.3."""
    one = lambda p, g: F.when(F.contains(text, F.lit(p)), F.struct(F.lit(f"{labels.get(g, labels['unknown'])}:{p}").alias("name"), F.lit(0.5 if g in ("male", "female") else 0.3).alias("confidence")))
    return F.array_compact(F.array(*(one(p, g) for p, g in genders.items())))


def action_trigger(text: Column, name: Column, actions: tuple[str, ...], around: int = 20) -> Column:
    """Whether an action word is within `around` characters of a name's first place: the previous speaker acts again (0.65)."""
    at = F.position(name, text)
    near = F.substring(text, F.greatest(at - around, F.lit(1)), F.least(at - 1, F.lit(around)) + F.length(name) + around)
    return F.when((at > 0) & near.rlike(quote_pattern(actions)), F.lit(0.65))


def address_trigger(turns: DataFrame, characters: DataFrame, keys: list[str], order: str, words: tuple[str, ...], recent: int = 3) -> DataFrame:
    """Turns in which someone is addressed and one other speaker alone is recent: (keys, order, addressed, speaker, confidence).

    turns: (keys, order, text, speaker).  A character is addressed by a word that is an alias of theirs or ends their name.
    """
    w = Window.partitionBy(*keys).orderBy(order).rowsBetween(-recent, -1)
    rows = turns.withColumn("_recent", F.collect_list("speaker").over(w)).select(*keys, order, "text", "_recent")
    said = rows.withColumn("_word", F.explode(F.filter(F.array(*(F.lit(x) for x in words)), lambda x: F.contains(F.col("text"), x))))
    called = characters.select(F.col("name").alias("addressed"), "aliases", F.explode(F.array(*(F.lit(x) for x in words))).alias("_word")).where(F.array_contains("aliases", F.col("_word")) | F.endswith(F.col("addressed"), F.col("_word")))
    others = F.array_distinct(F.filter("_recent", lambda s: s != F.col("addressed")))
    hits = said.join(called.drop("aliases").distinct(), "_word").withColumn("_others", others).where(F.size("_others") == 1)
    return hits.select(*keys, order, "addressed", F.col("_others")[0].alias("speaker"), F.lit(0.7).alias("confidence")).distinct()
