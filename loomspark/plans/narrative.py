"""The whole analysis of texts: chapters, sentences, quotes, speakers, emotions, and its exports."""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomspark.operators import characters as lib
from loomspark.functions.dictionary import names_in
from loomspark.functions.text import quote_pattern
from loomspark.operators import emotion, entities, quotes, segment, speakers, turns
from loomspark.operators import tagged as tagged_rules
from loomspark.packs import Pack
from loomspark.sources.tables import cut
from loomspark.sources.texts import guarded

@dataclass
class Analysis:
    chapters: DataFrame
    quotes: DataFrame
    names: DataFrame
    sentences: DataFrame
    statistics: DataFrame
    errors: DataFrame


def quote_turns(context: DataFrame, options: DataFrame, characters: DataFrame, pack: Pack, keys: list[str], words: turns.TurnWords) -> DataFrame:
    """The quotes with what the ordered fold takes: their surroundings, options, a name or pronoun as hint, and the library's names nearby.

    Options are the library's name that opens the narration a quote stands in (its line up to it: 0.9 where that ends with a colon or a speech verb, else 0.8;
    else the clause after it: 0.85), then the ranked candidates.  A candidate that begins with a library name means that name.
    Whom the quote itself calls or names as an owner doesn't speak it.
    """
    ranked = options.groupBy(*keys, "quote_index").agg(F.sort_array(F.collect_list(F.struct("rank", "name", "confidence"))).alias("_ranked"))
    library = characters.groupBy("project").agg(F.collect_set("name").alias("_library"))
    none = F.array().cast("array<string>")
    rows = context.join(library, "project", "left").join(ranked, [*keys, "quote_index"], "left").withColumn("_library", F.coalesce("_library", none))
    line, tail = F.regexp_extract("prefix", r"[^\n]*$", 0), F.regexp_extract("suffix", r"^[^\n，。！？,.!?]*", 0)
    nearby = F.concat_ws(" ", "prefix", "suffix")
    rows = rows.withColumns({"_line": line, "_clause": tail}).withColumn("_in", names_in(F.array("_line", "_clause", nearby), F.col("_library")))

    def first(text: str, i: int) -> Column:
        """The name that a text has first, the longest of those at that place."""
        placed = F.transform(F.col("_in")[i], lambda n: F.struct(F.position(n, F.col(text)).alias("at"), (-F.length(n)).alias("size"), n.alias("name")))
        return F.array_min(placed)["name"]

    def known(name: Column) -> Column:
        """The longest library name that a candidate begins with, else the candidate."""
        starts = F.transform(F.filter("_library", lambda n: F.startswith(name, n)), lambda n: F.struct(F.length(n).alias("size"), n.alias("name")))
        return F.coalesce(F.array_max(starts)["name"], name)

    option = lambda name, sure: F.when(name.isNotNull(), F.struct(name.alias("name"), sure.cast("double").alias("confidence")))
    tells = F.col("_line").rlike(f"(?:[:：]|{quote_pattern(pack.speech_verbs)})[，,]?\\s*$")
    own = F.array_compact(F.array(option(first("_line", 0), F.when(tells, 0.9).otherwise(0.8)), option(first("_clause", 1), F.lit(0.85))))
    others = F.transform(F.coalesce("_ranked", F.array().cast("array<struct<rank:int,name:string,confidence:double>>")), lambda o: F.struct(known(o["name"]).alias("name"), o["confidence"].cast("double").alias("confidence")))
    called = F.filter("_library", lambda n: F.contains("quote", F.concat(n, F.lit(words.possessive))) | reduce(or_, (F.startswith("quote", F.concat(n, F.lit(p))) for p in words.pauses)))
    spoken_by = F.filter(F.concat(own, others), lambda o: ~F.array_contains("_called", o["name"]))
    pronoun = F.regexp_extract("prefix", f"({quote_pattern(pack.pronouns)})[^。！？.!?]*$", 1)
    rows = rows.withColumn("_called", called)
    hint = F.coalesce(known(speakers.speaker_hint(F.col("prefix"), pack)), F.when(pronoun != "", pronoun))
    return rows.select("project", *keys, "quote_index", F.concat_ws(" ", "prefix", "quote", "suffix").alias("text"), F.col("prefix").alias("before"), hint.alias("hint"), spoken_by.alias("options"), F.array_except(F.col("_in")[2], "_called").alias("mentioned"))


def analyze(docs: DataFrame, characters: DataFrame, pack: Pack, id_col: str = "doc_id", text_col: str = "text", tagged: DataFrame | None = None, tokens: DataFrame | None = None, rules: tagged_rules.TagRules | None = None, words: turns.TurnWords | None = None, around: int = 0) -> Analysis:
    """Analyses every text (id, text); characters is the library with project = id.

    A text that can't be analysed (null, blank, or too long) has a row in `errors`.  tagged: entities (id, name) that a
    tagger found, to be validated and linked beside those found here; tokens: its tagged sentences (id, sentence_index, text, tokens, tags, and base if it gives entities),
    completed by rules first.  State is kept per chapter, and the library is a snapshot: what a run discovers is in `names`, for the next one.
    A quote whose surest candidate isn't in the library has no speaker.  around: so many characters before and after a sentence count for its emotion
    too (20 suit narration; a guide phrase of the sentence before then speaks for this one as well).
    """
    judged_texts = guarded(docs.select(id_col, F.col(text_col).alias("text")))
    errors = judged_texts.where(F.col("error").isNotNull()).select(id_col, "error")
    fit = judged_texts.where(F.col("error").isNull()).select(id_col, F.col("text").alias(text_col))
    chapters = segment.split_chapters(fit, pack, id_col, text_col)
    chapters = cut(chapters)
    keys = [id_col, "volume_index", "chapter_index"]
    parts = chapters.select(*keys, F.col("content").alias("text"))
    found = quotes.extract_dialogue(parts, pack, keys)
    judged = quotes.boundary_verdict(quotes.extract_all_quotes(parts, keys), pack)
    spoken = cut(quotes.remove_spans(found, judged.where(~F.col("is_dialogue")), keys))
    near = entities.role_names(parts, spoken, pack, keys).select(id_col, "name")
    every = (near.unionByName(tagged.select(id_col, "name")) if tagged is not None else near).withColumn("confidence", F.lit(0.6))
    if tokens is not None and rules is not None:
        every = every.unionByName(tagged_rules.tagged_names(tokens, [id_col], rules).where("type = 'PER'").select(id_col, "name", "confidence"))
    every = every.groupBy(id_col, "name").agg(F.max("confidence").alias("confidence"))
    checked = cut(entities.validate_and_discover(fit.withColumnRenamed(text_col, "text"), every, pack, [id_col], tokens=tokens))
    linked = lib.link_entities(checked.select(F.col(id_col).alias("project"), F.col("name").alias("text"), F.lit("PER").alias("type"), F.col("new_confidence").alias("confidence")), characters)
    context = speakers.quote_contexts(parts, spoken, keys).withColumn("project", F.col(id_col))
    options = speakers.rank_candidates(speakers.context_candidates(context, characters, pack, keys), [*keys, "quote_index"], pack.pronouns)
    words = words or turns.TurnWords()
    resolved = turns.resolve_turns(quote_turns(context, options, characters, pack, keys, words), characters, ["project", *keys], "quote_index", words, by=["project"]).drop("project")
    told = cut(spoken.join(resolved, [*keys, "quote_index"], "left"))
    each = segment.sentences(parts, pack, keys, around=around)
    marked = quotes.mark_dialogue(each, told, keys).withColumn("fragments", segment.fragments(F.col("sentence"), pack))
    scored = cut(emotion.classify_in_order(marked, pack, keys, "sentence_index", "window" if around else "sentence").drop("window"))
    scenes = spoken.join(told.select(*keys, "quote_index", F.col("speaker").alias("_s")), [*keys, "quote_index"]).where("_s is not null").groupBy(F.col(id_col), F.col("_s").alias("name")).agg(F.count_distinct("volume_index", "chapter_index").alias("scenes"))
    found_names = linked.select(F.col("project").alias(id_col), F.col("text").alias("name"), "type", "confidence", "standard_name", "is_linked").join(checked.select(id_col, "name", "n"), [id_col, "name"]).join(scenes, [id_col, "name"], "left")
    names = cut(entities.speaker_roles(found_names.withColumn("scenes", F.coalesce("scenes", F.lit(0))), scenes, [id_col]))
    confirmed = names.where("confidence >= 0.5 or is_linked").select(id_col, F.coalesce("standard_name", "name").alias("name")).distinct()
    silent = scored.where(~F.col("is_dialogue"))
    filled = speakers.backfill_unknown(scored.where("is_dialogue"), confirmed, [id_col]).unionByName(silent)
    whole = segment.with_entities(filled, names, [id_col])
    stats = whole.groupBy(*keys).agg(F.count(F.lit(1)).alias("n_sentences"), F.count_if("is_dialogue").alias("n_dialogue"), F.count_if(~F.col("is_dialogue")).alias("n_narration"), F.sum(F.size("entities")).alias("n_entities"))
    return Analysis(chapters, told, names, whole, stats, errors)
