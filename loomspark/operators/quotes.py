"""Quoted spans and whether they are speech."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomspark.functions.text import SPAN, after, apart, before, clamp, keep_earliest, last_index, matches, quote_pattern, strip
from loomspark.packs import Pack

ANCHOR, NEAR = 50, 10


def _inner(m: Column) -> Column:
    return F.struct(m["start"].alias("start"), m["end"].alias("end"), F.substring(m["text"], F.lit(2), F.length(m["text"]) - 2).alias("text"))


def extract_dialogue(docs: DataFrame, pack: Pack, id_cols: list[str], text_col: str = "text") -> DataFrame:
    """Quotes of the dialogue pairs: a pair's hits give way to overlapping hits of earlier pairs; sorted by place."""
    spans = F.array().cast(SPAN)
    for o, c in pack.dialogue_quotes:
        new = F.transform(matches(F.col(text_col), f"{o}[^{c}]+?{c}"), _inner)
        spans = apart(spans, new)
    rows = docs.select(*id_cols, F.posexplode(spans).alias("quote_index", "q"))
    return rows.select(*id_cols, "quote_index", F.col("q.start").alias("start"), F.col("q.end").alias("end"), F.col("q.text").alias("quote")).where(F.length(strip(F.col("quote"))) > 0)


def extract_all_quotes(docs: DataFrame, id_cols: list[str], text_col: str = "text", pairs: tuple[tuple[str, str], ...] = (("「", "」"), ("『", "』"), ('"', '"'), ("“", "”")), around: int = 50) -> DataFrame:
    """Quotes of all pairs with their surroundings; of overlapping ones the earliest stays."""
    spans = F.concat(*(F.transform(matches(F.col(text_col), f"{o}[^{c}]*{c}"), _inner) for o, c in pairs))
    rows = docs.select(*id_cols, F.col(text_col).alias("_t"), F.posexplode(keep_earliest(F.sort_array(spans))).alias("quote_index", "q"))
    return rows.select(*id_cols, "quote_index", F.col("q.start").alias("start"), F.col("q.end").alias("end"), F.col("q.text").alias("quote"), before(F.col("_t"), F.col("q.start"), around).alias("before"), after(F.col("_t"), F.col("q.end"), around).alias("after"))


def boundary_verdict(quotes: DataFrame, pack: Pack, anchor: int = ANCHOR, strategies: tuple[bool, bool, bool] = (True, True, True)) -> DataFrame:
    """Adds is_dialogue and confidence from three strategies: a speech verb nearby, the quote's own form, citation marks."""
    t, lead, trail = strip(F.col("quote")), F.col("_lead"), F.col("_trail")
    rows = quotes.withColumn("_lead", F.substring("before", -anchor, anchor)).withColumn("_trail", F.substring("after", 1, anchor))
    by_length = sorted(pack.speech_verbs, key=len, reverse=True)
    # The longest verb in front, at its last place.
    first = F.coalesce(*(F.when(F.contains(lead, F.lit(v)), F.struct(F.lit(len(v)).alias("n"), last_index(lead, F.lit(v)).alias("at"))) for v in by_length))
    gap = F.substring(lead, first["at"] + first["n"] + 1, F.length(lead))
    front = F.when(first.isNull() | (F.length(gap) > NEAR), 0.0).when(gap.rlike(r"[：:，,]\s*$") | (strip(gap) == ""), 1.0).otherwise(0.7)
    places = F.filter(F.array(*(F.locate(v, trail) - 1 for v in by_length)), lambda x: x >= 0)
    near = F.array_min(places)
    lag = F.substring(trail, F.lit(1), near)
    back = F.when(near.isNull() | (near > NEAR), 0.0).when(lag.rlike(r"^\s*[，,]"), 0.5).otherwise(0.3)
    s1 = front + back + F.when(first.isNull() & near.isNull(), 0.3).otherwise(0.0)

    ends, modal = t.rlike("[。！？；]"), t.rlike("[啊呀呢吧嘛哦呗哇哈嘿哼嗯]$")
    noun, shout = t.rlike(r"^[一-龥·\-—~～]{1,10}$"), t.rlike("^[一-龥][！!]+$")
    proper = t.rlike(f"(?:{quote_pattern(pack.place_suffixes)})$")
    short = t.rlike("^[一-龥]{1,2}$") & ~ends & ~modal
    doubled = (F.length(t) == 2) & (F.substring(t, 1, 1) == F.substring(t, 2, 1))
    asks = t.rlike("[？?]")
    term = lambda c, w: F.when(c, w).otherwise(0.0)
    s2 = clamp(F.lit(0.5) + term(ends, 0.3) + term(modal, 0.2) + F.when(noun, F.when(proper, -0.4).otherwise(-0.2)).otherwise(0.0) + term(shout, -0.5) + term(short & (doubled | proper), -0.3) + term(asks, 0.2))

    words = quote_pattern(pack.book_words)
    around = F.concat(F.substring("before", -15, 15), F.lit("「"), F.col("quote"), F.lit("」"), F.substring("after", 1, 15))
    cites = around.rlike(f"(?:{words})") | around.rlike("[」\"』]\\s*(?:的)?(?:这句话|这行字|这些字|此句|此诗|此词)\\s*(?:刻|写|留|题|录|记|载)")
    close = F.substring("before", -10, 10).rlike(words)
    speech = F.concat(F.substring("before", -20, 20), F.substring("after", 1, 20)).rlike(quote_pattern(pack.speech_verbs))
    s3 = clamp(F.lit(0.5) + term(cites, -0.6) + term(close, -0.5) + term(F.col("quote").rlike("[\n\r]"), -0.3) + term((F.length("quote") > 100) & ~speech, -0.3))

    on = [s for s, use in zip((s1, s2, s3), strategies, strict=True) if use]
    score = clamp(sum(on[1:], on[0]) / len(on)) if on else F.lit(0.8)
    support = ((front > 0) | ((back > 0) & ~shout)) & F.lit(strategies[0]) | ((ends & ~shout) | modal | asks) & F.lit(strategies[1])
    sound, place, pure = shout | (short & (doubled | proper)), (noun & proper) | (short & proper), noun
    empty = t == ""
    verdict = F.when(empty, F.lit(False)).when((sound | place | pure) & F.lit(strategies[1]) & ~support, F.lit(False)).otherwise(F.lit(True))
    sure = F.when(empty, 0.0).when(sound & ~support & F.lit(strategies[1]), 0.2).when((place | pure) & ~support & F.lit(strategies[1]), 0.3).otherwise(F.greatest(score, F.lit(0.5)))
    return rows.withColumn("is_dialogue", verdict).withColumn("confidence", sure).drop("_lead", "_trail")


def remove_spans(dialogue: DataFrame, suppressed: DataFrame, id_cols: list[str]) -> DataFrame:
    """Quotes without those at exactly a suppressed span."""
    return dialogue.join(suppressed.select(*id_cols, "start", "end").distinct(), [*id_cols, "start", "end"], "left_anti")


def quotation_type(before_text: Column, verbs: tuple[tuple[str, tuple[str, ...]], ...]) -> Column:
    """(type, confidence) by the keyword in front with the largest 10 * length - distance; unknown at 0.5."""
    options = []
    for kind, words in verbs:
        for w in words:
            at = last_index(before_text, F.lit(w))
            gap = F.length(before_text) - at - len(w)
            options.append(F.when(at >= 0, F.struct((F.lit(10 * len(w)) - gap).alias("score"), F.lit(kind).alias("type"), F.greatest(F.lit(0.95) - gap / 100, F.lit(0.7)).alias("confidence"))))
    best = F.array_max(F.array_compact(F.array(*options)))
    return F.struct(F.coalesce(best["type"], F.lit("unknown")).alias("type"), F.coalesce(best["confidence"], F.lit(0.5)).alias("confidence"))


def sentence_kind(sentence: Column, markers: str, speech: str, telling: str) -> Column:
    """(is_dialogue, confidence): quote marks, then markers, speech and narration indicators, else narration."""
    kind = lambda yes, sure: F.struct(F.lit(yes).alias("is_dialogue"), F.lit(sure).alias("confidence"))
    return F.when(sentence.rlike('[「『“"][^」』”"]+[」』”"]'), kind(True, 0.95)).when(sentence.rlike(markers), kind(True, 0.85)).when(sentence.rlike(speech), kind(True, 0.8)).when(sentence.rlike(telling), kind(False, 0.75)).otherwise(kind(False, 0.5))


def mark_dialogue(sentences: DataFrame, spoken: DataFrame, id_cols: list[str]) -> DataFrame:
    """Adds is_dialogue and speaker: the first (by quote_index) non-empty quote that the sentence contains.

    spoken: (ids, quote_index, quote, speaker).  Quotes join within their ids only, so the test runs on a text's own pairs.
    """
    q = spoken.where(F.length(strip(F.col("quote"))) > 0).select(*id_cols, "quote_index", "quote", "speaker")
    hits = sentences.join(q, id_cols).where(F.contains("sentence", "quote")).groupBy(*id_cols, "sentence_index").agg(F.min_by("speaker", "quote_index").alias("speaker"))
    out = sentences.drop("speaker").join(hits.withColumn("is_dialogue", F.lit(True)), [*id_cols, "sentence_index"], "left")
    return out.withColumn("is_dialogue", F.coalesce("is_dialogue", F.lit(False))).withColumn("speaker", F.coalesce("speaker", F.lit("")))


def group_speaker(context: Column, pack: Pack) -> Column:
    """GROUP:n for 2 to 10 people named by number, GROUP:CROWD for crowd words, else null."""
    n = F.try_to_number(F.nullif(F.regexp_extract(context, r"(\d+)人", 1), F.lit("")), F.lit("999999")).cast("int")
    return F.when(n.between(2, 10), F.concat(F.lit("GROUP:"), n.cast("string"))).when(context.rlike(quote_pattern(pack.crowd_words)), F.lit("GROUP:CROWD"))


def is_dialogue(texts: DataFrame, pack: Pack, text_col: str, quote_col: str) -> DataFrame:
    """Adds is_dialogue for one given quote of each text; True where the text doesn't have it in any quote marks."""
    rows = texts.withColumn("_row", F.sha2(F.to_json(F.struct(text_col, quote_col)), 256))  # equal rows have one verdict
    given = rows.select("_row", text_col, quote_col).dropDuplicates(["_row"])
    found = boundary_verdict(extract_all_quotes(given, ["_row"], text_col).join(given.select("_row", F.col(quote_col).alias("_wanted")), "_row").where(F.col("quote") == F.col("_wanted")), pack)
    first = found.groupBy("_row").agg(F.min_by("is_dialogue", "start").alias("is_dialogue"))
    return rows.join(first, "_row", "left").withColumn("is_dialogue", F.coalesce("is_dialogue", F.lit(True))).drop("_row")


def speech_contexts(docs: DataFrame, pack: Pack, id_cols: list[str], text_col: str = "text", around: int = 15) -> DataFrame:
    """Short texts that may name a speaker: the characters before each quote, and those after it up to a speech verb."""
    quotes_ = extract_all_quotes(docs, id_cols, text_col, around=around)
    tail = F.regexp_extract("after", f"^([^，。！？,.!?]{{0,6}}(?:{quote_pattern(pack.speech_verbs)}))", 1)
    each = F.array(F.struct(F.lit("before").alias("kind"), F.col("before").alias("context")), F.struct(F.lit("after").alias("kind"), tail.alias("context")))
    return quotes_.select(*id_cols, "quote_index", F.explode(each).alias("c")).select(*id_cols, "quote_index", "c.*").where(F.col("context") != "")


def classify_quotes(docs: DataFrame, id_cols: list[str], verbs: tuple[tuple[str, tuple[str, ...]], ...], text_col: str = "text", marks: str = '["“”]', around: int = 50) -> DataFrame:
    """Every outermost quote of a text with its type and confidence.  A mark closes the nearest one before it, so none is nested."""
    rows = docs.select(*id_cols, F.col(text_col).alias("_t"), F.posexplode(matches(F.col(text_col), f"{marks}[^\\n]*?{marks}")).alias("quote_index", "q"))
    kind = quotation_type(before(F.col("_t"), F.col("q.start"), around), verbs)
    return rows.select(*id_cols, "quote_index", F.col("q.start").alias("start"), F.col("q.end").alias("end"), _inner(F.col("q"))["text"].alias("quote"), kind["type"].alias("type"), kind["confidence"].alias("confidence"))
