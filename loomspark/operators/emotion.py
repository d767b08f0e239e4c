"""Emotion scores of sentences as columns, and carry-over along a text."""

from __future__ import annotations

import re
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomspark.functions.text import clamp, let, ngrams, scan, strip
from loomspark.packs import EmotionRules, Pack, Term

#: Ties go to the first.
ORDER = ("joy", "anger", "sadness", "surprise", "fear", "neutral")
CARRIED = ("sadness", "fear", "anger", "joy", "surprise")
LEXICON = 500
LOW, HINT_AT, HINT, UNKNOWN_AT, UNKNOWN_LENGTH = 0.25, 0.3, 0.4, 0.15, 5


def features(text: Column, rules: EmotionRules) -> dict[str, Column]:
    """Counts and flags of a sentence."""
    parts = F.filter(F.transform(F.split(text, "[。！？；.!?;]" if rules.full_stop == "." else "[。！？；]"), strip), lambda s: F.length(s) > 0)
    either = lambda patterns: reduce(lambda a, b: a | b, (text.rlike(p) for p in patterns))
    exclaims = F.regexp_count(text, F.lit("[！!]"))
    return {
        "exclaims": exclaims,
        "questions": F.regexp_count(text, F.lit("[？?]")),
        "ellipses": F.regexp_count(text, F.lit(r"\.{3,}|…+")),
        "density": exclaims * 10 / F.greatest(F.lit(1), F.length(text)),
        "mean_length": F.when(F.size(parts) > 0, F.aggregate(parts, F.lit(0), lambda a, s: a + F.length(s)) / F.size(parts)).otherwise(0.0),
        "short": F.size(F.filter(parts, lambda s: F.length(s) <= 4)) >= 2,
        "dirty": text.rlike(rules.dirty),
        "adverb": text.rlike(rules.adverb),
        "verb": text.rlike(rules.verb),
        "particle": text.rlike(rules.particle),
        "imperative": either(rules.imperative),
        "rhetorical": either(rules.rhetorical),
        "exclamatory": either(rules.exclamatory),
        "repeats": text.rlike(r"(.)\1{2,}"),
    }


def feature_vector(f: dict[str, Column]) -> Column:
    """The features as one numeric array, for classifiers."""
    return F.array(*(f[k].cast("double") for k in ("exclaims", "questions", "ellipses", "density", "mean_length", "short", "dirty", "adverb", "verb", "particle", "imperative", "rhetorical", "exclamatory", "repeats")))


def _flags(f: dict[str, Column], text: Column) -> dict[str, Column]:
    return f | {"dense": f["density"] > 0.3, "doubt": (f["ellipses"] >= 1) | (f["questions"] >= 1), "parting": text.rlike("离开|对不起|难过"), "no_anger": text.rlike("过来|伤害"), "cold_laugh": text.rlike("冷笑|嘲笑")}


def _condition(term: Term, f: dict[str, Column], text: Column) -> Column:
    tests = [text.rlike(term.pattern)] if term.pattern else []
    for flag in term.flags:
        if m := re.fullmatch(r"(\w+)>=(\d+)", flag):
            tests.append(f[m[1]] >= int(m[2]))
        else:
            tests.append(~f[flag[1:]] if flag[0] == "!" else f[flag])
    return reduce(lambda a, b: a & b, tests)


def _sum(terms: tuple[Term, ...], emotion: str, f: dict[str, Column], text: Column) -> Column:
    out = F.lit(0.0)
    for term in terms:
        if term.emotion == emotion:
            out = out + F.when(_condition(term, f, text), term.weight).otherwise(0.0)
    return out


def guide_phrase(text: Column, rules: EmotionRules) -> Column:
    """The last verb phrase in the ten characters before the first straight quote; empty if none."""
    at = F.locate('"', text)
    lead = F.substring(text, F.greatest(at - 10, F.lit(1)), F.least(at - 1, F.lit(10)))
    return F.when(at > 0, F.coalesce(F.try_element_at(F.regexp_extract_all(lead, F.lit(rules.guide), F.lit(0)), F.lit(-1)), F.lit(""))).otherwise("")


def with_scores(df: DataFrame, text: Column, rules: EmotionRules) -> DataFrame:
    """Adds `_t` (the text, never null) and the six scores before carry-over as `_s_joy` and so on.

    Order: terms, halving by negation, denials, late terms, neutral, guide phrase.  Features are columns of their own first, so that
    each expression runs once for a sentence however many scores use it.
    """
    t = F.col("_t")
    rows = df.withColumn("_t", F.coalesce(text, F.lit("")))
    f = _flags(features(t, rules), t)
    rows = rows.withColumns({f"_f_{k}": v for k, v in f.items()} | {"_halved": F.when(t.rlike(rules.negation), 0.5).otherwise(1.0), "_guide": guide_phrase(t, rules)})
    f = {k: F.col(f"_f_{k}") for k in f}
    hint = F.coalesce(*(F.when(F.col("_guide").rlike(p), i) for i, (p, _, _) in enumerate(rules.guide_terms)), F.lit(-1))
    rows = rows.withColumn("_hint", F.when(F.col("_guide") == "", -1).otherwise(hint))
    scores = {}
    for e in ORDER[:-1]:
        s = _sum(rules.terms, e, f, t) * F.col("_halved")
        for target, pattern in rules.denials:
            if target == e:
                s = s * F.when(t.rlike(pattern), 0.3).otherwise(1.0)
        scores[e] = s + _sum(rules.late, e, f, t)
    calm = F.when(t.endswith(rules.full_stop) & (f["exclaims"] == 0) & (f["questions"] == 0), 0.2).otherwise(0.0)
    calm = calm + F.when(~(f["dirty"] | f["verb"] | f["adverb"] | f["exclamatory"] | f["rhetorical"] | f["imperative"]), 0.2).otherwise(0.0)
    scores["neutral"] = F.least(calm, F.lit(LOW))
    told = {e: [(i, w) for i, (_, emotion, w) in enumerate(rules.guide_terms) if emotion == e] for e in ORDER}
    for e, terms in told.items():
        for i, w in terms:
            scores[e] = scores[e] + F.when(F.col("_hint") == i, w).otherwise(0.0)
    return rows.withColumns({f"_s_{e}": scores[e] for e in ORDER}).drop("_halved", "_guide", "_hint", *(f"_f_{k}" for k in f))


def decide(rows: DataFrame, rules: EmotionRules) -> DataFrame:
    """Adds `_label` and `_score`: clipping, the best of the six, fear before anger where the text says so, unknown."""
    rows = rows.withColumns({f"_r_{e}": F.round(F.least(F.col(f"_s_{e}"), F.lit(1.0)), 10) for e in ORDER})
    r = {e: F.col(f"_r_{e}") for e in ORDER}
    rows = rows.withColumn("_best", F.greatest(*r.values()))
    rows = rows.withColumn("_first", F.coalesce(*(F.when(v == F.col("_best"), F.lit(e)) for e, v in r.items())))
    rows = rows.withColumn("_flee", (F.col("_first") == "anger") & (F.col("_best") >= 0.4) & (r["fear"] > 0.1) & F.col("_t").rlike(rules.fear_signals))
    label = F.when(F.col("_flee"), F.lit("fear")).otherwise(F.col("_first"))
    score = F.when(F.col("_flee"), F.greatest(F.col("_best") * 0.8, r["fear"])).otherwise(F.col("_best"))
    empty = F.length("_t") == 0
    unknown = (score <= UNKNOWN_AT) & (F.length("_t") >= UNKNOWN_LENGTH) & (label != "neutral")
    told = {"_label": F.when(empty, F.lit("neutral")).when(unknown, F.lit("unknown")).otherwise(label), "_score": F.when(empty | unknown, 0.3).otherwise(score)}
    return rows.withColumns(told).drop("_best", "_first", "_flee", *(f"_{k}_{e}" for e in ORDER for k in "sr"))


def emotion_class(label: Column, intensity: Column) -> Column:
    """Coarse class of a label at an intensity."""
    return F.when(label.isin("sadness", "fear"), "subdued").when(label == "anger", F.when(intensity >= 0.4, "excited").otherwise("subdued")).when(label.isin("joy", "surprise"), F.when(intensity >= 0.4, "excited").otherwise("neutral")).otherwise("neutral")


def emotion_vector(label: Column, confidence: Column, intensity: Column) -> Column:
    """Happiness, anger, sadness, fear, disgust, melancholy, surprise, calm."""
    main = F.least(clamp(confidence) * clamp(intensity), F.lit(1.0))
    on = lambda *names: F.when(label.isin(*names), main).otherwise(0.0)
    sad = F.when(label == "sadness", main).when(label == "fear", main * 0.2).otherwise(0.0)
    return F.array(on("joy"), on("anger"), sad, on("fear"), F.lit(0.0), on("sadness") * 0.3, on("surprise"), F.when(label.isin("neutral", "unknown"), 1.0).otherwise(0.0))


def emotion_text(label: Column, intensity: Column) -> Column:
    """A short description for a speaker; fixed words."""
    level = F.when(intensity >= 0.7, "强烈").when(intensity >= 0.4, "中等").otherwise("轻微")
    names = {"joy": "喜悦", "anger": "愤怒", "sadness": "悲伤", "surprise": "惊讶", "fear": "恐惧"}
    return F.coalesce(*(F.when(label == k, F.concat(level, F.lit(f"的{v}"))) for k, v in names.items()), F.lit("平静"))


def classify(df: DataFrame, pack: Pack, text_col: str = "sentence") -> DataFrame:
    """Adds emotion_label, confidence, intensity, emotion_class, emotion_vector and emotion_text, each sentence by itself."""
    return _finish(decide(with_scores(df, F.col(text_col), pack.emotions), pack.emotions))


def _finish(rows: DataFrame) -> DataFrame:
    rows = rows.withColumns({"emotion_label": F.col("_label"), "confidence": F.least("_score", F.lit(0.95)), "intensity": F.least(F.col("_score") / 0.8, F.lit(1.0))})
    label, intensity = F.col("emotion_label"), F.col("intensity")
    return rows.withColumns({"emotion_class": emotion_class(label, intensity), "emotion_vector": emotion_vector(label, F.col("confidence"), intensity), "emotion_text": emotion_text(label, intensity)}).drop("_t", "_label", "_score")


def classify_in_order(df: DataFrame, pack: Pack, by: list[str], order: str, text_col: str = "sentence") -> DataFrame:
    """As classify(), but a sentence without a signal takes up the label of the one before.

    Scores don't depend on the past, so only they are folded: one array per group (a chapter), in a single pass.
    """
    rows = with_scores(df, F.col(text_col), pack.emotions)
    scores = F.struct(*(F.col(f"_s_{e}").alias(e) for e in ORDER))
    each = F.struct(F.col(order).alias("o"), scores.alias("s"), F.length("_t").alias("n"), F.col("_t").rlike(pack.emotions.fear_signals).alias("flee"), F.struct(*df.columns).alias("row"))
    packed = rows.groupBy(*by).agg(F.sort_array(F.collect_list(each)).alias("_rows"))
    first = F.struct(F.lit("").alias("label"), F.lit(0.0).alias("score"))
    told = F.zip_with("_rows", scan(F.col("_rows"), first, _carried, "struct<label:string,score:double>"), lambda r, d: F.struct(r["row"].alias("row"), d.alias("d")))
    folded = packed.select(F.explode(told).alias("x")).select("x.row.*", F.lit("").alias("_t"), F.col("x.d.label").alias("_label"), F.col("x.d.score").alias("_score"))
    return _finish(folded)


def _carried(past: Column, x: Column) -> Column:
    """One sentence's label and score after those of the sentence before; the same decision as decide()."""
    low = F.greatest(*(x["s"][e] for e in ORDER)) <= LOW
    hinted = lambda e: F.when(low & (past["label"] == e) & (F.least(past["score"], F.lit(0.95)) >= HINT_AT), HINT).otherwise(0.0) if e in CARRIED else F.lit(0.0)
    values = F.array(*(F.round(F.least(x["s"][e] + hinted(e), F.lit(1.0)), 10) for e in ORDER))
    fear = ORDER.index("fear")

    def chosen(v: Column) -> Column:
        best = F.array_max(v)
        label = F.coalesce(*(F.when(v[i] == best, F.lit(e)) for i, e in enumerate(ORDER)))
        flee = (label == "anger") & (best >= 0.4) & x["flee"] & (v[fear] > 0.1)
        return F.struct(F.when(flee, F.lit("fear")).otherwise(label).alias("label"), F.when(flee, F.greatest(best * 0.8, v[fear])).otherwise(best).alias("score"))

    def told(d: Column) -> Column:
        pair = lambda label, score: F.struct(F.lit(label).alias("label"), F.lit(score).alias("score"))
        unknown = (d["score"] <= UNKNOWN_AT) & (x["n"] >= UNKNOWN_LENGTH) & (d["label"] != "neutral")
        return F.when(x["n"] == 0, pair("neutral", 0.3)).when(unknown, pair("unknown", 0.3)).otherwise(d)

    return let(let(values, chosen), told)


def context_window(text: Column, start: Column, end: Column, around: int = 20) -> Column:
    """The text from `around` characters before a sentence to as many after it."""
    first = F.greatest(start - around, F.lit(0))
    return F.substring(text, (first + 1).cast("int"), (end + around - first).cast("int"))


def keyword_votes(df: DataFrame, lexicon: DataFrame, id_cols: list[str], text_col: str) -> DataFrame:
    """Hits per label of a (label, word) lexicon, and the label with most (ties: first by name).

    A lexicon of up to LEXICON words becomes part of the plan, so that nothing but votes is shuffled; a larger one is joined.
    """
    words = [(r.label, r.word) for r in lexicon.select("label", "word").distinct().orderBy("label", "word").limit(LEXICON + 1).collect()]
    if len(words) > LEXICON:  # a lexicon too large for a plan: words meet texts by their first three characters, shorter ones by all they have
        grams = df.select(*id_cols, F.col(text_col).alias("_t"), F.explode(F.array_distinct(F.concat(*(ngrams(F.col(text_col), n) for n in (1, 2, 3))))).alias("_g"))
        pairs = grams.join(lexicon.select("label", "word").distinct().withColumn("_g", F.substring("word", 1, 3)), "_g").where(F.contains("_t", "word"))
        hits = pairs.select(*id_cols, F.struct("label", "word").alias("w"))
    else:
        every = F.array(*(F.struct(F.lit(a).alias("label"), F.lit(b).alias("word")) for a, b in words)) if words else F.array().cast("array<struct<label:string,word:string>>")
        hits = df.select(*id_cols, F.explode(F.filter(every, lambda w: F.contains(F.col(text_col), w["word"]))).alias("w"))
    votes = hits.groupBy(*id_cols, F.col("w.label").alias("label")).agg(F.count(F.lit(1)).alias("votes"))
    return votes.groupBy(*id_cols).agg(F.sum("votes").alias("n_hits"), F.min_by("label", F.struct(-F.col("votes"), F.col("label"))).alias("label"), F.max("votes").alias("votes"))


def keyword_discrimination(grams: DataFrame, least: int = 2, share: float = 0.7) -> DataFrame:
    """(gram, label) counts -> grams that mostly mean one label."""
    per = grams.groupBy("gram", "label").agg(F.count(F.lit(1)).alias("n"))
    out = per.groupBy("gram").agg(F.sum("n").alias("total"), F.max("n").alias("most"), F.min_by("label", F.struct(-F.col("n"), F.col("label"))).alias("label"))
    return out.where((F.col("total") >= least) & (F.col("most") / F.col("total") >= share))
