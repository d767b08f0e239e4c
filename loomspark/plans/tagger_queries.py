"""Registered queries of the rule tagger and of names near verbs."""

from __future__ import annotations

from pyspark.sql import functions as F

from loomspark.operators import classifiers, tagger
from loomspark.plans.queries import _OFFSET_SPLIT, _sentences, long, query, table

_RULES = tagger.TaggerRules(
    keywords=(("joy", ("ble", "ción", "and b")), ("anger", ("erra", "ander", "ver")), ("sadness", ("leaeed", "ou th", "elle")), ("surprise", ("stion", "heit", "nt")), ("fear", ("shre", "thwh", "sich"))),
    patterns=(("surprise", "que.*[.]", 0.7), ("anger", "^D.*en[.]", 0.9), ("sadness", "on[.]$", 0.5), ("joy", "^The.*[.]", 0.8)),
    laughter=(("ingen", "anger"), ("teau", "sadness")), negations=("no", "nicht", "ne", "un"), mild=("en er", "le ", "du"), strong=("sch", "th th"), marks='[,“”"]', guide="([a-z ]{0,5}?(?:ver|and|des|la)[:,.!]?)",
)


def _n(text: str, words: tuple[str, ...]) -> str:
    return "(" + " + ".join(f"contains({text}, '{w}')::INT" for w in words) + ")"


def _first(prefix: str, emotions: list[str], most: str) -> str:
    return "CASE WHEN " + most + " = 0 THEN 'neutral' " + " ".join(f"WHEN {prefix}{i} = {most} THEN '{e}'" for i, e in enumerate(emotions)) + " END"


_E = [e for e, _ in _RULES.keywords]
_COUNTED = ", ".join(f"{_n('guide', ws)} AS g{i}, {_n('sentence', ws)} AS k{i}" for i, (_, ws) in enumerate(_RULES.keywords)) + ", " + ", ".join(f"CASE WHEN regexp_matches(sentence, '{p}') THEN {s} ELSE 0 END::DOUBLE AS p{i}" for i, (_, p, s) in enumerate(_RULES.patterns))
_NEAR = " OR ".join(f"(contains(sentence, '{n}') AND emotion = '{e}' AND contains(sentence[instr(sentence, '{n}'):instr(sentence, '{n}') + 6], '{w}'))" for n in _RULES.negations for e, ws in _RULES.keywords for w in ws)
_TAGGED = f"""s AS ({_OFFSET_SPLIT}), b AS (SELECT *, CASE WHEN regexp_matches(sentence, '[,“”"]') THEN regexp_extract(right(string_split_regex(sentence, '[,“”"]')[1], 10), '{_RULES.guide}', 1) ELSE '' END AS guide FROM s),
c AS (SELECT doc_id, sentence_index, sentence, {_COUNTED} FROM b), m AS (SELECT *, greatest({', '.join(f'g{i}' for i in range(len(_E)))}) AS gm, greatest({', '.join(f'k{i}' for i in range(len(_E)))}) AS km, greatest({', '.join(f'p{i}' for i in range(len(_RULES.patterns)))}) AS pm FROM c),
f AS (SELECT *, CASE WHEN contains(sentence, 'ingen') THEN 'anger' WHEN contains(sentence, 'teau') THEN 'sadness' WHEN km > gm THEN {_first('k', _E, 'km')} ELSE {_first('g', _E, 'gm')} END AS ke, CASE WHEN contains(sentence, 'ingen') OR contains(sentence, 'teau') THEN 1 ELSE greatest(km, gm) END AS kn, {_first('p', [e for e, _, _ in _RULES.patterns], 'pm')} AS pe FROM m),
e AS (SELECT doc_id, sentence_index, sentence, CASE WHEN kn > 0 THEN ke WHEN pm > 0 THEN pe ELSE 'neutral' END AS emotion, CASE WHEN kn > 0 THEN kn * 0.3 + CASE WHEN pm > 0 AND pe = ke THEN pm * 0.5 ELSE 0 END WHEN pm > 0 THEN pm ELSE 0 END AS score FROM f),
d AS (SELECT *, emotion <> 'neutral' AND ({_NEAR}) AS downgraded, CASE WHEN {_n('sentence', _RULES.mild)} > 0 THEN 2 WHEN {_n('sentence', _RULES.strong)} > 0 THEN 4 ELSE 3 END AS level FROM e)"""


@query(f"WITH {_TAGGED} SELECT doc_id, sentence_index, emotion, round(least(score / 3, 1), 6)::DOUBLE AS confidence, ['neutral', 'mild', 'moderate', 'strong'][level - downgraded::INT] AS intensity, downgraded FROM d")
def rule_tags(spark, d):
    """One label."""
    rows = _sentences(spark, d).select("doc_id", *long("sentence_index"), tagger.tag(F.col("sentence"), _RULES).alias("t"))
    return rows.select("doc_id", "sentence_index", "t.emotion", F.round("t.confidence", 6).alias("confidence"), "t.intensity", "t.downgraded")


@query(f"""WITH s AS ({_OFFSET_SPLIT}), c AS (SELECT doc_id, sentence_index, unnest([{', '.join(f"{{'emotion': '{e}', 'n': {_n('sentence', ws)}}}" for e, ws in _RULES.keywords)}]) AS x FROM s),
h AS (SELECT doc_id, sentence_index, x.emotion AS emotion, round(least(x.n * 0.2, 1), 6)::DOUBLE AS score FROM c WHERE x.n > 0)
SELECT * FROM h UNION ALL SELECT doc_id, sentence_index, 'neutral', 1.0::DOUBLE FROM s ANTI JOIN h ON s.doc_id = h.doc_id AND s.sentence_index = h.sentence_index""")
def rule_labels(spark, d):
    """All labels."""
    rows = _sentences(spark, d).select("doc_id", *long("sentence_index"), F.explode(tagger.labels(F.col("sentence"), _RULES)).alias("x"))
    return rows.select("doc_id", "sentence_index", "x.emotion", F.round("x.score", 6).alias("score"))


@query("SELECT lang, fold, count(*) AS n, sum(doc_id)::BIGINT AS sum_ids FROM (SELECT doc_id, lang, (row_number() OVER (PARTITION BY lang ORDER BY md5(coalesce(text, '')), doc_id) - 1) % 5 AS fold FROM (SELECT text, lang, min(doc_id) AS doc_id FROM documents GROUP BY text, lang)) GROUP BY lang, fold")
def stratified_folds(spark, d):
    """Folds of the different texts of each language."""
    rows = table(spark, d, "documents").groupBy("text", "lang").agg(F.min("doc_id").alias("doc_id"))
    out = classifiers.stratified_folds(rows, "lang", "text", 5).groupBy("lang", F.col("fold").cast("long").alias("fold"))
    return out.agg(F.count(F.lit(1)).alias("n"), F.sum("doc_id").cast("long").alias("sum_ids"))
