"""More registered queries: statistics, checks and formulas of names, sentences and speakers over the driver's tables."""

from __future__ import annotations

from dataclasses import replace

from pyspark.sql import functions as F

from loomspark.operators import characters as lib
from loomspark.operators import emotion, entities, segment, similarity, speakers
from loomspark.packs import LATIN
from loomspark.plans.queries import _EACH, _LIBRARY, _NAMES, _OFFSET_SPLIT, _library, _line_names, _mentions, _offsets, _sentences, long, query, table

_STATS = rf"""{_NAMES}, {_EACH},
occ AS (SELECT e.doc_id, e.name, ((length(text) - length(replace(text, e.name, ''))) / length(e.name))::BIGINT AS n FROM each_name e JOIN documents d ON e.doc_id = d.doc_id),
pieces AS (SELECT e.doc_id, name, unnest(string_split(text, name)[2:]) AS piece, unnest(range(2, len(string_split(text, name)) + 1)) = len(string_split(text, name)) AS last FROM each_name e JOIN documents d ON e.doc_id = d.doc_id),
ch AS (SELECT doc_id, name, unnest(string_split(CASE WHEN last THEN piece[1:2] ELSE (piece[1:2] || name)[1:2] END, '')) AS c FROM pieces),
dv AS (SELECT doc_id, name, count(DISTINCT CASE WHEN c <> '' AND NOT regexp_matches(c, '[\p{{P}}\s]') THEN c END) AS diversity FROM ch GROUP BY doc_id, name)"""


_ENDS = (" the", " and", " in", " of")
_HITS = ", ".join(f"len(list_filter(regexp_extract_all(win, '(.{{1,4}}){w}', 1), lambda m: contains(m, name) OR contains(name, m))) AS k{i}" for i, w in enumerate(_ENDS))
_SPOKEN = tuple("stoie")


@query(rf"""WITH {_STATS},
ln AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, unnest(range(len(string_split(text, chr(10))))) AS i FROM documents),
seen AS (SELECT e.doc_id, i, name FROM each_name e JOIN ln ON e.doc_id = ln.doc_id AND contains(line, name)),
co AS (SELECT a.doc_id, a.name, b.name AS other, count(*) AS k FROM seen a JOIN seen b ON a.doc_id = b.doc_id AND a.i = b.i AND a.name <> b.name GROUP BY a.doc_id, a.name, b.name),
cs AS (SELECT co.doc_id, co.name, count(DISTINCT other) AS partners, coalesce(sum(CASE WHEN o.n >= 5 THEN k END), 0) AS frequent FROM co LEFT JOIN occ o ON co.doc_id = o.doc_id AND co.other = o.name GROUP BY co.doc_id, co.name),
ps AS (SELECT e.doc_id, name, text, string_split(text, name) AS parts FROM each_name e JOIN documents d ON e.doc_id = d.doc_id),
pl AS (SELECT doc_id, name, text, unnest(list_transform(range(1, len(parts)), lambda i: list_sum(list_transform(parts[1:i], lambda x: length(x))) + (i - 1) * length(name)))::BIGINT AS s FROM ps),
wn AS (SELECT doc_id, name, text[greatest(s - 50, 0) + 1:s + 50] AS win FROM pl), wk AS (SELECT doc_id, name, {_HITS} FROM wn),
bh AS (SELECT doc_id, name, {' + '.join(f'(sum(k{i}) > 0)::INT' for i in range(len(_ENDS)))} AS templates, {' + '.join(f'sum(k{i})' for i in range(len(_ENDS)))} AS hits FROM wk GROUP BY doc_id, name),
nb AS (SELECT doc_id, name, list_distinct(list(c) FILTER (c <> '' AND NOT regexp_matches(c, '[\p{{P}}\s]'))) AS cs FROM ch GROUP BY doc_id, name),
mg AS (SELECT DISTINCT r.doc_id, r.name FROM (SELECT occ.*, unnest([name[1:length(name) - 1], name[1:length(name) - 2]]) AS prefix FROM occ WHERE n <= 2 AND length(name) >= 3) r JOIN occ p ON r.doc_id = p.doc_id AND r.prefix = p.name AND p.n >= 5 JOIN nb ON r.doc_id = nb.doc_id AND r.name = nb.name
  WHERE r.n < 0.1 * p.n AND len(cs) > 0 AND len(list_filter(cs, lambda c: c IN ({', '.join(f"'{c}'" for c in _SPOKEN)}))) / len(cs) >= 0.5),
x AS (SELECT occ.doc_id, occ.name, occ.n, coalesce(dv.diversity, 0)::BIGINT AS diversity, coalesce(partners, 0)::BIGINT AS partners, coalesce(frequent, 0)::BIGINT AS frequent, coalesce(templates, 0)::BIGINT AS templates, coalesce(hits, 0)::BIGINT AS hits, mg.name IS NOT NULL AS merged
  FROM occ LEFT JOIN dv ON occ.doc_id = dv.doc_id AND occ.name = dv.name LEFT JOIN cs ON occ.doc_id = cs.doc_id AND occ.name = cs.name LEFT JOIN bh ON occ.doc_id = bh.doc_id AND occ.name = bh.name LEFT JOIN mg ON occ.doc_id = mg.doc_id AND occ.name = mg.name)
SELECT doc_id, name, n, diversity, partners, frequent, templates, hits, CASE WHEN merged THEN 0.1 WHEN n < 3 THEN CASE WHEN templates >= 3 AND hits >= 5 THEN 0.6 ELSE 0.3 END WHEN diversity <= 1 THEN CASE WHEN partners >= 3 AND frequent >= 2 OR templates >= 3 AND hits >= 5 THEN 0.6 ELSE 0.2 END WHEN n >= 5 AND diversity >= 2 THEN 0.8 ELSE 0.6 END::DOUBLE AS confidence FROM x""")
def validated_names(spark, d):
    """G8 with all statistics from the texts: boundary words, mis-merges and co-occurrence included."""
    pack = replace(LATIN, boundary_suffixes=_ENDS, dialogue_words=_SPOKEN)
    names = _mentions(spark, d).distinct().withColumn("confidence", F.lit(0.6))
    out = entities.validate(table(spark, d, "documents"), names, pack, ["doc_id"])
    zero = lambda c: F.coalesce(F.col(c), F.lit(0)).cast("long")
    return out.select("doc_id", "name", *long("n"), zero("diversity").alias("diversity"), zero("co_diversity").alias("partners"), zero("high_conf_co").alias("frequent"), zero("templates").alias("templates"), zero("hits").alias("hits"), F.col("new_confidence").cast("double").alias("confidence"))


@query(rf"""WITH {_STATS} SELECT occ.doc_id, occ.name, round(least(occ.n / 10, 1) * 0.3 + least(coalesce(diversity, 0) / 5, 1) * 0.3, 6)::DOUBLE AS score FROM occ LEFT JOIN dv ON occ.doc_id = dv.doc_id AND occ.name = dv.name""")
def composite_scores(spark, d):
    docs, names = table(spark, d, "documents"), _mentions(spark, d)
    stats = entities.occurrence_counts(docs, names, ["doc_id"]).join(entities.right_neighbours(docs, names, ["doc_id"]), ["doc_id", "name"], "left")
    return stats.select("doc_id", "name", F.round(entities.composite_score(F.col("n"), F.coalesce("diversity", F.lit(0)), F.lit(0), F.lit(0)), 6).alias("score"))


@query(f"WITH {_offsets('[A-Z][a-zà-ÿ]+')} SELECT doc_id, name, count(DISTINCT start // 1000)::BIGINT AS n_chapters FROM p GROUP BY doc_id, name")
def name_chapters(spark, d):
    docs = table(spark, d, "documents")
    plain = replace(LATIN, chapter_patterns=("^(?!)",), volume_patterns=("^(?!)",))
    chapters = segment.split_chapters(docs, plain, chunk=1000, overlap=0)
    return entities.chapter_spread(entities.mentions(docs, LATIN, ["doc_id"]), chapters, ["doc_id"]).select("doc_id", "name", *long("n_chapters"))


@query(f"""WITH {_offsets('[A-Z][a-zà-ÿ]+')}, q AS (SELECT doc_id, s.start AS s, s.start + length(s.name) AS e FROM (WITH {_offsets('[0-9]+')} SELECT * FROM p) s),
n AS (SELECT DISTINCT p.doc_id, p.name, p.start FROM p JOIN q ON p.doc_id = q.doc_id AND q.s <= p.start + length(p.name) + 200 AND q.e >= p.start - 200),
c AS (SELECT doc_id, name, count(*) AS n_positions, min(start)::BIGINT AS first_position FROM n GROUP BY doc_id, name HAVING count(*) >= 2)
SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY n_positions DESC, first_position, name) AS rank FROM c) WHERE rank <= 30""")
def role_names_top(spark, d):
    docs = table(spark, d, "documents")
    marks = entities.mentions(docs, LATIN, ["doc_id"], pattern="[0-9]+").select("doc_id", "start", "end")
    return entities.role_names(docs, marks, LATIN, ["doc_id"]).select("doc_id", "name", *long("n_positions", "first_position", "rank"))


_HEADS = ("Q", "X", "Z")


@query(rf"""WITH ch AS (SELECT doc_id, text, unnest(string_split(text, '')) AS c, unnest(range(length(text))) AS s FROM documents WHERE text <> ''),
h AS (SELECT doc_id, c AS head, text[s + 1:s + 2] AS name, regexp_matches(text[s + 3:s + 62], ' the| and| in| of| was') AS near FROM ch WHERE c IN ({', '.join(f"'{h}'" for h in _HEADS)})),
g AS (SELECT doc_id, head, name, count(*) AS n, count_if(near)::BIGINT AS near FROM h WHERE regexp_matches(name, '^\p{{L}}{{2}}$') GROUP BY doc_id, head, name),
t AS (SELECT *, n / sum(n) OVER (PARTITION BY doc_id, head) AS tightness FROM g)
SELECT doc_id, head, name, n, near, round(tightness, 6)::DOUBLE AS tightness FROM t WHERE near >= 2 AND tightness >= 0.1""")
def compound_names(spark, d):
    docs = table(spark, d, "documents")
    heads = docs.select("doc_id", F.explode(F.array(*(F.lit(h) for h in _HEADS))).alias("name"))
    out = entities.compound_names(docs, heads, LATIN, ["doc_id"])
    return out.select("doc_id", "head", "name", *long("n", "near"), F.round("tightness", 6).alias("tightness"))


@query(f"""WITH s AS ({_OFFSET_SPLIT}), {_NAMES}, {_EACH}, hit AS (SELECT s.doc_id, sentence_index, name FROM s JOIN each_name e ON s.doc_id = e.doc_id AND contains(sentence, name))
SELECT s.doc_id, s.sentence_index, coalesce(string_agg(name, ',' ORDER BY name), '') AS entities FROM s LEFT JOIN hit ON s.doc_id = hit.doc_id AND s.sentence_index = hit.sentence_index GROUP BY s.doc_id, s.sentence_index""")
def sentence_entities(spark, d):
    out = segment.with_entities(_sentences(spark, d), _mentions(spark, d), ["doc_id"])
    return out.select("doc_id", *long("sentence_index"), F.array_join("entities", ",").alias("entities"))


@query(f"WITH s AS ({_OFFSET_SPLIT}) SELECT s.doc_id, sentence_index, md5(text[greatest(start - 20, 0) + 1:stop + 20]) AS window_md5 FROM s JOIN documents d ON s.doc_id = d.doc_id")
def context_windows(spark, d):
    docs = table(spark, d, "documents")
    rows = docs.select("doc_id", "text", F.posexplode(segment.sentence_spans(F.col("text"), LATIN, False)).alias("sentence_index", "x"))
    return rows.select("doc_id", *long("sentence_index"), F.md5(emotion.context_window(F.col("text"), F.col("x.start"), F.col("x.end"))).alias("window_md5"))


@query("""WITH r AS (SELECT doc_id, unnest(regexp_extract_all(text, '[a-z]+')) AS w FROM documents), g AS (SELECT unnest(list_transform(range(1, greatest(length(w), 1)), lambda i: w[i:i + 1]) || list_transform(range(1, greatest(length(w) - 1, 1)), lambda i: w[i:i + 2])) AS gram FROM r)
SELECT gram, count(*) AS n FROM g GROUP BY gram""")
def gram_counts(spark, d):
    return segment.keyword_grams(table(spark, d, "documents"), ["doc_id"], "text", "[a-z]+").groupBy("gram").agg(F.count(F.lit(1)).alias("n"))


@query("SELECT user_id, event_id FROM (SELECT user_id, event_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS n FROM events) WHERE n % 3 = 0")
def strided_rows(spark, d):
    return segment.strided(table(spark, d, "events"), ["ts", "event_id"], ["user_id"], 3).select("user_id", "event_id")


@query(f"""WITH s AS ({_OFFSET_SPLIT}), p AS (SELECT doc_id, sentence_index, sentence, list_filter(list_transform(string_split_regex(sentence, '[。！？；.!?;]'), lambda x: regexp_replace(x, '^\\s+|\\s+$', '', 'g')), lambda x: length(x) > 0) AS parts FROM s)
SELECT doc_id, sentence_index, round((length(sentence) - length(replace(sentence, '!', ''))) * 10 / greatest(1, length(sentence)), 6)::DOUBLE AS density, round(CASE WHEN len(parts) > 0 THEN list_sum(list_transform(parts, lambda x: length(x))) / len(parts) ELSE 0 END, 6)::DOUBLE AS mean_length FROM p""")
def emotion_densities(spark, d):
    f = emotion.features(F.col("sentence"), LATIN.emotions)
    return _sentences(spark, d).select("doc_id", *long("sentence_index"), F.round(f["density"], 6).alias("density"), F.round(f["mean_length"].cast("double"), 6).alias("mean_length"))


@query("SELECT a.vec_id, round(list_cosine_similarity(a.embedding::DOUBLE[], b.embedding::DOUBLE[]), 6) AS similarity FROM embeddings a JOIN embeddings b ON b.vec_id = a.vec_id + 1")
def pair_cosine(spark, d):
    e = table(spark, d, "embeddings")
    pairs = e.select("vec_id", F.col("embedding").alias("a")).join(e.select((F.col("vec_id") - 1).alias("vec_id"), F.col("embedding").alias("b")), "vec_id")
    return similarity.pair_similarity(pairs, "a", "b").select("vec_id", F.round(F.col("similarity").cast("double"), 6).alias("similarity"))


@query(f"""WITH {_NAMES}, c AS (SELECT doc_id, name, count(*) AS n FROM names GROUP BY doc_id, name), k AS (SELECT doc_id FROM c WHERE n >= 3 GROUP BY doc_id HAVING count(*) >= 3)
SELECT c.doc_id, c.name, c.n FROM c JOIN k ON c.doc_id = k.doc_id JOIN documents d ON d.doc_id = c.doc_id WHERE length(text) >= 3000""")
def clustering_gate(spark, d):
    counted = _mentions(spark, d).groupBy("doc_id", "name").agg(F.count(F.lit(1)).alias("n"))
    return similarity.gated(counted, table(spark, d, "documents").select("doc_id", "text"), ["doc_id"]).select("doc_id", "name", "n")


@query("""SELECT event_id, round(least(0.85 + (1 - (event_id % 5) / 5 + least((event_id % 7) * 0.05, 0.2) + CASE WHEN event_id % 3 = 0 THEN 0.15 ELSE 0 END - CASE WHEN event_id % 4 = 0 THEN 0.10 ELSE 0 END) * 0.1, 0.95), 6)::DOUBLE AS pronoun,
round(greatest(0.4, least(CASE WHEN event_id % 2 = 0 THEN 0.5 + (event_id % 7) * 0.03 ELSE 0.6 + (event_id % 7) * 0.05 END, 0.6)), 6)::DOUBLE AS address, round(greatest(0.6, least(0.8, 0.6 + ((event_id % 101) / 100 - 0.7) * 0.5)), 6)::DOUBLE AS semantic, round(greatest(0.10 - 0.005 * (event_id % 30), 0), 6)::DOUBLE AS near FROM events""")
def speaker_confidences(spark, d):
    i = F.col("event_id")
    e = table(spark, d, "events")
    pronoun = speakers.pronoun_confidence(i % 5, F.lit(5), i % 7, i % 3 == 0, i % 4 == 0)
    return e.select("event_id", F.round(pronoun, 6).alias("pronoun"), F.round(speakers.address_confidence(i % 7, i % 2 == 0), 6).alias("address"), F.round(speakers.semantic_confidence((i % 101) / 100), 6).alias("semantic"), F.round(speakers.proximity_bonus(i % 30), 6).alias("near"))


@query(f"""WITH {_NAMES}, c AS (SELECT doc_id, name, count(*) AS n FROM names GROUP BY doc_id, name), x AS (SELECT *, CASE WHEN length(name) % 4 = 0 THEN 'LOC' ELSE 'PER' END AS type, CASE WHEN length(name) % 5 = 0 THEN 0.65 ELSE 0.5 END::DOUBLE AS sure, length(name) % 4 AS scenes, n = 2 AND length(name) % 3 = 0 AS speaks FROM c)
SELECT doc_id, name, round(CASE WHEN scenes >= 3 THEN greatest(sure, least(sure * 1.5, 0.8)) WHEN scenes >= 2 THEN greatest(sure, least(sure * 1.5, 0.65)) ELSE sure END, 6)::DOUBLE AS confidence FROM x WHERE type <> 'PER' OR sure = 0.65 OR n >= 3 OR speaks""")
def speaking_roles(spark, d):
    size = F.length("name")
    c = _mentions(spark, d).groupBy("doc_id", "name").agg(F.count(F.lit(1)).alias("n")).select("doc_id", "name", "n", F.when(size % 4 == 0, "LOC").otherwise("PER").alias("type"), F.when(size % 5 == 0, 0.65).otherwise(0.5).alias("confidence"), (size % 4).alias("scenes"))
    said = c.where((F.col("n") == 2) & (size % 3 == 0))
    return entities.speaker_roles(c, said, ["doc_id"]).select("doc_id", "name", F.round("confidence", 6).alias("confidence"))


@query(f"""WITH {_NAMES} SELECT DISTINCT name, length(name) BETWEEN 1 AND 8 AND name NOT IN ('The', 'In') AND NOT regexp_matches(name, '(?:er|ing)$') AS valid,
CASE WHEN name IN ('The', 'In') OR regexp_matches(name, '^[A-Za-z]{{1,2}}$') THEN 0.0 ELSE 1.0 END::DOUBLE AS cap FROM names""")
def name_checks(spark, d):
    stop = ("The", "In")
    names = _mentions(spark, d).select("name").distinct()
    return names.select("name", entities.valid_name(F.col("name"), stop, ("er", "ing")).alias("valid"), entities.clean_person(F.col("name"), (), stop).cast("double").alias("cap"))


@query(f"WITH {_LIBRARY} SELECT id::BIGINT AS id, CASE WHEN id = 7 THEN 'Renamed' ELSE name END AS name, CASE WHEN id = 7 THEN 'a,b' WHEN id = 3 THEN aliases[2] ELSE array_to_string(aliases, ',') END AS aliases, CASE WHEN id = 7 THEN 'female' ELSE 'unknown' END AS gender, id = 4 AS is_locked FROM library")
def character_changes(spark, d):
    c = _library(spark, d)
    c = lib.set_lock(lib.update_character(c, 7, "Renamed", ["a", "b"], "female"), 4, 4, True)
    first = "nation_3"  # its name in lower case
    c = lib.without_alias(lib.without_alias(c, 3, first), 3, "none")
    return c.select("id", "name", F.array_join("aliases", ",").alias("aliases"), "gender", "is_locked")


@query(f"WITH {_LIBRARY} SELECT project::BIGINT AS project, count(*) AS n_characters FROM library GROUP BY project")
def character_counts(spark, d):
    return lib.counted(_library(spark, d)).select("project", "n_characters")


@query(f"""WITH {_LIBRARY}, g AS (SELECT r_regionkey AS project, r_name AS name, lower(r_name) AS alias FROM region UNION ALL SELECT n_regionkey, n_name, 'first' FROM nation WHERE n_nationkey = 0)
SELECT project::BIGINT AS project, name, array_to_string(list_sort(list_distinct(aliases || CASE WHEN id = 0 THEN ['first'] ELSE [] END)), ',') AS aliases FROM library UNION ALL SELECT project::BIGINT, name, alias FROM g WHERE alias <> 'first'""")
def ground_truth_library(spark, d):
    truth = table(spark, d, "region").select(F.col("r_regionkey").cast("long").alias("project"), F.col("r_name").alias("name"), F.array(F.lower("r_name")).alias("aliases"))
    truth = truth.unionByName(table(spark, d, "nation").where("n_nationkey = 0").select(F.col("n_regionkey").cast("long").alias("project"), F.col("n_name").alias("name"), F.array(F.lit("first")).alias("aliases")))
    return lib.with_ground_truth(_library(spark, d), truth).select("project", "name", F.array_join("aliases", ",").alias("aliases"))


@query("""WITH x AS (SELECT doc_id, unnest([('he', 'male'), ('she', 'female'), ('they', 'unknown')]) AS p, text FROM documents)
SELECT doc_id, (CASE p[2] WHEN 'male' THEN 'man' WHEN 'female' THEN 'woman' ELSE 'someone' END) || ':' || p[1] AS name, CASE WHEN p[2] = 'unknown' THEN 0.3 ELSE 0.5 END::DOUBLE AS confidence FROM x WHERE contains(text, p[1])""")
def pronoun_names(spark, d):
    found = speakers.pronoun_placeholders(F.col("text"), {"he": "male", "she": "female", "they": "unknown"}, {"male": "man", "female": "woman", "unknown": "someone"})
    return table(spark, d, "documents").select("doc_id", F.explode(found).alias("p")).select("doc_id", "p.name", F.col("p.confidence").cast("double").alias("confidence"))


@query("""WITH r AS (SELECT DISTINCT role AS name FROM conversations), t AS (SELECT conv_id, turn, text, list(role) OVER (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN 3 PRECEDING AND 1 PRECEDING) AS recent FROM conversations),
x AS (SELECT conv_id, turn, r.name AS addressed, list_distinct(list_filter(coalesce(recent, []), lambda s: s <> r.name)) AS others FROM t, r WHERE (contains(text, 'er') AND suffix(r.name, 'er')) OR (contains(text, 'ant') AND suffix(r.name, 'ant')))
SELECT conv_id, turn, addressed, others[1] AS speaker, 0.7::DOUBLE AS confidence FROM x WHERE len(others) = 1""")
def address_turns(spark, d):
    turns = table(spark, d, "conversations").select("conv_id", "turn", "text", F.col("role").alias("speaker"))
    people = turns.select(F.col("speaker").alias("name")).distinct().withColumn("aliases", F.array().cast("array<string>"))
    return speakers.address_trigger(turns, people, ["conv_id"], "turn", ("er", "ant")).withColumn("confidence", F.col("confidence").cast("double"))
