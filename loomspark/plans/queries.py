"""Registered queries: library operators over the driver's tables, each beside its SQL.

Conversations stand for chapters, turns for sentences, roles for speakers.  Column types are pinned on both sides.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import replace

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomspark.functions.text import matches
from loomspark.functions.vectors import characters as char_set
from loomspark.functions.vectors import jaccard
from loomspark.operators import characters as lib
from loomspark.operators import emotion, entities, metrics, quotes, segment, similarity, sounds, speakers, voices
from loomspark.packs import LATIN
from loomspark.sources import stores
from loomspark.sources.tables import cut, read_table, spread

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}
WORD_RUN = "[A-Za-zà-ÿ]+"


def query(sql: str | None = None):
    def add(f: Callable[[SparkSession, str], DataFrame]):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


def table(spark: SparkSession, d: str, name: str) -> DataFrame:
    rows = read_table(spark, d, name)
    return spread(rows) if name == "documents" else rows


def long(*names: str):
    return [F.col(n).cast("long").alias(n) for n in names]


_SENTENCES = r"""list_filter(list_transform(regexp_extract_all(text, '[^.!?;\n]*[.!?;\n]|[^.!?;\n]+'), lambda s: regexp_replace(s, '^\s+|\s+$', '', 'g')), lambda s: length(s) > 0)"""
_PIECES = r"regexp_extract_all(text, '[^.!?;\n]*[.!?;\n]|[^.!?;\n]+')"
_OFFSET_SPLIT = rf"""WITH r AS (SELECT doc_id, unnest({_PIECES}) AS piece, unnest(range(len({_PIECES}))) AS i FROM documents),
a AS (SELECT doc_id, i, piece, regexp_replace(piece, '^\s+', '') AS tail, sum(length(piece)) OVER (PARTITION BY doc_id ORDER BY i) AS stop FROM r),
s AS (SELECT doc_id, i, regexp_replace(tail, '\s+$', '') AS sentence, (stop - length(tail))::BIGINT AS start FROM a)
SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY i) - 1 AS sentence_index, start, start + length(sentence) AS stop, sentence FROM s WHERE length(sentence) > 0"""
_SPLIT = f"SELECT doc_id, unnest({_SENTENCES}) AS sentence, unnest(range(len({_SENTENCES}))) AS sentence_index FROM documents"


def _sentences(spark: SparkSession, d: str) -> DataFrame:
    return segment.sentences(table(spark, d, "documents"), LATIN, ["doc_id"], smart=False)


@query(_OFFSET_SPLIT)
def sentence_split(spark, d):
    return _sentences(spark, d).select("doc_id", *long("sentence_index", "start"), F.col("end").cast("long").alias("stop"), "sentence")


@query(f"WITH s AS ({_SPLIT}) SELECT doc_id, count(*) AS n_sentences, sum(length(sentence))::BIGINT AS n_chars, count_if(sentence LIKE '%!')::BIGINT AS n_exclaims FROM s GROUP BY doc_id")
def sentence_stats(spark, d):
    return _sentences(spark, d).groupBy("doc_id").agg(F.count(F.lit(1)).alias("n_sentences"), F.sum(F.length("sentence")).alias("n_chars"), F.count_if(F.endswith("sentence", F.lit("!"))).alias("n_exclaims"))


_HEADINGS = r"""
lines AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, unnest(range(len(string_split(text, chr(10))))) AS n FROM documents),
placed AS (SELECT doc_id, line, n, (sum(length(line) + 1) OVER (PARTITION BY doc_id ORDER BY n) - length(line) - 1)::BIGINT AS start FROM lines),
heads AS (SELECT doc_id, line AS title, start FROM placed WHERE regexp_matches(line, '^[A-Z][a-z]+\.$'))"""


@query(f"WITH RECURSIVE {_HEADINGS}, near AS (SELECT doc_id, title, min(start) AS start, false AS dup FROM heads GROUP BY doc_id, title UNION ALL SELECT k.doc_id, k.title, (SELECT min(h.start) FROM heads h WHERE h.doc_id = k.doc_id AND h.title = k.title AND h.start >= k.start + 100), false FROM near k WHERE EXISTS (SELECT 1 FROM heads h WHERE h.doc_id = k.doc_id AND h.title = k.title AND h.start >= k.start + 100)) SELECT doc_id, title, start FROM near WHERE NOT dup")
def line_headings(spark, d):
    rows = table(spark, d, "documents").select("doc_id", F.explode(segment.headings(F.col("text"), LATIN.chapter_patterns, LATIN.volume_patterns)).alias("h"))
    return rows.select("doc_id", F.col("h.text").alias("title"), F.col("h.start").cast("long").alias("start"))


@query(f"""WITH RECURSIVE {_HEADINGS}, near AS (SELECT doc_id, title, min(start) AS start, false AS dup FROM heads GROUP BY doc_id, title UNION ALL SELECT k.doc_id, k.title, (SELECT min(h.start) FROM heads h WHERE h.doc_id = k.doc_id AND h.title = k.title AND h.start >= k.start + 100), false FROM near k WHERE EXISTS (SELECT 1 FROM heads h WHERE h.doc_id = k.doc_id AND h.title = k.title AND h.start >= k.start + 100)),
h AS (SELECT doc_id, title, start, lead(start) OVER (PARTITION BY doc_id ORDER BY start) AS next FROM near WHERE NOT dup),
c AS (SELECT h.doc_id, title, start, coalesce(next, length(text)) AS stop, regexp_replace(substr(text, start + length(title) + 2, coalesce(next, length(text)) - start - length(title) - 1), '^\\s+|\\s+$', '', 'g') AS content FROM h JOIN documents d ON h.doc_id = d.doc_id),
u AS (SELECT doc_id, length(text) AS size, unnest(CASE WHEN length(text) <= 5000 THEN [0] ELSE range(0, length(text) - 200, 4800) END) AS start FROM documents d WHERE text IS NOT NULL AND NOT EXISTS (SELECT 1 FROM heads h WHERE h.doc_id = d.doc_id))
SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY start) - 1 AS chapter_index, title, start, stop::BIGINT AS stop, length(content) AS n_chars FROM c WHERE length(content) >= 10
UNION ALL SELECT doc_id, start // 4800, CASE WHEN size <= 5000 THEN 'Whole text' ELSE 'Part ' || (start // 4800 + 1) END, start, least(start + 5000, size), least(start + 5000, size) - start FROM u""")
def chapter_spans(spark, d):
    return segment.split_chapters(table(spark, d, "documents"), LATIN).select("doc_id", *long("chapter_index"), "title", *long("start"), F.col("end").cast("long").alias("stop"), F.length("content").cast("long").alias("n_chars"))


@query("""WITH c AS (SELECT doc_id, text, unnest(CASE WHEN length(text) <= 5000 THEN [0] ELSE range(0, length(text) - 200, 4800) END) AS start FROM documents)
SELECT doc_id, start::BIGINT AS start, least(start + 5000, length(text))::BIGINT AS stop, md5(substr(text, start + 1, 5000)) AS content_md5 FROM c""")
def chunk_overlap(spark, d):
    plain = replace(LATIN, chapter_patterns=("^(?!)",), volume_patterns=("^(?!)",))
    return segment.split_chapters(table(spark, d, "documents"), plain).select("doc_id", *long("start"), F.col("end").cast("long").alias("stop"), F.md5("content").alias("content_md5"))


@query(r"SELECT doc_id, i - 1 AS paragraph_index, p AS paragraph FROM (SELECT doc_id, unnest(list_transform(string_split_regex(text, '\n{2,}'), lambda s: regexp_replace(s, '^\s+|\s+$', '', 'g'))) AS p, unnest(range(1, len(string_split_regex(text, '\n{2,}')) + 1)) AS i FROM documents) WHERE length(p) >= 10")
def paragraph_split(spark, d):
    return segment.paragraphs(table(spark, d, "documents"), ["doc_id"]).select("doc_id", *long("paragraph_index"), "paragraph")


@query("SELECT conv_id, turn, role FROM (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1 AS n FROM conversations) WHERE n >= 1 AND n < 3")
def doc_slice(spark, d):
    return lib.slice_rows(table(spark, d, "conversations"), ["conv_id"], "turn", 1, 3).select("conv_id", "turn", "role")


@query("SELECT conv_id, turn, role, text FROM conversations WHERE conv_id = 3 AND turn = 0")
def point_read(spark, d):
    return lib.by_key(table(spark, d, "conversations"), conv_id=3, turn=0).select("conv_id", "turn", "role", "text")


@query("SELECT conv_id, turn, role FROM conversations WHERE conv_id = 5 ORDER BY turn")
def ordered_read(spark, d):
    return lib.ordered_read(table(spark, d, "conversations").select("conv_id", "turn", "role"), {"conv_id": 5}, "turn")


@query("SELECT conv_id, turn, CASE WHEN conv_id = 3 THEN 'edited' ELSE role END AS role, conv_id = 3 AS is_edited FROM conversations")
def partial_update(spark, d):
    rows = table(spark, d, "conversations").withColumn("is_edited", F.lit(False)).withColumnRenamed("role", "speaker")
    out = lib.update_rows(rows, "conv_id", 3, {"speaker": "edited", "conv_id": -1})
    return out.select("conv_id", "turn", F.col("speaker").alias("role"), "is_edited")


@query("SELECT conv_id, turn, lag(role) OVER w AS prev_role, lead(role) OVER w AS next_role, length(lag(text) OVER w) AS prefix_chars, length(lead(text) OVER w) AS suffix_chars FROM conversations WINDOW w AS (PARTITION BY conv_id ORDER BY turn)")
def turn_context(spark, d):
    from pyspark.sql import Window

    w = Window.partitionBy("conv_id").orderBy("turn")
    return table(spark, d, "conversations").select("conv_id", "turn", F.lag("role").over(w).alias("prev_role"), F.lead("role").over(w).alias("next_role"), F.length(F.lag("text").over(w)).cast("long").alias("prefix_chars"), F.length(F.lead("text").over(w)).cast("long").alias("suffix_chars"))


@query("""WITH c AS (SELECT *, CASE WHEN lag(role) OVER (PARTITION BY conv_id ORDER BY turn) <> role THEN 1 ELSE 0 END AS ch FROM conversations)
SELECT conv_id, turn, (sum(ch) OVER (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN 4 PRECEDING AND CURRENT ROW))::BIGINT AS changes, sum(ch) OVER (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN 4 PRECEDING AND CURRENT ROW) >= 2 AS unstable FROM c""")
def speaker_instability(spark, d):
    return speakers.instability(table(spark, d, "conversations"), ["conv_id"], "turn", "role").select("conv_id", "turn", *long("changes"), "unstable")


def _roles(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "conversations").select(F.col("role").alias("name")).distinct()


@query("SELECT DISTINCT role AS name FROM conversations WHERE conv_id = 2")
def characters_by_chapter(spark, d):
    said = table(spark, d, "conversations").select(F.col("conv_id").alias("chapter"), F.col("role").alias("speaker"))
    return lib.speaking_in(_roles(spark, d), said, 2)


_LIBRARY = "library AS (SELECT n_regionkey AS project, n_nationkey AS id, n_name AS name, [lower(n_name), n_name[1:3]] AS aliases FROM nation)"


def _library(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "nation").select(F.col("n_regionkey").cast("long").alias("project"), F.col("n_nationkey").cast("long").alias("id"), F.col("n_name").alias("name"), F.array(F.lower("n_name"), F.substring("n_name", 1, 3)).alias("aliases"), F.lit("unknown").alias("gender"), F.col("n_nationkey").cast("int").alias("first_appearance"), F.lit(False).alias("is_locked"))


@query(f"""WITH {_LIBRARY}, w AS (SELECT c_custkey, c_nationkey % 5 AS project, CASE c_custkey % 4 WHEN 0 THEN n_name WHEN 1 THEN lower(n_name) WHEN 2 THEN n_name[1:3] ELSE 'nobody' END AS key FROM customer JOIN nation ON c_nationkey = n_nationkey),
k AS (SELECT project, name AS key, 1 AS p, id, name FROM library UNION ALL SELECT project, unnest(aliases), 2, id, name FROM library),
b AS (SELECT project, key, arg_min({{'id': id, 'name': name}}, p * 1000 + id) AS b FROM k GROUP BY project, key)
SELECT c_custkey, w.project::BIGINT AS project, w.key, b.b.id::BIGINT AS id, b.b.name AS standard_name FROM w LEFT JOIN b ON w.project = b.project AND w.key = b.key""")
def alias_link(spark, d):
    n = table(spark, d, "nation")
    kind = F.col("c_custkey") % 4
    key = F.when(kind == 0, F.col("n_name")).when(kind == 1, F.lower("n_name")).when(kind == 2, F.substring("n_name", 1, 3)).otherwise("nobody")
    wanted = table(spark, d, "customer").join(n, F.col("c_nationkey") == F.col("n_nationkey")).select("c_custkey", (F.col("c_nationkey") % 5).cast("long").alias("project"), key.alias("key"))
    return lib.find_by_name(wanted, _library(spark, d)).select("c_custkey", "project", "key", "id", "standard_name")


@query(f"""WITH {_LIBRARY}, e AS (SELECT s_suppkey, n_regionkey AS project, CASE s_suppkey % 3 WHEN 0 THEN n_name WHEN 1 THEN n_name[1:4] || 'er' ELSE 'Zz' || s_suppkey::VARCHAR END AS text, CASE WHEN s_suppkey % 7 = 0 THEN 'LOC' ELSE 'PER' END AS type, (s_suppkey % 10) / 10.0::DOUBLE AS confidence FROM supplier JOIN nation ON s_nationkey = n_nationkey),
x AS (SELECT e.*, EXISTS (SELECT 1 FROM library l WHERE l.project = e.project AND (l.name = e.text OR list_contains(l.aliases, e.text))) AS exact,
  (SELECT min(l.name) FROM library l WHERE l.project = e.project AND length(regexp_replace(e.text, 'er$', '')) >= 2 AND contains(l.name, regexp_replace(e.text, 'er$', ''))) AS core FROM e)
SELECT project::BIGINT AS project, text, type, CASE WHEN type = 'PER' AND exact THEN 1.0 WHEN type = 'PER' AND core IS NOT NULL THEN greatest(confidence, 0.6) ELSE confidence END::DOUBLE AS confidence, type = 'PER' AND (exact OR core IS NOT NULL) AS is_linked FROM x WHERE type <> 'PER' OR (length(text) > 1 AND (exact OR core IS NOT NULL OR confidence >= 0.5))""")
def core_name_link(spark, d):
    n = table(spark, d, "nation")
    kind = F.col("s_suppkey") % 3
    text = F.when(kind == 0, F.col("n_name")).when(kind == 1, F.concat(F.substring("n_name", 1, 4), F.lit("er"))).otherwise(F.concat(F.lit("Zz"), F.col("s_suppkey").cast("string")))
    found = table(spark, d, "supplier").join(n, F.col("s_nationkey") == F.col("n_nationkey")).select(F.col("n_regionkey").cast("long").alias("project"), text.alias("text"), F.when(F.col("s_suppkey") % 7 == 0, "LOC").otherwise("PER").alias("type"), ((F.col("s_suppkey") % 10) / 10.0).cast("double").alias("confidence"))
    return lib.link_entities(found, _library(spark, d), "er$").select("project", "text", "type", "confidence", "is_linked")


_MAPPING = "mapping AS (SELECT n_regionkey AS project, n_name AS secondary, first_value(n_name) OVER (PARTITION BY n_regionkey ORDER BY n_nationkey) AS prime FROM nation)"


@query(f"WITH {_MAPPING} SELECT c_custkey, prime AS speaker FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN mapping ON mapping.secondary = n_name")
def merge_characters(spark, d):
    from pyspark.sql import Window

    n = table(spark, d, "nation")
    first = F.first("n_name").over(Window.partitionBy("n_regionkey").orderBy("n_nationkey"))
    mapping = n.select(F.col("n_regionkey").cast("long").alias("project"), F.col("n_name").alias("secondary"), first.alias("primary")).where("secondary <> primary")
    said = table(spark, d, "customer").join(n, F.col("c_nationkey") == F.col("n_nationkey")).select("c_custkey", F.col("n_regionkey").cast("long").alias("project"), F.col("n_name").alias("speaker"))
    return lib.merge_characters(_library(spark, d), said, mapping)[1].select("c_custkey", "speaker")


@query(f"""WITH {_MAPPING}, g AS (SELECT project, prime, list_distinct(flatten(list([secondary, lower(secondary), secondary[1:3]]))) AS more FROM mapping WHERE secondary <> prime GROUP BY project, prime)
SELECT n.n_nationkey::BIGINT AS id, n_name AS name, array_to_string(list_sort(list_distinct([lower(n_name), n_name[1:3]] || more)), ',') AS aliases FROM g JOIN nation n ON g.prime = n.n_name""")
def merged_aliases(spark, d):
    from pyspark.sql import Window

    n = table(spark, d, "nation")
    first = F.first("n_name").over(Window.partitionBy("n_regionkey").orderBy("n_nationkey"))
    mapping = n.select(F.col("n_regionkey").cast("long").alias("project"), F.col("n_name").alias("secondary"), first.alias("primary")).where("secondary <> primary")
    nobody = spark.createDataFrame([], "project long, speaker string")
    return lib.merge_characters(_library(spark, d), nobody, mapping)[0].select("id", "name", F.array_join("aliases", ",").alias("aliases"))


@query(f"""WITH {_LIBRARY}, w AS (SELECT DISTINCT c_nationkey % 5 AS project, c_mktsegment AS name FROM customer UNION SELECT n_regionkey, n_name FROM nation),
f AS (SELECT * FROM w WHERE NOT EXISTS (SELECT 1 FROM library l WHERE l.project = w.project AND (l.name = w.name OR list_contains(l.aliases, w.name))))
SELECT (row_number() OVER (ORDER BY project, name) + (SELECT max(id) FROM library))::BIGINT AS id, project::BIGINT AS project, name FROM f UNION ALL SELECT id::BIGINT, project::BIGINT, name FROM library""")
def find_or_create(spark, d):
    wanted = table(spark, d, "customer").select((F.col("c_nationkey") % 5).cast("long").alias("project"), F.col("c_mktsegment").alias("name")).union(table(spark, d, "nation").select(F.col("n_regionkey").cast("long"), "n_name")).withColumn("context", F.lit(""))
    return lib.find_or_create(wanted, _library(spark, d), LATIN).select("id", "project", "name")


@query("SELECT user_id, event_type, count(*) AS frequency, count(*) = 0 OR count(*) >= 5 AS eligible FROM events GROUP BY user_id, event_type")
def frequency_eligibility(spark, d):
    e = table(spark, d, "events")
    keys = ["user_id", "event_type"]
    return lib.eligible(e.select(*keys).distinct(), lib.frequencies(e, keys), keys).select(*keys, "frequency", "eligible")


@query("SELECT user_id, event_id, n AS n_mentions FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS n FROM events) WHERE n = 3")
def promotion(spark, d):
    return lib.promotions(table(spark, d, "events"), ["user_id"], ["ts", "event_id"]).select("user_id", "event_id", *long("n_mentions"))


@query("WITH l AS (SELECT event_type, max(event_id) AS m FROM events GROUP BY event_type) SELECT event_type, user_id, round(sum(exp(-0.05 * (m - event_id))), 6) AS activity FROM events JOIN l USING (event_type) GROUP BY event_type, user_id")
def activity_weight(spark, d):
    out = speakers.activity_weights_by_join(table(spark, d, "events"), ["event_type"], "user_id", "event_id")
    return out.select("event_type", "user_id", F.round("activity", 6).alias("activity"))


@query("SELECT conv_id, role, min(turn) AS first_time, row_number() OVER (PARTITION BY conv_id ORDER BY min(turn), role) AS rank FROM conversations GROUP BY conv_id, role")
def recency_rank(spark, d):
    return speakers.first_seen_ranks(table(spark, d, "conversations"), ["conv_id"], "role", "turn").select("conv_id", "role", "first_time", *long("rank"))


@query("SELECT conv_id, turn, array_to_string(list(role) OVER (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN 2 PRECEDING AND CURRENT ROW), ',') AS recent FROM conversations")
def last_k_list(spark, d):
    return speakers.last_mentions(table(spark, d, "conversations"), ["conv_id"], "turn", "role").select("conv_id", "turn", "recent")


@query("""WITH w AS (SELECT *, lag(role) OVER (PARTITION BY conv_id ORDER BY turn) AS p, lag(role, 2) OVER (PARTITION BY conv_id ORDER BY turn) AS pp FROM conversations),
c AS (SELECT conv_id, turn, p AS name, 0.7::DOUBLE AS confidence, 1 AS r FROM w WHERE p IS NOT NULL UNION ALL SELECT conv_id, turn, pp, 0.8, 2 FROM w WHERE pp IS NOT NULL UNION ALL SELECT conv_id, turn, 'user', 0.4, 3 FROM w),
f AS (SELECT conv_id, turn, name, arg_min(confidence, r) AS confidence, min(r) AS r FROM c GROUP BY conv_id, turn, name)
SELECT conv_id, turn, name, confidence, r::BIGINT AS source_rank, rank FROM (SELECT *, row_number() OVER (PARTITION BY conv_id, turn ORDER BY confidence DESC, r, name) AS rank FROM f) WHERE rank <= 2""")
def candidate_topk(spark, d):
    from pyspark.sql import Window

    w = Window.partitionBy("conv_id").orderBy("turn")
    t = table(spark, d, "conversations").withColumn("p", F.lag("role").over(w)).withColumn("pp", F.lag("role", 2).over(w))
    one = lambda name, sure, rank: t.select("conv_id", "turn", name.alias("name"), F.lit(sure).alias("confidence"), F.lit(str(rank)).alias("source"), F.lit(rank).alias("source_rank")).where("name is not null")
    every = one(F.col("p"), 0.7, 1).unionByName(one(F.col("pp"), 0.8, 2)).unionByName(one(F.lit("user"), 0.4, 3))
    return speakers.rank_candidates(every, ["conv_id", "turn"]).where("rank <= 2").select("conv_id", "turn", "name", "confidence", *long("source_rank", "rank"))


_NAMES = "names AS (SELECT doc_id, unnest(regexp_extract_all(text, '[A-Z][a-zà-ÿ]+')) AS name FROM documents)"


def _mentions(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "documents").select("doc_id", F.explode(F.regexp_extract_all("text", F.lit(LATIN.name_pattern), F.lit(0))).alias("name"))
    return rows


_LINES = r"pars AS (SELECT doc_id, n, unnest(regexp_extract_all(line, '[A-Z][a-zà-ÿ]+')) AS name FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, unnest(range(len(string_split(text, chr(10))))) AS n FROM documents)), few AS (SELECT DISTINCT doc_id, n, name FROM pars)"


def _line_names(spark: SparkSession, d: str) -> DataFrame:
    lines = table(spark, d, "documents").select("doc_id", F.posexplode(F.split("text", "\n")).alias("n", "line"))
    return lines.select("doc_id", "n", F.explode(F.regexp_extract_all("line", F.lit(LATIN.name_pattern), F.lit(0))).alias("name"))


def _pair_tasks(spark: SparkSession, d: str) -> int:
    """Four tasks for each of the scan, so that the pairs of one stay as many however large the table."""
    return 4 * max(read_table(spark, d, "documents").rdd.getNumPartitions(), spark.sparkContext.defaultParallelism)


@query(f"WITH {_LINES} SELECT a.name, b.name AS other, count(*) AS n FROM few a JOIN few b ON a.doc_id = b.doc_id AND a.n = b.n AND a.name <> b.name GROUP BY a.name, b.name")
def cooccurrence_pairs(spark, d):
    return entities.cooccurrence(_line_names(spark, d), ["doc_id", "n"], tasks=_pair_tasks(spark, d))


@query(f"""WITH {_LINES}, p AS (SELECT a.name, b.name AS other, count(*) AS n FROM few a JOIN few b ON a.doc_id = b.doc_id AND a.n = b.n AND a.name <> b.name GROUP BY a.name, b.name), c AS (SELECT name, count(*) AS k FROM pars GROUP BY name)
SELECT p.name, count(DISTINCT other) AS co_diversity, coalesce(sum(CASE WHEN c.k >= 50 THEN n END), 0)::BIGINT AS high_conf_co FROM p LEFT JOIN c ON p.other = c.name GROUP BY p.name""")
def high_conf_cooc(spark, d):
    names = _line_names(spark, d)
    counts = names.groupBy("name").agg(F.count(F.lit(1)).alias("n"))
    return entities.cooccurrence_stats(entities.cooccurrence(names, ["doc_id", "n"], tasks=_pair_tasks(spark, d)), counts, 50)


_EACH = "each_name AS (SELECT DISTINCT doc_id, name FROM names)"


@query(f"""WITH {_NAMES}, {_EACH}, occ AS (SELECT s.doc_id, s.name, ((length(text) - length(replace(text, s.name, ''))) / length(s.name))::BIGINT AS n FROM each_name s JOIN documents d ON s.doc_id = d.doc_id)
SELECT o.doc_id, o.name, o.n FROM occ o""")
def name_occurrences(spark, d):
    return entities.occurrence_counts(table(spark, d, "documents"), _mentions(spark, d), ["doc_id"])


@query(r"""WITH names AS (SELECT DISTINCT doc_id, unnest(regexp_extract_all(text, '[A-Z][a-zà-ÿ]+')) AS name FROM documents),
pieces AS (SELECT n.doc_id, name, unnest(string_split(text, name)[2:]) AS piece, unnest(range(2, len(string_split(text, name)) + 1)) = len(string_split(text, name)) AS last FROM names n JOIN documents d ON n.doc_id = d.doc_id),
ch AS (SELECT doc_id, name, unnest(string_split(CASE WHEN last THEN piece[1:2] ELSE (piece[1:2] || name)[1:2] END, '')) AS c FROM pieces)
SELECT s.doc_id, s.name, count(DISTINCT CASE WHEN c <> '' AND NOT regexp_matches(c, '[\p{P}\s]') THEN c END) AS diversity FROM names s LEFT JOIN ch ON s.doc_id = ch.doc_id AND s.name = ch.name GROUP BY s.doc_id, s.name""")
def right_neighbors(spark, d):
    return entities.right_neighbours(table(spark, d, "documents"), _mentions(spark, d), ["doc_id"]).select("doc_id", "name", "diversity")


@query(f"WITH {_NAMES} SELECT upper(name[1:1]) AS head, name, count(*) AS n, round(count(*) / sum(count(*)) OVER (PARTITION BY upper(name[1:1])), 6)::DOUBLE AS tightness FROM names GROUP BY upper(name[1:1]), name")
def tightness(spark, d):
    counted = _mentions(spark, d).groupBy(F.upper(F.substring("name", 1, 1)).alias("head"), "name").agg(F.count(F.lit(1)).alias("n"))
    return entities.with_tightness(counted, ["head"]).withColumn("tightness", F.round("tightness", 6))


@query(f"""WITH {_NAMES}, c AS (SELECT name, count(*) AS n FROM names GROUP BY name HAVING count(*) >= 5 AND length(name) >= 2), s AS (SELECT DISTINCT name, unnest([right(name, 1), right(name, 2)]) AS suffix FROM c)
SELECT suffix, count(DISTINCT name) AS n_names FROM s GROUP BY suffix HAVING count(DISTINCT name) >= 3 AND (length(suffix) = 1 OR suffix IN ('er', 'tion', 'n', 't'))""")
def suffix_discovery(spark, d):
    stats = _mentions(spark, d).groupBy("name").agg(F.count(F.lit(1)).alias("n"))
    return entities.name_suffixes(stats, LATIN)


@query(f"""WITH {_NAMES}, nx AS (SELECT unnest(regexp_extract_all(text, '[A-Z][a-zà-ÿ]+ ([a-z]+)', 1)) AS nb, unnest(regexp_extract_all(text, '([A-Z][a-zà-ÿ]+) [a-z]+', 1)) AS name FROM documents),
st AS (SELECT name, count(*) AS n FROM names GROUP BY name), nb AS (SELECT name, count(DISTINCT nb) AS k, count(DISTINCT CASE WHEN nb IN ('said', 'the', 'in') THEN nb END) AS h FROM nx GROUP BY name),
r AS (SELECT st.name, n, k, h, unnest([st.name[1:length(st.name) - 1], st.name[1:length(st.name) - 2]]) AS prefix FROM st JOIN nb ON st.name = nb.name WHERE n <= 2 AND length(st.name) >= 3)
SELECT DISTINCT r.name, r.prefix FROM r JOIN st p ON p.name = r.prefix AND p.n >= 5 WHERE r.n < 0.1 * p.n AND h >= 0.5 * k""")
def prefix_mismerge(spark, d):
    docs = table(spark, d, "documents")
    nxt = docs.select(F.explode(F.arrays_zip(F.regexp_extract_all("text", F.lit("([A-Z][a-zà-ÿ]+) [a-z]+"), F.lit(1)).alias("name"), F.regexp_extract_all("text", F.lit("[A-Z][a-zà-ÿ]+ ([a-z]+)"), F.lit(1)).alias("nb"))).alias("x")).select("x.*")
    stats = _mentions(spark, d).groupBy("name").agg(F.count(F.lit(1)).alias("n")).join(nxt.groupBy("name").agg(F.collect_set("nb").alias("neighbours")), "name", "left")  # a prefix needs no neighbours
    return entities.prefix_merges(stats, LATIN, [])


@query(f"""WITH {_LINES}, {_NAMES}, p AS (SELECT a.name, b.name AS other, count(*) AS n FROM few a JOIN few b ON a.doc_id = b.doc_id AND a.n = b.n AND a.name <> b.name GROUP BY a.name, b.name), k AS (SELECT name, count(*) AS k FROM pars GROUP BY name),
co AS (SELECT p.name, count(DISTINCT other) AS co, coalesce(sum(CASE WHEN k.k >= 50 THEN n END), 0) AS high FROM p LEFT JOIN k ON p.other = k.name GROUP BY p.name),
b AS (SELECT unnest(regexp_extract_all(text, '([A-Z][a-zà-ÿ]+) (?:the|and|in|of|was)', 1)) AS name, unnest(regexp_extract_all(text, '[A-Z][a-zà-ÿ]+ (the|and|in|of|was)', 1)) AS word FROM documents), t AS (SELECT name, count(DISTINCT word) AS kinds, count(*) AS hits FROM b GROUP BY name),
c AS (SELECT name, count(*) AS n, count(DISTINCT doc_id) AS diversity FROM names GROUP BY name),
x AS (SELECT c.name, n, diversity, coalesce(co, 0) AS co, coalesce(high, 0) AS high, coalesce(kinds >= 3 AND hits >= 5, false) AS strong FROM c LEFT JOIN co ON c.name = co.name LEFT JOIN t ON c.name = t.name)
SELECT name, n, CASE WHEN n < 3 THEN CASE WHEN strong THEN 0.6 ELSE 0.3 END WHEN diversity <= 1 THEN CASE WHEN co >= 3 AND high >= 2 THEN 0.6 WHEN strong THEN 0.6 ELSE 0.2 END WHEN n >= 5 AND diversity >= 2 THEN 0.8 WHEN strong THEN 0.6 ELSE 0.6 END::DOUBLE AS confidence FROM x""")
def confidence_ladder(spark, d):
    """Names of the whole table: documents as contexts, co-occurrence by line, boundary words behind a name."""
    # the ladder asks whether a name has one context or more, which the smallest and the largest id tell
    seen = _mentions(spark, d).groupBy("name").agg(F.count(F.lit(1)).alias("n"), F.min("doc_id").alias("doc_id"), F.max("doc_id").alias("last"))
    c = cut(seen.select("name", "n", "doc_id", F.when(F.col("last") > F.col("doc_id"), entities.DIVERSITY).otherwise(1).alias("diversity")))  # three branches read it
    # partners count on one rung only: names of one document, three times or more
    lone = c.where((F.col("diversity") <= 1) & (F.col("n") >= entities.MIN_OCCURRENCES)).select("doc_id", "name")
    stats = entities.cooccurrence_stats(entities.cooccurrence(_line_names(spark, d), ["doc_id", "n"], of=lone, tasks=_pair_tasks(spark, d)), c.select("name", "n"), 50)
    behind = lambda k: F.regexp_extract_all("text", F.lit("([A-Z][a-zà-ÿ]+) (the|and|in|of|was)"), F.lit(k))
    ends = table(spark, d, "documents").select(F.explode(F.arrays_zip(behind(1).alias("name"), behind(2).alias("word"))).alias("x")).select("x.*").groupBy("name").agg(F.count_distinct("word").alias("templates"), F.count(F.lit(1)).alias("hits"))
    zero = lambda x: F.coalesce(F.col(x), F.lit(0))
    rows = c.join(stats, "name", "left").join(ends, "name", "left")
    return rows.select("name", "n", entities.rescored(F.lit(0.6), F.col("n"), F.col("diversity"), zero("co_diversity"), zero("high_conf_co"), zero("templates"), zero("hits")).cast("double").alias("confidence"))


_OFFSETS = """m AS (SELECT doc_id, unnest({hits}) AS hit, unnest(range(len({hits}))) AS i, {gaps} AS gaps, {hits} AS hits FROM documents),
p AS (SELECT doc_id, hit AS name, (list_sum(list_transform(gaps[1:i + 1], lambda g: length(g))) + coalesce(list_sum(list_transform(hits[1:i], lambda g: length(g))), 0))::BIGINT AS start FROM m)"""


def _offsets(pattern: str) -> str:
    return _OFFSETS.format(hits=f"regexp_extract_all(text, '{pattern}')", gaps=f"string_split_regex(text, '{pattern}')")


@query("WITH " + _offsets("[0-9]+") + " SELECT doc_id, name, start, start + length(name) AS stop FROM p")
def match_offsets(spark, d):
    rows = table(spark, d, "documents").select("doc_id", F.explode(matches(F.col("text"), "[0-9]+")).alias("m"))
    return rows.select("doc_id", F.col("m.text").alias("name"), F.col("m.start").cast("long").alias("start"), F.col("m.end").cast("long").alias("stop"))


@query("WITH " + _offsets("[A-Z][a-zà-ÿ]+") + ", q AS (SELECT doc_id, s.start AS s, s.start + length(s.name) AS e FROM (WITH " + _offsets("[0-9]+") + " SELECT * FROM p) s) SELECT DISTINCT p.doc_id, p.name, p.start FROM p JOIN q ON p.doc_id = q.doc_id AND q.s <= p.start + length(p.name) + 20 AND q.e >= p.start - 20")
def near_quote_semijoin(spark, d):
    docs = table(spark, d, "documents")
    marks = docs.select("doc_id", F.explode(matches(F.col("text"), "[0-9]+")).alias("m")).select("doc_id", F.col("m.start").alias("start"), F.col("m.end").alias("end"))
    return entities.near_spans(entities.mentions(docs, LATIN, ["doc_id"]), marks, ["doc_id"], 20, 20).select("doc_id", "name", *long("start"))


@query("WITH " + _offsets("[A-Z][a-zà-ÿ]+") + " SELECT doc_id, name, start FROM p WHERE length(name) % 2 = 1")
def span_antijoin(spark, d):
    m = entities.mentions(table(spark, d, "documents"), LATIN, ["doc_id"])
    return quotes.remove_spans(m, m.where(F.length("name") % 2 == 0), ["doc_id"]).select("doc_id", "name", *long("start"))


@query("WITH " + _offsets('"[^"]+"') + """ SELECT doc_id, start, start + length(name) AS stop, substr(name, 2, length(name) - 2) AS quote FROM p WHERE trim(substr(name, 2, length(name) - 2)) <> ''""")
def dialogue_extract(spark, d):
    return quotes.extract_dialogue(table(spark, d, "documents"), LATIN, ["doc_id"]).select("doc_id", *long("start"), F.col("end").cast("long").alias("stop"), "quote")


_FEATURES = """
    (length(sentence) - length(replace(sentence, '!', '')))::BIGINT AS exclaims, (length(sentence) - length(replace(sentence, '?', '')))::BIGINT AS questions,
    len(regexp_extract_all(sentence, '\\.{3,}|…+'))::BIGINT AS ellipses, regexp_matches(sentence, 'damn|cursed|fool') AS dirty, regexp_matches(sentence, 'very|quite|suddenly') AS adverb, regexp_matches(sentence, 'shout|cry|laugh|tremble') AS verb,
    regexp_matches(sentence, '(?i)^(go|come|stop|run)') AS imperative, regexp_matches(sentence, '(?i)how .*[?]|why .*[?]') AS rhetorical, regexp_matches(sentence, '(?i)^(ha|wow|oh)') AS exclamatory,
    len(list_filter(regexp_extract_all(sentence, '[^。！？；.!?;]+'), lambda p: length(regexp_replace(p, '^\\s+|\\s+$', '', 'g')) BETWEEN 1 AND 4)) >= 2 AS short"""


@query(f"WITH s AS ({_SPLIT}) SELECT doc_id, sentence_index, {_FEATURES} FROM s")
def emotion_features(spark, d):
    f = emotion.features(F.col("sentence"), LATIN.emotions)
    names = ("exclaims", "questions", "ellipses", "dirty", "adverb", "verb", "imperative", "rhetorical", "exclamatory", "short")
    return _sentences(spark, d).select("doc_id", *long("sentence_index"), *((f[k].cast("long") if k in names[:3] else f[k]).alias(k) for k in names))


_SCORES = """scored AS (SELECT *, CASE WHEN regexp_matches(t, '(?i)(?:not|never|no) .{0,4}(?:sad|glad|angry)') THEN 0.5 ELSE 1.0 END::DOUBLE AS h FROM f),
raw AS (SELECT *,
  (CASE WHEN dirty THEN 0.5 ELSE 0 END::DOUBLE + CASE WHEN regexp_matches(t, 'erra|ander') THEN 0.4 ELSE 0 END::DOUBLE) * h * CASE WHEN regexp_matches(t, '(?i)no erra') THEN 0.3 ELSE 1 END::DOUBLE AS anger,
  (CASE WHEN regexp_matches(t, '(?i)shre|thwh') THEN 0.4 ELSE 0 END::DOUBLE + CASE WHEN short AND questions >= 1 THEN 0.2 ELSE 0 END::DOUBLE) * h + CASE WHEN regexp_matches(t, '(?i)ghost|tztz') THEN 0.3 ELSE 0 END::DOUBLE AS fear,
  (CASE WHEN regexp_matches(t, '(?i)ou th|leaeed') THEN 0.4 ELSE 0 END::DOUBLE + CASE WHEN ellipses >= 1 THEN 0.2 ELSE 0 END::DOUBLE) * h AS sadness,
  (CASE WHEN regexp_matches(t, '(?i)stion|heit') THEN 0.4 ELSE 0 END::DOUBLE + CASE WHEN exclaims >= 2 AND NOT dirty THEN 0.2 ELSE 0 END::DOUBLE) * h AS surprise,
  (CASE WHEN regexp_matches(t, '(?i)ble|ción') THEN 0.3 ELSE 0 END::DOUBLE + CASE WHEN exclaims * 10 / greatest(1, length(t)) > 0.3 AND NOT dirty THEN 0.2 ELSE 0 END::DOUBLE) * h * CASE WHEN regexp_matches(t, '(?i)not .*ble') THEN 0.3 ELSE 1 END::DOUBLE AS joy,
  least(CASE WHEN suffix(t, '.') AND exclaims = 0 AND questions = 0 THEN 0.2 ELSE 0 END::DOUBLE + CASE WHEN NOT (dirty OR verb OR adverb OR exclamatory OR rhetorical OR imperative) THEN 0.2 ELSE 0 END::DOUBLE, 0.25::DOUBLE) AS neutral FROM scored),
r AS (SELECT *, round(joy, 10) j, round(anger, 10) a, round(sadness, 10) sa, round(surprise, 10) su, round(fear, 10) fe, round(neutral, 10) ne FROM raw),
best AS (SELECT *, greatest(j, a, sa, su, fe, ne) AS b FROM r),
lab AS (SELECT *, CASE WHEN j = b THEN 'joy' WHEN a = b THEN 'anger' WHEN sa = b THEN 'sadness' WHEN su = b THEN 'surprise' WHEN fe = b THEN 'fear' ELSE 'neutral' END AS l FROM best),
arb AS (SELECT *, l = 'anger' AND b >= 0.4 AND regexp_matches(t, '(?i)run|help') AND fe > 0.1 AS flee FROM lab),
dec AS (SELECT *, CASE WHEN flee THEN 'fear' ELSE l END AS l2, CASE WHEN flee THEN greatest(b * 0.8::DOUBLE, fe) ELSE b END AS b2 FROM arb),
fin AS (SELECT *, CASE WHEN length(t) = 0 THEN 'neutral' WHEN b2 <= 0.15 AND length(t) >= 5 AND l2 <> 'neutral' THEN 'unknown' ELSE l2 END AS label, CASE WHEN length(t) = 0 OR (b2 <= 0.15 AND length(t) >= 5 AND l2 <> 'neutral') THEN 0.3::DOUBLE ELSE b2 END AS score FROM dec)"""
_EMOTION = f"WITH s AS ({_SPLIT}), f AS (SELECT doc_id, sentence_index, sentence AS t, {_FEATURES} FROM s), {_SCORES}"


@query(f"""{_EMOTION} SELECT doc_id, sentence_index, label, round(least(score, 0.95), 6)::DOUBLE AS confidence, round(least(score / 0.8, 1.0), 6)::DOUBLE AS intensity,
CASE WHEN label IN ('sadness', 'fear') THEN 'subdued' WHEN label = 'anger' THEN CASE WHEN score / 0.8 >= 0.4 THEN 'excited' ELSE 'subdued' END WHEN label IN ('joy', 'surprise') THEN CASE WHEN score / 0.8 >= 0.4 THEN 'excited' ELSE 'neutral' END ELSE 'neutral' END AS emotion_class FROM fin""")
def emotion_score(spark, d):
    out = emotion.classify(_sentences(spark, d), LATIN)
    return out.select("doc_id", *long("sentence_index"), F.col("emotion_label").alias("label"), F.round("confidence", 6).alias("confidence"), F.round("intensity", 6).alias("intensity"), "emotion_class")


@query(f"{_EMOTION} SELECT doc_id, count(*) AS n_sentences, sum(length(t))::BIGINT AS n_chars, count_if(label = 'joy')::BIGINT AS joy, count_if(label = 'anger')::BIGINT AS anger, count_if(label = 'sadness')::BIGINT AS sadness, count_if(label = 'fear')::BIGINT AS fear, count_if(label = 'surprise')::BIGINT AS surprise, round(avg(least(score, 0.95)), 6)::DOUBLE AS mean_confidence FROM fin GROUP BY doc_id")
def document_moods(spark, d):
    out = emotion.classify(_sentences(spark, d), LATIN)
    moods = (F.count_if(F.col("emotion_label") == e).alias(e) for e in ("joy", "anger", "sadness", "fear", "surprise"))
    return out.groupBy("doc_id").agg(F.count(F.lit(1)).alias("n_sentences"), F.sum(F.length("sentence")).alias("n_chars"), *moods, F.round(F.avg("confidence"), 6).alias("mean_confidence"))


_EMOTIONS = ("joy", "anger", "sadness", "surprise", "fear")
_CARRY = f"""WITH RECURSIVE s AS ({_SPLIT}), f AS (SELECT doc_id, sentence_index, sentence AS t, {_FEATURES} FROM s), {_SCORES},
held AS MATERIALIZED (SELECT doc_id, sentence_index, t, joy, anger, sadness, surprise, fear, neutral FROM raw),
c AS (SELECT doc_id, -1::BIGINT AS i, '' AS label, 0::DOUBLE AS score FROM documents UNION ALL
 SELECT doc_id, i, CASE WHEN l = 0 THEN 'neutral' WHEN s3 <= 0.15 AND l >= 5 AND e3 <> 'neutral' THEN 'unknown' ELSE e3 END, CASE WHEN l = 0 OR (s3 <= 0.15 AND l >= 5 AND e3 <> 'neutral') THEN 0.3::DOUBLE ELSE s3 END FROM
 (SELECT doc_id, i, l, CASE WHEN flee THEN 'fear' ELSE e2 END AS e3, CASE WHEN flee THEN greatest(b * 0.8::DOUBLE, fear) ELSE b END AS s3 FROM
 (SELECT *, e2 = 'anger' AND b >= 0.4 AND fear > 0.1 AND runs AS flee FROM
 (SELECT *, CASE {" ".join(f"WHEN {e} = b THEN '{e}'" for e in _EMOTIONS)} ELSE 'neutral' END AS e2 FROM
 (SELECT *, greatest({", ".join(_EMOTIONS)}, neutral) AS b FROM
 (SELECT c.doc_id, r.sentence_index AS i, length(t) AS l, regexp_matches(t, '(?i)run|help') AS runs, round(least(r.neutral, 1), 10) AS neutral,
  {", ".join(f"round(least(r.{e} + CASE WHEN greatest(r.joy, r.anger, r.sadness, r.surprise, r.fear, r.neutral) <= 0.25 AND c.label = '{e}' AND least(c.score, 0.95) >= 0.3 THEN 0.4::DOUBLE ELSE 0 END, 1), 10) AS {e}" for e in _EMOTIONS)}
  FROM c JOIN held r ON r.doc_id = c.doc_id AND r.sentence_index = c.i + 1))))))
SELECT doc_id, i AS sentence_index, label AS emotion_label, round(least(score, 0.95), 6)::DOUBLE AS confidence FROM c WHERE i >= 0"""


@query(_CARRY)
def emotion_carry(spark, d):
    out = emotion.classify_in_order(_sentences(spark, d), LATIN, ["doc_id"], "sentence_index")
    return out.select("doc_id", *long("sentence_index"), "emotion_label", F.round("confidence", 6).alias("confidence"))


_LEXICON = (("a", "the "), ("a", " of "), ("b", "tion"), ("b", " ing"), ("c", " der "), ("c", "keit"), ("d", " les "))


@query(f"""WITH lex AS (SELECT * FROM (VALUES {', '.join(f"('{a}', '{b}')" for a, b in _LEXICON)}) t(label, word)), v AS (SELECT doc_id, label, count(*) AS n FROM documents JOIN lex ON contains(text, word) GROUP BY doc_id, label)
SELECT doc_id, sum(n)::BIGINT AS n_hits, arg_min(label, -n * 100 + ascii(label)) AS label, max(n) AS votes FROM v GROUP BY doc_id""")
def keyword_vote(spark, d):
    lex = spark.createDataFrame(list(_LEXICON), "label string, word string")
    return emotion.keyword_votes(table(spark, d, "documents"), lex, ["doc_id"], "text")


@query("""WITH w AS (SELECT lang AS label, unnest(regexp_extract_all(text, '[a-z]+')) AS gram FROM documents), p AS (SELECT gram, label, count(*) AS n FROM w GROUP BY gram, label),
t AS (SELECT gram, sum(n)::BIGINT AS total, max(n) AS most, arg_min(label, (-n, label)) AS label FROM p GROUP BY gram) SELECT gram, total, most, label FROM t WHERE total >= 2 AND most / total >= 0.7""")
def keyword_discrimination(spark, d):
    grams = table(spark, d, "documents").select(F.col("lang").alias("label"), F.explode(F.regexp_extract_all("text", F.lit("[a-z]+"), F.lit(0))).alias("gram"))
    return emotion.keyword_discrimination(grams)


@query("""SELECT query_id, id, similarity, rank FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY similarity DESC, id) AS rank FROM
(SELECT a.vec_id AS query_id, b.vec_id AS id, round(list_cosine_similarity(a.embedding::DOUBLE[], b.embedding::DOUBLE[]), 6) AS similarity FROM embeddings a JOIN embeddings b ON a.vec_id % 50 = 0 AND a.vec_id <> b.vec_id)) WHERE rank <= 5""")
def cosine_topk(spark, d):
    e = table(spark, d, "embeddings")
    out = similarity.rank_by_similarity(e.where("vec_id % 50 = 0"), e, "vec_id", "embedding", 5, -1.0)
    return out.select("query_id", "id", F.round("similarity", 6).alias("similarity"), *long("rank"))


@query("""SELECT a.vec_id AS query_id, b.vec_id AS id, round(list_cosine_similarity(a.embedding::DOUBLE[], b.embedding::DOUBLE[]), 6) AS similarity FROM embeddings a JOIN embeddings b ON a.vec_id % 50 = 0 AND a.vec_id <> b.vec_id AND list_cosine_similarity(a.embedding::DOUBLE[], b.embedding::DOUBLE[]) >= 0.3""")
def threshold_rank(spark, d):
    e = table(spark, d, "embeddings")
    out = similarity.rank_by_similarity(e.where("vec_id % 50 = 0"), e, "vec_id", "embedding", threshold=0.3)
    return out.select("query_id", "id", F.round("similarity", 6).alias("similarity"))


@query("SELECT label, dim - 1 AS dim, round(avg(x), 5) AS x FROM (SELECT label, unnest(embedding::DOUBLE[]) AS x, unnest(range(1, 65)) AS dim FROM embeddings) GROUP BY label, dim")
def centroid(spark, d):
    c = similarity.centroids(table(spark, d, "embeddings"), ["label"], "embedding", normalise=False)
    return c.select("label", F.posexplode("centroid").alias("dim", "x")).select("label", *long("dim"), F.round("x", 5).alias("x"))


@query("""WITH c AS (SELECT p_partkey, p_brand, list_distinct(string_split(p_type, '')) AS x, list_distinct(string_split(p_name, '')) AS y FROM part)
SELECT p_partkey, round(len(list_intersect(x, y)) / len(list_distinct(x || y)), 6)::DOUBLE AS overlap FROM c""")
def jaccard_chars(spark, d):
    return table(spark, d, "part").select("p_partkey", F.round(jaccard(char_set(F.col("p_type")), char_set(F.col("p_name"))), 6).alias("overlap"))


@query()
def leader_clusters(spark, d):
    e = table(spark, d, "embeddings").select(F.col("label").alias("project"), F.concat(F.lit("v"), F.col("vec_id").cast("string")).alias("name"), (F.col("vec_id") % 17).alias("n"), F.col("embedding").alias("vector"))
    return similarity.leader_clusters(e, ["project"])


@query(r"""WITH c AS (SELECT doc_id, unnest(string_split(text, '')) AS c, unnest(range(length(text))) AS s FROM documents WHERE text <> ''),
q AS (SELECT doc_id, s, c || coalesce(lead(c, 1) OVER o, '') || coalesce(lead(c, 2) OVER o, '') || coalesce(lead(c, 3) OVER o, '') AS t FROM c WINDOW o AS (PARTITION BY doc_id ORDER BY s)),
w AS (SELECT doc_id, s, CASE WHEN t = 'rere' THEN 'rere' WHEN t[1:3] = 'the' THEN 'the' WHEN t[1:2] IN ('th', 'sh', 're', 'er') THEN t[1:2] END AS word FROM q)
SELECT doc_id, word, count(*) AS n, sum(s)::BIGINT AS sum_start FROM w WHERE word IS NOT NULL GROUP BY doc_id, word""")
def sfx_longest_match(spark, d):
    words = [w for _, ws in LATIN.sounds for w in ws]
    rows = table(spark, d, "documents").select("doc_id", F.explode(sounds.longest_at_starts(F.col("text"), words)).alias("s"))
    return rows.groupBy("doc_id", F.col("s.text").alias("word")).agg(F.count(F.lit(1)).alias("n"), F.sum("s.start").alias("sum_start"))


_GOLD = "g AS (SELECT doc_id, quality::VARCHAR AS gold, CASE WHEN toxic = 1 OR doc_id % 5 = 0 THEN '0' WHEN doc_id % 11 = 0 THEN NULL ELSE '1' END AS predicted FROM labels)"


def _gold(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "labels").select("doc_id", F.col("quality").cast("string").alias("gold"), F.when((F.col("toxic") == 1) | (F.col("doc_id") % 5 == 0), "0").when(F.col("doc_id") % 11 == 0, F.lit(None)).otherwise("1").alias("predicted"))


@query(f"""WITH {_GOLD}, k AS (SELECT gold AS class FROM g UNION SELECT predicted FROM g WHERE predicted IS NOT NULL),
c AS (SELECT class, (SELECT count(*) FROM g WHERE gold = class AND predicted = class) AS correct, (SELECT count(*) FROM g WHERE predicted = class) AS predicted, (SELECT count(*) FROM g WHERE gold = class) AS actual FROM k)
SELECT class, correct, predicted, actual, round(CASE WHEN predicted = 0 THEN 0 ELSE correct / predicted END, 6)::DOUBLE AS precision, round(CASE WHEN actual = 0 THEN 0 ELSE correct / actual END, 6)::DOUBLE AS recall FROM c""")
def prf_by_class(spark, d):
    out = metrics.precision_recall(_gold(spark, d))
    return out.select("class", "correct", "predicted", "actual", F.round("precision", 6).alias("precision"), F.round("recall", 6).alias("recall"))


@query(f"WITH {_GOLD} SELECT gold, count_if(predicted = '0')::BIGINT AS p0, count_if(predicted = '1')::BIGINT AS p1 FROM g GROUP BY gold")
def confusion_pivot(spark, d):
    return metrics.confusion(_gold(spark, d), ["0", "1"]).select("gold", F.col("0").alias("p0"), F.col("1").alias("p1"))


@query(f"WITH {_GOLD} SELECT s.source, CASE WHEN grouping(s.lang) = 1 THEN NULL ELSE s.lang END AS lang, count(*) AS total, count_if(gold = predicted)::BIGINT AS correct FROM g JOIN documents s USING (doc_id) GROUP BY GROUPING SETS ((s.source), (s.lang), ())")
def accuracy_rollup(spark, d):
    rows = _gold(spark, d).join(table(spark, d, "documents").select("doc_id", "source", "lang"), "doc_id")
    return metrics.rolled_up(rows, [["source"], ["lang"], []]).select("source", "lang", "total", "correct")


@query(f"WITH {_GOLD}, a AS (SELECT doc_id, gold = predicted AS was FROM g WHERE predicted IS NOT NULL AND doc_id % 3 <> 0), b AS (SELECT doc_id, doc_id % 4 <> 0 AS now FROM labels WHERE doc_id % 7 <> 0) SELECT doc_id, change FROM (SELECT coalesce(a.doc_id, b.doc_id) AS doc_id, CASE WHEN was IS NULL THEN 'added' WHEN now IS NULL THEN 'removed' WHEN was AND NOT now THEN 'broken' WHEN NOT was AND now THEN 'fixed' END AS change FROM a FULL JOIN b ON a.doc_id = b.doc_id) WHERE change IS NOT NULL")
def baseline_diff(spark, d):
    a = _gold(spark, d).where("predicted is not null and doc_id % 3 <> 0").select("doc_id", (F.col("gold") == F.col("predicted")).alias("correct"))
    b = table(spark, d, "labels").where("doc_id % 7 <> 0").select("doc_id", (F.col("doc_id") % 4 != 0).alias("correct"))
    return metrics.run_diff(a, b, "doc_id").select("doc_id", "change")


@query("SELECT event_type, count(value) AS runs, round(avg(value), 4) AS mean, round(median(value), 4) AS median, round(min(value), 4) AS least, round(max(value), 4) AS most, round(stddev_samp(value), 4) AS deviation FROM events GROUP BY event_type")
def run_stats(spark, d):
    out = metrics.run_stats(table(spark, d, "events"), ["event_type"], "value")
    return out.select("event_type", "runs", *(F.round(c, 4).alias(c) for c in ("mean", "median", "least", "most", "deviation")))


@query("""WITH g AS (SELECT x.x AS low, y.y AS bonus FROM (VALUES (0.2::DOUBLE), (0.4), (0.6)) x(x), (VALUES (0.0::DOUBLE), (0.1), (0.3)) y(y)), r AS (SELECT low, bonus, quality = (CASE WHEN (doc_id % 10) / 10.0::DOUBLE + bonus >= low THEN 1 ELSE 0 END) AS ok FROM labels, g)
SELECT low, bonus, count(*) AS total, count_if(ok)::BIGINT AS correct, round(count_if(ok) / count(*), 6) AS accuracy FROM r GROUP BY low, bonus ORDER BY accuracy DESC, low, bonus LIMIT 5""")
def grid_search_top(spark, d):
    rule = F.when((F.col("doc_id") % 10) / F.lit(10.0) + F.col("bonus") >= F.col("low"), 1).otherwise(0)
    out = metrics.grid_search(table(spark, d, "labels"), {"low": [0.2, 0.4, 0.6], "bonus": [0.0, 0.1, 0.3]}, rule, "quality", 5)
    return out.select("low", "bonus", "total", "correct", F.round("accuracy", 6).alias("accuracy"))


@query(f"WITH {_GOLD} SELECT lang, count(*) AS cases, count_if(predicted IS NULL OR gold <> predicted)::BIGINT AS errors, round(count_if(predicted IS NULL OR gold <> predicted) / count(*), 6) AS error_rate FROM g JOIN documents USING (doc_id) GROUP BY lang")
def error_breakdown(spark, d):
    rows = _gold(spark, d).join(table(spark, d, "documents").select("doc_id", "lang"), "doc_id")
    return metrics.error_breakdown(rows, ["lang"]).select("lang", "cases", "errors", F.round("error_rate", 6).alias("error_rate"))


@query(f"WITH {_GOLD} SELECT count(*) AS shared, count_if(gold = predicted)::BIGINT AS equal, round(count_if(gold = predicted) / count(*), 6) AS rate FROM g")
def annotation_agreement(spark, d):
    g = _gold(spark, d)
    out = metrics.agreement(g.select("doc_id", F.col("gold").alias("l")), g.select("doc_id", F.col("predicted").alias("l")), "doc_id", "l")
    return out.select("shared", "equal", F.round("rate", 6).alias("rate"))


@query("SELECT conv_id, turn, (sum(length(text)) OVER (PARTITION BY conv_id ORDER BY turn) - length(text))::BIGINT AS start_time, (sum(length(text)) OVER (PARTITION BY conv_id ORDER BY turn))::BIGINT AS end_time FROM conversations")
def timeline_offsets(spark, d):
    return voices.timeline(table(spark, d, "conversations"), ["conv_id"], "turn", F.length("text")).select("conv_id", "turn", *long("start_time", "end_time"))


@query("""SELECT conv_id, turn, CASE WHEN role = 'system' THEN 'narrator' ELSE role END AS speaker, CASE role WHEN 'user' THEN 'v1' ELSE 'v0' END AS voice, CASE WHEN role = 'system' THEN 'neutral' ELSE 'joy' END AS emotion, CASE WHEN role = 'system' THEN 'calm' ELSE 'bright' END AS prompt FROM conversations""")
def voice_jobs(spark, d):
    t = table(spark, d, "conversations").select("conv_id", "turn", F.col("role").alias("speaker"), F.when(F.col("role") == "system", "narration").otherwise("dialogue").alias("type"), F.lit("joy").alias("emotion"))
    cast = spark.createDataFrame([("user", "v1")], "speaker string, voice string")
    return voices.job_plan(t, cast, "v0", {"neutral": "calm", "joy": "bright"}).select("conv_id", "turn", "speaker", "voice", "emotion", "prompt")


@query("SELECT conv_id, '<p><!-- ' || conv_id::VARCHAR || ' -->' || string_agg('<s>' || text || '</s>', '' ORDER BY turn) || '</p>' AS ssml FROM conversations GROUP BY conv_id")
def export_ssml(spark, d):
    return stores.chapters_ssml(table(spark, d, "conversations"), ["conv_id"], "turn", "text", F.col("conv_id").cast("string"))


@query()
def export_json_rows(spark, d):
    return stores.chapters_json(table(spark, d, "conversations"), ["conv_id"], "turn", ["turn", "role", "text"])


_STEPS = ("click", "login", "logout", "purchase", "view")


@query("SELECT user_id, " + ", ".join(f"round(arg_max(value, (ts, event_id)) FILTER (event_type = '{s}'), 6) AS {s}" for s in _STEPS) + " FROM events GROUP BY user_id")
def progress_pivot(spark, d):
    out = lib.progress_pivot(table(spark, d, "events"), "user_id", "event_type", "value", list(_STEPS), ["ts", "event_id"])
    return out.select("user_id", *(F.round(s, 6).alias(s) for s in _STEPS))


@query("SELECT c_nationkey, c_custkey, rank FROM (SELECT c_nationkey, c_custkey, row_number() OVER (PARTITION BY c_nationkey ORDER BY c_acctbal > 0 DESC, c_custkey DESC) AS rank FROM customer) WHERE rank <= 6")
def candidate_list(spark, d):
    c = table(spark, d, "customer").select(F.col("c_nationkey").alias("project"), F.col("c_custkey").alias("id"), (F.col("c_acctbal") > 0).alias("is_persisted"), F.col("c_custkey").alias("first_appearance"))
    return lib.candidates(c).select(F.col("project").alias("c_nationkey"), F.col("id").alias("c_custkey"), *long("rank"))


@query("""WITH w AS (SELECT conv_id, turn, role, CASE WHEN lag(role) OVER (PARTITION BY conv_id ORDER BY turn) = role THEN 0 ELSE 1 END AS c FROM conversations), i AS (SELECT *, sum(c) OVER (PARTITION BY conv_id ORDER BY turn) AS island FROM w)
SELECT conv_id, role, min(turn) AS first, count(*) AS n_tokens, string_agg(turn::VARCHAR, '' ORDER BY turn) AS entity FROM i GROUP BY conv_id, island, role""")
def merge_runs(spark, d):
    t = table(spark, d, "conversations").select("conv_id", "turn", F.col("turn").cast("string").alias("token"), F.col("role").alias("type"))
    return entities.merge_runs(t, ["conv_id"], "turn").select("conv_id", F.col("type").alias("role"), "first", "n_tokens", "entity")


@query("""SELECT conv_id, turn, coalesce((SELECT r FROM (SELECT DISTINCT role AS r FROM conversations) q WHERE contains(c.text, q.r) ORDER BY length(r) DESC, r DESC LIMIT 1), CASE WHEN conv_id % 2 = 0 THEN '' ELSE role END) AS speaker FROM conversations c WHERE conv_id % 2 = 0 UNION ALL SELECT conv_id, turn, role FROM conversations WHERE conv_id % 2 <> 0""")
def backfill_speakers(spark, d):
    t = table(spark, d, "conversations").select("conv_id", "turn", F.when(F.col("conv_id") % 2 == 0, F.lit("")).otherwise(F.col("role")).alias("speaker"), F.col("text").alias("sentence"))
    names = _roles(spark, d)
    return speakers.backfill_unknown(t, names, []).select("conv_id", "turn", "speaker")


@query("""SELECT word, CASE WHEN word IN ('th', 'the', 'sh') THEN 'soft' WHEN word IN ('re', 'rere', 'er') THEN 'hard' ELSE 'other' END AS type FROM (SELECT DISTINCT unnest(regexp_extract_all(text, '[a-z]+')) AS word FROM documents)""")
def sound_types(spark, d):
    words = table(spark, d, "documents").select(F.explode(F.regexp_extract_all("text", F.lit("[a-z]+"), F.lit(0))).alias("word")).distinct()
    return words.select("word", sounds.sound_type(F.col("word"), LATIN).alias("type"))


@query("SELECT word FROM (SELECT DISTINCT n_name AS word FROM nation UNION SELECT r_name FROM region) WHERE word NOT IN (SELECT n_name FROM nation WHERE n_nationkey % 3 = 0)")
def word_set(spark, d):
    n = table(spark, d, "nation")
    words = lib.insert_ignore(n.select(F.col("n_name").alias("word")).distinct(), table(spark, d, "region").select(F.col("r_name").alias("word")), ["word"])
    return lib.delete_rows(words, n.where("n_nationkey % 3 = 0").select(F.col("n_name").alias("word")), ["word"])


from loomspark.plans import analysis_queries, name_queries, tagger_queries, text_queries, turn_queries  # noqa: E402, F401  (they add their queries to QUERIES and SQL)
