"""Registered queries on speakers: the ordered fold of turns, titles and suffixes."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from loomspark.operators import matching, nearby, turns
from loomspark.plans.queries import query, table

_WORDS = turns.TurnWords(
    pronouns={"to": "male", "by": "female", "des": "neutral"}, unknown=(), titles=("That", "bleed"), actions=("ing ", "tion"), addresses=("zu", "wh", "que"),
    verbs="sz", sentence_ends=".!?\n", before_objects=" ", object_verbs="", introductions="was ([A-Z][a-z]+)",
)
_PEOPLE = [(1, "The", ["der", "que"], "male"), (2, "Of", ["de"], "female"), (3, "And", ["zu"], "male"), (4, "In", ["wh"], "female"), (5, "To", [], "male"), (6, "Is", [], "female"), (7, "De", ["la"], "neutral"), (8, "Der", [], "female"), (9, "It", [], None), (10, "That", [], "male")]
_ALL = "|".join(p[1] for p in _PEOPLE)
_P = "[" + ", ".join(f"'{p[1]}'" for p in _PEOPLE) + "]"
_G = "[" + ", ".join(f"'{p[3]}'" if p[3] else "NULL" for p in _PEOPLE) + "]"

_BONUS = r"CASE WHEN coalesce(before, '') = '' THEN 0 WHEN regexp_matches(before, y || '[^sz]{0,10}[sz]') OR len(list_filter(string_split_regex(before, '[.!?\n]'), lambda z: starts_with(regexp_replace(z, '^\s+', ''), y))) > 0 THEN 0.15 WHEN contains(before, ' ' || y) THEN -0.10 ELSE 0 END::DOUBLE"
_I = f"list_position({_P}, y)"
_SAME = f"coalesce({_G}[{_I}] = g, false)"
_W = f"(ws[{_I}] * exp(-0.05 * (n - ats[{_I}])))"

_TURNS = rf"""WITH RECURSIVE x AS (SELECT conv_id, turn, coalesce(text, '') AS text, lag(text) OVER w AS before, row_number() OVER w AS k, nullif(regexp_extract(text, ' (to|by|des|De|The) ', 1), '') AS hint, contains(text, ' der ') AS der,
  nullif(regexp_extract(text, 'was ([A-Z][a-z]+)', 1), '') AS told, list_sort(list_distinct(regexp_extract_all(coalesce(text, ''), '({_ALL}) [a-m]', 1))) AS mentioned FROM conversations WINDOW w AS (PARTITION BY conv_id ORDER BY turn)),
r AS (SELECT DISTINCT conv_id, 0::BIGINT AS k, NULL::BIGINT AS turn, []::VARCHAR[] AS ms, []::VARCHAR[] AS recent, list_transform(range(10), lambda i: 0::DOUBLE) AS ws, list_transform(range(10), lambda i: 0::BIGINT) AS ats, 0::BIGINT AS n, NULL::VARCHAR AS prev, NULL::VARCHAR AS speaker, 0::DOUBLE AS confidence, '' AS how FROM conversations
UNION ALL SELECT conv_id, k, turn, ms, CASE WHEN won IS NULL OR list_contains(recent, won) THEN recent ELSE list_append(recent, won)[-10:] END,
  CASE WHEN won IS NULL THEN ws ELSE list_transform(ws, lambda w, i: CASE WHEN {_P}[i] = won THEN w * exp(-0.05 * (n + 1 - ats[i])) + 1 ELSE w END) END, CASE WHEN won IS NULL THEN ats ELSE list_transform(ats, lambda t, i: CASE WHEN {_P}[i] = won THEN n + 1 ELSE t END) END,
  CASE WHEN won IS NULL THEN n ELSE n + 1 END, coalesce(won, prev), won, CASE WHEN won IS NULL THEN 0 ELSE top.s END, CASE WHEN won IS NULL THEN 'none' ELSE top.how END
FROM (SELECT *, CASE WHEN top.n = 'der' THEN 'The' WHEN list_contains({_P}, top.n) THEN top.n END AS won
FROM (SELECT *, list_sort(list_transform(list_filter(list_filter(cs, lambda c, i: list_position(list_transform(cs, lambda d: d.n), c.n) = i), lambda c: c.n NOT IN ('to', 'by', 'des')), lambda c: {{'o': -c.s, 'p': c.p, 'n': c.n, 's': c.s, 'how': c.how}}))[1] AS top
FROM (SELECT *, list_filter(list_transform([{{'n': CASE WHEN der THEN 'der' END, 's': 0.72::DOUBLE, 'how': 'option'}}, {{'n': CASE WHEN list_contains({_P}, told) THEN told END, 's': 0.9::DOUBLE, 'how': 'introduction'}},
    CASE WHEN hint IS NULL OR (der AND hint = 'der') OR hint = CASE WHEN list_contains({_P}, told) THEN told ELSE '' END THEN NULL WHEN g IS NOT NULL THEN coalesce(near, said, older, active) WHEN list_contains({_P}, hint) THEN {{'n': hint, 's': 1::DOUBLE, 'how': 'hint'}} END]
    || list_transform(list_filter(mentioned, lambda y: length(y) >= 2), lambda y: {{'n': y, 's': 0.75::DOUBLE, 'how': 'mention'}})
    || [{{'n': addr.n, 's': least(-addr.c, 0.6), 'how': 'address'}}, CASE WHEN contains(text, 'That') THEN {{'n': 'That', 's': 0.8::DOUBLE, 'how': 'title'}} WHEN acts THEN {{'n': prev, 's': 0.65::DOUBLE, 'how': 'action'}} WHEN len(t1) = 1 THEN {{'n': t1[1], 's': 0.7::DOUBLE, 'how': 'address_turn'}} WHEN len(t2) = 1 THEN {{'n': t2[1], 's': 0.7::DOUBLE, 'how': 'address_turn'}} WHEN len(t3) = 1 THEN {{'n': t3[1], 's': 0.7::DOUBLE, 'how': 'address_turn'}} END],
    lambda c, i: {{'n': c.n, 's': c.s, 'how': c.how, 'p': i}}), lambda c: c.n IS NOT NULL) AS cs
FROM (SELECT *, list_transform(list_filter(pool, lambda c: c.s = list_max(list_transform(pool, lambda d: d.s)))[1:1], lambda c: {{'n': c.n, 's': least(0.85 + c.s * 0.1, 0.95), 'how': 'pronoun_local_window'}})[1] AS near,
    CASE WHEN {_SAME.replace('y)', 'prev)')} THEN {{'n': prev, 's': 0.8::DOUBLE, 'how': 'pronoun_last_speaker'}} END AS said,
    list_transform(list_filter(list_reverse(ms), lambda y: {_SAME})[1:1], lambda y: {{'n': y, 's': 0.7::DOUBLE, 'how': 'pronoun_mention'}})[1] AS older,
    list_transform(list_sort(list_transform(list_filter({_P}, lambda y: {_SAME}), lambda y: {{'w': -{_W}, 'i': {_I}, 'n': y}}))[1:1], lambda c: {{'n': c.n, 's': 0.4::DOUBLE, 'how': 'pronoun_activity'}})[1] AS active,
    list_sort(list_transform(CASE WHEN called IS NULL THEN [] ELSE list_transform(list_filter({_P}, lambda y: y <> called), lambda y: {{'c': -(0.6 + {_W} * 0.05), 'w': -{_W}, 'n': y}}) END
      || list_transform(list_filter(list_reverse(ms[-5:]), lambda y: y <> coalesce(called, '')), lambda y: {{'c': -(0.5 + {_W} * 0.03), 'w': -{_W}, 'n': y}})
      || list_transform(list_filter([prev], lambda y: y <> coalesce(called, '')), lambda y: {{'c': -0.4::DOUBLE, 'w': -{_W}, 'n': y}}), lambda c, i: {{'c': c.c, 'w': c.w, 'i': i, 'n': c.n}}))[1] AS addr
FROM (SELECT *, list_transform(list_filter(list_reverse(recent), lambda y: {_SAME}), lambda y: {{'n': y, 's': 1 - (list_position(list_reverse(recent), y) - 1) / len(recent) + least(ws[{_I}] * 0.05, 0.2) + {_BONUS}}})
    || list_transform(list_filter(list_reverse(ms[-10:]), lambda y: {_SAME} AND NOT list_contains(recent, y)), lambda y: {{'n': y, 's': 1 - (list_position(list_reverse(ms[-10:]), y) - 1) / len(ms[-10:]) + least(ws[{_I}] * 0.03, 0.1) - 0.1 + {_BONUS}}}) AS pool,
    CASE WHEN contains(text, 'zu') THEN 'And' WHEN contains(text, 'wh') THEN 'In' WHEN contains(text, 'que') THEN 'The' END AS called,
    coalesce(instr(text, prev) > 0 AND regexp_matches(text[greatest(instr(text, prev) - 20, 1):instr(text, prev) - 1 + length(prev) + 20], 'ing |tion'), false) AS acts,
    CASE WHEN contains(text, 'zu') THEN list_filter(recent[-3:], lambda y: y <> 'And') ELSE [] END AS t1, CASE WHEN contains(text, 'wh') THEN list_filter(recent[-3:], lambda y: y <> 'In') ELSE [] END AS t2, CASE WHEN contains(text, 'que') THEN list_filter(recent[-3:], lambda y: y <> 'The') ELSE [] END AS t3
FROM (SELECT x.*, r.recent, r.ws, r.ats, r.n, r.prev, CASE x.hint WHEN 'to' THEN 'male' WHEN 'by' THEN 'female' WHEN 'des' THEN 'neutral' END AS g, (r.ms || list_filter(x.mentioned, lambda y: NOT list_contains(r.ms, y)))[-20:] AS ms FROM r JOIN x ON x.conv_id = r.conv_id AND x.k = r.k + 1))))))
)
SELECT conv_id, turn, speaker, round(confidence, 6)::DOUBLE AS confidence, how FROM r WHERE k > 0"""


@query(_TURNS)
def turn_speakers(spark, d):
    """Conversations as chapters, frequent words as people."""
    w = Window.partitionBy("conv_id").orderBy("turn")
    rows = table(spark, d, "conversations").select("conv_id", "turn", "text", F.lag("text").over(w).alias("before"))
    hint, mentioned = F.regexp_extract("text", " (to|by|des|De|The) ", 1), F.regexp_extract_all("text", F.lit(f"({_ALL}) [a-m]"), F.lit(1))
    option = F.array(F.struct(F.lit("der").alias("name"), F.lit(0.72).alias("confidence")))
    rows = rows.withColumns({"hint": F.when(hint != "", hint), "options": F.when(F.contains("text", F.lit(" der ")), option), "mentioned": F.sort_array(F.array_distinct(mentioned))})
    people = spark.createDataFrame(_PEOPLE, "id long, name string, aliases array<string>, gender string")
    out = turns.resolve_turns(rows, people, ["conv_id"], "turn", _WORDS)
    return out.select("conv_id", "turn", "speaker", F.round("confidence", 6).alias("confidence"), "how")


_CORE = ("IA", "NIA", "AN", "RAN", "ND", "UNITED")
_WANTED = """library AS (SELECT n_regionkey AS project, n_nationkey AS id, n_name AS name, [lower(n_name), n_name[1:3]] AS aliases FROM nation),
w AS (SELECT c_custkey, n_regionkey AS project, CASE c_custkey % 9 WHEN 0 THEN n_name WHEN 1 THEN lower(n_name) WHEN 2 THEN right(n_name, 3) WHEN 3 THEN 'Old' || n_name WHEN 4 THEN 'Xy' || right(n_name, 3) WHEN 5 THEN 'Q' || right(n_name, 2) WHEN 6 THEN right(n_name, 1) WHEN 7 THEN 'nobody' END AS key FROM customer JOIN nation ON c_nationkey = n_nationkey)"""



def _wanted(spark, d):
    n = table(spark, d, "nation")
    kind, name = F.col("c_custkey") % 9, F.col("n_name")
    right = lambda k: F.expr(f"right(n_name, {k})")
    key = F.when(kind == 0, name).when(kind == 1, F.lower(name)).when(kind == 2, right(3)).when(kind == 3, F.concat(F.lit("Old"), name)).when(kind == 4, F.concat(F.lit("Xy"), right(3))).when(kind == 5, F.concat(F.lit("Q"), right(2))).when(kind == 6, right(1)).when(kind == 7, "nobody")
    rows = table(spark, d, "customer").join(n, F.col("c_nationkey") == F.col("n_nationkey")).select("c_custkey", F.col("n_regionkey").cast("long").alias("project"), key.alias("key"))
    library = n.select(F.col("n_regionkey").cast("long").alias("project"), F.col("n_nationkey").cast("long").alias("id"), name.alias("name"), F.array(F.lower(name), F.substring(name, 1, 3)).alias("aliases"))
    return rows, library


@query(f"""WITH {_WANTED}, k AS (SELECT DISTINCT project, key FROM w WHERE key IS NOT NULL),
m AS (SELECT k.*, (SELECT min(id) FROM library l WHERE l.project = k.project AND l.name = k.key) AS a, (SELECT min(id) FROM library l WHERE l.project = k.project AND list_contains(l.aliases, k.key)) AS b,
  (SELECT CASE WHEN count(*) = 1 THEN min(id) END FROM library l WHERE l.project = k.project AND (suffix(l.name, k.key) OR list_contains(l.aliases, k.key))) AS c FROM k),
g AS (SELECT project, key, coalesce(a, b, c) AS id, CASE WHEN a IS NOT NULL THEN 'name' WHEN b IS NOT NULL THEN 'alias' WHEN c IS NOT NULL THEN 'title' END AS how FROM m)
SELECT c_custkey, w.project::BIGINT AS project, w.key, g.id::BIGINT AS id, n_name AS standard_name, CASE how WHEN 'name' THEN 1.0 WHEN 'alias' THEN 0.9 WHEN 'title' THEN 0.85 END::DOUBLE AS confidence, how FROM w LEFT JOIN g ON w.project = g.project AND w.key = g.key LEFT JOIN nation ON n_nationkey = g.id""")
def title_match(spark, d):
    """M11."""
    rows, library = _wanted(spark, d)
    return matching.match_titles(rows, library, ["project"]).select("c_custkey", "project", "key", "id", "standard_name", "confidence", "how")


@query(f"""WITH {_WANTED}, k AS (SELECT DISTINCT project, key FROM w WHERE key IS NOT NULL),
cw AS (SELECT unnest({list(_CORE)}) AS word), hit AS (SELECT k.project, k.key, word, coalesce((SELECT min(id) FROM library l WHERE l.project = k.project AND l.name = word), (SELECT min(id) FROM library l WHERE l.project = k.project AND contains(l.name, word))) AS id FROM k, cw WHERE suffix(key, word) AND length(key) > length(word)),
best AS (SELECT * FROM hit WHERE id IS NOT NULL QUALIFY row_number() OVER (PARTITION BY project, key ORDER BY length(word) DESC, word) = 1),
m AS (SELECT k.*, (SELECT min(id) FROM library l WHERE l.project = k.project AND l.name = k.key) AS a, (SELECT min(id) FROM library l WHERE l.project = k.project AND list_contains(l.aliases, k.key)) AS b,
  (SELECT min(id) FROM library l WHERE l.project = k.project AND length(k.key) >= 4 AND length(l.name) >= 2 AND length(k.key) > length(l.name) AND suffix(k.key, l.name)) AS c FROM k),
g AS (SELECT m.project, m.key, coalesce(a, b, c, best.id) AS id, CASE WHEN a IS NOT NULL THEN 'name' WHEN b IS NOT NULL THEN 'alias' WHEN c IS NOT NULL THEN 'suffix' WHEN best.id IS NOT NULL THEN 'core' END AS how FROM m LEFT JOIN best ON m.project = best.project AND m.key = best.key)
SELECT c_custkey, w.project::BIGINT AS project, w.key, g.id::BIGINT AS id, n_name AS standard_name, CASE how WHEN 'name' THEN 1.0 WHEN 'alias' THEN 0.9 WHEN 'suffix' THEN 0.85 WHEN 'core' THEN 0.85 END::DOUBLE AS confidence, how FROM w LEFT JOIN g ON w.project = g.project AND w.key = g.key LEFT JOIN nation ON n_nationkey = g.id""")
def candidate_match(spark, d):
    """M22."""
    rows, library = _wanted(spark, d)
    return matching.match_candidates(rows, library, ["project"], _CORE).select("c_custkey", "project", "key", "id", "standard_name", "confidence", "how")


_VERBS = ("sh", "ing", "st")
_TWO = [(p[0] % 2, *p[:3]) for p in _PEOPLE]
_TWO_SQL = ", ".join(f"({p}, {i}, '{n}', {a}::VARCHAR[])" for p, i, n, a in _TWO)


@query(f"""WITH p(project, id, name, aliases) AS (VALUES {_TWO_SQL}), c AS (SELECT conv_id, turn, text, conv_id % 2 AS project FROM conversations),
k AS (SELECT conv_id, turn, p.project, id, name, contains(text, name) AND regexp_matches(text[greatest(instr(text, name) - 20, 1):instr(text, name) - 1 + length(name) + 20], 'sh|ing|st') AS acts FROM c JOIN p ON c.project = p.project AND (contains(text, name) OR len(list_filter(aliases, lambda a: contains(text, a))) > 0))
SELECT project::BIGINT AS project, conv_id, turn, id::BIGINT AS id, name, acts FROM k QUALIFY row_number() OVER (PARTITION BY conv_id, turn ORDER BY acts DESC, id) = 1""")
def library_narration(spark, d):
    """Turns as narration, two libraries."""
    rows = table(spark, d, "conversations").withColumn("project", (F.col("conv_id") % 2).cast("long"))
    people = spark.createDataFrame(_TWO, "project long, id long, name string, aliases array<string>")
    return nearby.library_in_narration(rows, people, ["project"], ["conv_id", "turn"], _VERBS).select("project", "conv_id", "turn", "id", "name", "acts")


_PLACES = r"""ch AS (SELECT {ids}, text, unnest(range(length(text))) AS s FROM {table} WHERE text <> ''),
v AS (SELECT {ids}, s, verb FROM ch, (SELECT unnest(['said', 'th', 'ver', 'ou']) AS verb) WHERE text[s + 1:s + length(verb)] = verb)"""


@query(f"""WITH {_PLACES.format(ids='conv_id, turn', table='conversations')},
n AS (SELECT conv_id, turn, unnest(regexp_extract_all(text, '[A-Z][a-zà-ÿ]+')) AS name, text FROM conversations), d AS (SELECT DISTINCT * FROM n),
o AS (SELECT conv_id, turn, name, unnest(list_filter(range(length(text)), lambda s: text[s + 1:s + length(name)] = name)) + length(name) AS stop FROM d),
j AS (SELECT v.conv_id, v.turn, verb, s, name, s - stop AS gap, row_number() OVER (PARTITION BY v.conv_id, v.turn, verb, s ORDER BY stop DESC, length(name) DESC, name DESC) AS k FROM v LEFT JOIN o ON v.conv_id = o.conv_id AND v.turn = o.turn AND stop <= s AND stop >= s - 20)
SELECT conv_id, turn, verb, s::BIGINT AS start, name, gap::BIGINT AS gap FROM j WHERE k = 1""")
def nearest_speakers(spark, d):
    """The name before each verb."""
    docs = table(spark, d, "conversations")
    names = docs.select("conv_id", "turn", F.explode(F.regexp_extract_all("text", F.lit("[A-Z][a-zà-ÿ]+"), F.lit(0))).alias("name"))
    out = nearby.nearest_names(docs, names, ("said", "th", "ver", "ou"), ["conv_id", "turn"])
    return out.select("conv_id", "turn", "verb", F.col("start").cast("long").alias("start"), "name", F.col("gap").cast("long").alias("gap"))
