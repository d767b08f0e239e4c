"""Registered queries on names found by rules: foreign names in tokens, names from surnames, one-pass dictionaries."""

from __future__ import annotations

from pyspark.sql import functions as F

from loomspark.functions.dictionary import name_hits
from loomspark.operators import entities, name_rules, tagged
from loomspark.packs import LATIN
from loomspark.plans.queries import _EACH, _NAMES, _mentions, _offsets, long, query, table
from loomspark.sources.tables import bounded, spread

_LETTERS = "A-Za-zÀ-Ýà-ÿ"
_TOKENS = f"[{_LETTERS}]+|[^{_LETTERS}]"
_RULES = name_rules.NameRules(surnames=("er", "on", "an", "en", "es", "or"), foreign_titles=("the", "of", "st"), name_joints=("·", "-", ".", "/", ","), name_links=("and", "with", "ed"))


def _in(words: tuple[str, ...]) -> str:
    return "(" + ", ".join(f"'{w}'" for w in words) + ")"


def _known(c: str) -> str:
    return f"{c} IN {_in(_RULES.surnames)}"


@query(rf"""WITH RECURSIVE t AS (SELECT conv_id, turn, regexp_extract_all(text, '{_TOKENS}') AS ts FROM conversations WHERE text IS NOT NULL),
e AS (SELECT conv_id, turn, unnest(ts) AS t, unnest(range(len(ts))) AS i FROM t UNION ALL SELECT conv_id, turn, '', len(ts) FROM t),
k AS (SELECT *, regexp_matches(t, '^[aeoAEO]') AS name FROM e),
x AS (SELECT *, coalesce(lead(name) OVER w, false) AS next_name, coalesce(lead(t) OVER w, '') AS nt, (sum(length(t)) OVER w - length(t))::BIGINT AS at FROM k WINDOW w AS (PARTITION BY conv_id, turn ORDER BY i)),
c AS (SELECT *, CASE WHEN name THEN CASE WHEN {_known('t')} THEN 'stop' ELSE 'part' END
  WHEN t IN {_in(_RULES.name_joints)} THEN CASE WHEN next_name THEN 'joint' ELSE 'stop' END
  WHEN t = ' ' THEN CASE WHEN next_name AND NOT {_known('nt')} THEN 'joint' ELSE 'stop' END
  WHEN t IN {_in(_RULES.foreign_titles)} THEN 'title'
  WHEN t IN {_in(_RULES.name_links)} AND next_name AND NOT {_known('nt')} THEN 'pass' ELSE 'stop' END AS what FROM x),
r AS (SELECT conv_id, turn, -1 AS i, 0 AS parts, '' AS said, 0 AS first, 0::BIGINT AS at0, 0::BIGINT AS at1, NULL::VARCHAR AS done, 0 AS until FROM t
  UNION ALL SELECT r.conv_id, r.turn, c.i,
    CASE WHEN parts = 0 THEN CASE WHEN what = 'part' THEN 1 ELSE 0 END WHEN what IN ('part', 'title') THEN parts + 1 WHEN what = 'stop' THEN 0 ELSE parts END,
    CASE WHEN what = 'stop' THEN '' WHEN parts = 0 THEN CASE WHEN what = 'part' THEN t ELSE '' END WHEN what = 'pass' THEN said ELSE said || t END,
    CASE WHEN parts = 0 THEN c.i ELSE first END, CASE WHEN parts = 0 THEN c.at ELSE at0 END, c.at,
    CASE WHEN what = 'stop' AND parts > 1 THEN said END, CASE WHEN parts = 0 THEN 0 ELSE first END
  FROM r JOIN c ON r.conv_id = c.conv_id AND r.turn = c.turn AND c.i = r.i + 1)
SELECT r.conv_id, r.turn, done AS name, until::BIGINT AS first_token, r.i::BIGINT AS end_token, f.at AS start, at1 AS stop FROM r JOIN x f ON f.conv_id = r.conv_id AND f.turn = r.turn AND f.i = until WHERE done IS NOT NULL""")
def foreign_names(spark, d):
    """N4 on tokens of turns; words that begin with a, e or o stand for the tagger's names."""
    rows = bounded(spread(table(spark, d, "conversations"))).select("conv_id", "turn", F.regexp_extract_all("text", F.lit(_TOKENS), F.lit(0)).alias("tokens"))
    rows = rows.withColumn("tags", F.transform("tokens", lambda t: F.when(t.rlike("^[aeoAEO]"), F.lit("NR")).otherwise(F.lit("X"))))
    found = rows.select("conv_id", "turn", "tokens", F.explode(name_rules.foreign_names(F.col("tokens"), F.col("tags"), _RULES)).alias("e"))
    at = lambda i: F.length(F.array_join(F.slice("tokens", F.lit(1), i), "")).cast("long")
    return found.select("conv_id", "turn", F.col("e.text").alias("name"), F.col("e.start").cast("long").alias("first_token"), F.col("e.end").cast("long").alias("end_token"), at(F.col("e.start")).alias("start"), at(F.col("e.end")).alias("stop"))


_SURNAMES = name_rules.NameRules(surnames=("T", "A", "E", "O", "L", "Th", "An"), letter="[a-zà-ÿ]", not_in_names="xqzjkñ", not_given="wv", verb_endings="tn", no_persons=("The", "And", "Thes"))


def _spans(pattern: str) -> str:
    return f"(WITH {_offsets(pattern)} SELECT doc_id, name, start FROM p)"


@query(rf"""WITH f AS (SELECT * FROM {_spans('[AELOT][a-zà-ÿ]{1,3}')} UNION ALL SELECT * FROM {_spans('An[a-zà-ÿ]{1,2}')} UNION ALL SELECT * FROM {_spans('Th[a-zà-ÿ]{1,2}')}),
n AS (SELECT DISTINCT doc_id, regexp_extract(name, '^.[^xqzjkñ]*') AS name, start FROM f),
v AS (SELECT * FROM n WHERE length(name) BETWEEN 2 AND 4 AND name NOT IN ('The', 'And', 'Thes') AND NOT regexp_matches(name[2:], '[wv]') AND NOT (length(name) = 2 AND name[2:2] IN ('t', 'n'))),
q AS (SELECT doc_id, start AS s, start + length(name) AS e FROM {_spans('[0-9]+|[#*%$&]+')}),
m AS (SELECT DISTINCT v.* FROM v JOIN q ON v.doc_id = q.doc_id AND v.start BETWEEN s - 200 AND e + 200)
SELECT doc_id, name, count(*) AS n_positions, min(start)::BIGINT AS first_position, array_to_string(list(start ORDER BY start), ',') AS positions FROM m GROUP BY doc_id, name HAVING count(*) >= 2""")
def surname_roles(spark, d):
    """N16 near numbers and runs of symbols, which stand for quotes."""
    docs = table(spark, d, "documents")
    marks = entities.mentions(docs, LATIN, ["doc_id"], pattern="[0-9]+|[#*%$&]+").select("doc_id", "start", "end")
    out = name_rules.surname_roles(docs, marks, ["doc_id"], _SURNAMES)
    return out.select("doc_id", "name", *long("n_positions", "first_position"), F.array_join(F.transform("positions", lambda p: p.cast("string")), ",").alias("positions"))


@query(rf"""WITH {_NAMES}, {_EACH}, c AS (SELECT e.doc_id, name, length(text) AS size, string_split(text, name) AS ps FROM each_name e JOIN documents d ON e.doc_id = d.doc_id)
SELECT doc_id, name, (len(ps) - 1)::BIGINT AS n, length(ps[1])::BIGINT AS first_place, (size - length(ps[len(ps)]) - length(name))::BIGINT AS last_place FROM c""")
def name_places(spark, d):
    """All places of all names of a text in one pass."""
    names = _mentions(spark, d).groupBy("doc_id").agg(F.collect_set("name").alias("names"))
    rows = table(spark, d, "documents").select("doc_id", "text").join(names, "doc_id").select("doc_id", F.explode(name_hits(F.col("text"), F.col("names"))).alias("h"))
    return rows.select("doc_id", "h.name", F.size("h.starts").cast("long").alias("n"), F.col("h.starts")[0].cast("long").alias("first_place"), F.element_at("h.starts", -1).cast("long").alias("last_place"))


_TAGGED = tagged.TagRules(
    names=name_rules.NameRules(surnames=("er", "on", "a", "e", "é", "è", "y", "o", "A", "E", "à"), letter="[a-zà-ÿ]"), foreign=False,
    prefixes=("le", "la", "the", "of", "el", "que", "is"), professions=("with", "est", "les"), titles=("der", "los", "une"), positions=("ou", "in", "and", "par"),
    org_suffixes=("de", "un", "it"), org_least=3, no_org_prefixes=("est", "con", "for"), no_orgs=("Un", "They"), no_persons=("And", "Is", "In"), cities=("La", "By", "It"),
    place_prefixes=("th", "re", "ou", "en"), place_suffixes=("in", "e", "er", "re"), org_marks="xqç", no_names=("Et", "Her"), links="mw", longest=7, heading="^(?:Th|Er)", western_mark="!",
)
_PLACE = "(?:th|re|ou|en)(?:in|er|re|e)"
_CELL = "conv_id, turn, text, type, sure, s, e, o"


def _free(rule: str, kind: str, text: str, sure: str, size: int, order: int, where: str, known: tuple[str, ...], lead: int = 0) -> str:
    """A rule's entities that share no token (but the first `lead`) with those of the rules before."""
    clear = " ".join(f"AND NOT EXISTS (SELECT 1 FROM {k} k WHERE k.conv_id = x.conv_id AND k.turn = x.turn AND k.s < x.i + {size} AND x.i + {lead} < k.e)" for k in known)
    return f"{rule} AS (SELECT conv_id, turn, {text} AS text, '{kind}' AS type, ({sure})::DOUBLE AS sure, i AS s, i + {size} AS e, {order} AS o FROM x WHERE {where} {clear})"


_SINGLE = tuple(s for s in _TAGGED.names.surnames if len(s) == 1)
_ENHANCED = rf"""WITH RECURSIVE t AS (SELECT conv_id, turn, text, regexp_extract_all(text, '[{_LETTERS}]+') AS ts FROM conversations WHERE text IS NOT NULL),
k AS (SELECT conv_id, turn, unnest(ts) AS t, unnest(range(len(ts))) AS i FROM t),
g AS (SELECT *, CASE WHEN regexp_matches(t, '^([a-zà-ÿ]|E.*)$') THEN 'NR' WHEN regexp_matches(t, 'tion$') THEN 'NS' WHEN regexp_matches(t, 'd$') THEN 'VV' ELSE 'X' END AS g FROM k),
x AS (SELECT *, lead(t) OVER w AS nt, lead(g) OVER w AS ng, (sum(length(t)) OVER w)::BIGINT AS stop FROM g WINDOW w AS (PARTITION BY conv_id, turn ORDER BY i)),
western AS (SELECT t.conv_id, t.turn, contains(text, '!') OR coalesce(bool_or(g = 'NR' AND t NOT IN {_in(_TAGGED.names.surnames)} AND ng = 'NR' AND nt NOT IN {_in(_TAGGED.names.surnames)}), false) AS west FROM t LEFT JOIN x ON t.conv_id = x.conv_id AND t.turn = x.turn GROUP BY t.conv_id, t.turn, text),
{_free('address', 'PER', 't || nt', '0.9', 2, 1, f"t IN {_in(_TAGGED.prefixes)} AND nt IN {_in(_SINGLE)} AND ng = 'NR'", ())},
{_free('job', 'PER', 't', '0.85', 1, 2, f"t IN {_in(_TAGGED.professions)}", ('address',))},
{_free('org', 'ORG', 't || nt', '0.85', 2, 3, f"nt IN {_in(_TAGGED.org_suffixes)} AND length(t) >= 3 AND t NOT IN {_in(_TAGGED.no_org_prefixes)}", ('address', 'job'))},
{_free('titled', 'PER', 't || nt', f"CASE WHEN nt IN {_in(_TAGGED.titles)} THEN 0.95 ELSE 0.9 END", 2, 4, f"g = 'NR' AND t IN {_in(_SINGLE)} AND ng <> 'VV' AND nt IN {_in(_TAGGED.titles + _TAGGED.positions)}", ('address', 'job', 'org'), 1)},
ruled AS (SELECT {_CELL} FROM address UNION ALL SELECT {_CELL} FROM job UNION ALL SELECT {_CELL} FROM org UNION ALL SELECT {_CELL} FROM titled),
base AS (SELECT conv_id, turn, t AS text, CASE WHEN regexp_matches(t, '^[A-M]') THEN 'PER' ELSE 'ORG' END AS type, 0.5::DOUBLE AS sure, i AS s, i + 1 AS e, 5 AS o FROM x WHERE regexp_matches(t, '^[A-Z]')),
alone AS (SELECT * FROM base b WHERE NOT EXISTS (SELECT 1 FROM ruled r WHERE r.conv_id = b.conv_id AND r.turn = b.turn AND r.s < b.e AND b.s < r.e) QUALIFY row_number() OVER (PARTITION BY conv_id, turn, text ORDER BY s) = 1),
more AS (SELECT * FROM alone a WHERE NOT EXISTS (SELECT 1 FROM ruled r WHERE r.conv_id = a.conv_id AND r.turn = a.turn AND r.text = a.text)),
every AS (SELECT {_CELL}, false AS west FROM ruled UNION ALL SELECT {_CELL}, false FROM more UNION ALL SELECT {_CELL}, true FROM base),
meant AS (SELECT e.* FROM every e JOIN western w ON e.conv_id = w.conv_id AND e.turn = w.turn AND e.west = w.west WHERE e.west OR NOT regexp_matches(text, '^(Th|Er)')),
screened AS (SELECT conv_id, turn, text, CASE WHEN city THEN 'LOC' ELSE type END AS type, CASE WHEN city THEN greatest(sure, 0.8) ELSE sure END AS sure, s, e, o, west FROM (SELECT *, type = 'PER' AND text IN {_in(_TAGGED.cities)} AS city FROM meant)
  WHERE city OR NOT (type = 'PER' AND text IN {_in(_TAGGED.no_persons)} OR type = 'ORG' AND text IN {_in(_TAGGED.no_orgs + _TAGGED.no_org_prefixes)})),
real AS (SELECT conv_id, turn, text, CASE WHEN NOT west AND length(text) > 1 AND type = 'PER' AND regexp_matches(text, '[xqç]') THEN 'ORG' ELSE type END AS type, CASE WHEN NOT west AND length(text) = 1 AND text NOT IN {_in(_TAGGED.names.surnames)} THEN 0.3 ELSE sure END AS sure, s, e, o, west FROM screened
  WHERE west OR length(text) = 1 OR type = 'PER' AND regexp_matches(text, '[xqç]') OR NOT (text IN {_in(_TAGGED.no_names)} OR length(text) > 7 AND regexp_matches(text, '[mw]') OR regexp_matches(text, '^[A-Za-z]{{1,2}}$'))),
grown AS (SELECT r.*, t.text[instr(t.text, r.text) + 1:instr(t.text, r.text) + 1] AS after FROM real r JOIN t ON r.conv_id = t.conv_id AND r.turn = t.turn),
own AS (SELECT conv_id, turn, CASE WHEN grows THEN text || after ELSE text END AS text, type, CASE WHEN grows THEN 0.85 ELSE sure END AS sure, s, e, o, west FROM (SELECT *, NOT west AND length(text) = 1 AND type = 'PER' AND text IN {_in(_TAGGED.names.surnames)} AND regexp_matches(after, '^[a-zà-ÿ]$') AS grows FROM grown)),
tagged AS (SELECT conv_id, turn, t AS text, i AS s FROM x WHERE g = 'NS'),
j AS (SELECT conv_id, turn, array_to_string(ts, '') AS joined FROM t),
m AS (SELECT conv_id, turn, unnest(regexp_extract_all(joined, '{_PLACE}')) AS hit, unnest(range(len(regexp_extract_all(joined, '{_PLACE}')))) AS n, string_split_regex(joined, '{_PLACE}') AS gaps, regexp_extract_all(joined, '{_PLACE}') AS hits FROM j),
l AS (SELECT conv_id, turn, hit, n, list_sum(list_transform(gaps[1:n + 1], lambda y: length(y))) + coalesce(list_sum(list_transform(hits[1:n], lambda y: length(y))), 0) AS pos FROM m),
c AS (SELECT l.conv_id, l.turn, hit, pos, min(x.i) FILTER (x.stop > pos) AS s, min(x.i) FILTER (x.stop >= pos + length(hit)) + 1 AS e FROM l JOIN x ON l.conv_id = x.conv_id AND l.turn = x.turn WHERE length(hit) >= 3 GROUP BY ALL),
d AS (SELECT *, row_number() OVER (PARTITION BY conv_id, turn ORDER BY pos) AS n FROM c WHERE NOT EXISTS (SELECT 1 FROM tagged k WHERE k.conv_id = c.conv_id AND k.turn = c.turn AND k.s < c.e AND c.s < k.s + 1)),
r AS (SELECT conv_id, turn, 0::BIGINT AS n, 0::BIGINT AS until, false AS kept FROM t UNION ALL SELECT r.conv_id, r.turn, d.n, CASE WHEN d.s >= until THEN d.e ELSE until END, d.s >= until FROM r JOIN d ON r.conv_id = d.conv_id AND r.turn = d.turn AND d.n = r.n + 1),
places AS (SELECT conv_id, turn, text, 0.9::DOUBLE AS sure, s, s + 1 AS e FROM tagged UNION ALL SELECT d.conv_id, d.turn, hit, 0.85::DOUBLE, d.s, d.e FROM d JOIN r ON d.conv_id = r.conv_id AND d.turn = r.turn AND d.n = r.n AND r.kept),
has AS (SELECT DISTINCT conv_id, turn FROM places),
firsts AS (SELECT * FROM own QUALIFY row_number() OVER (PARTITION BY conv_id, turn, text ORDER BY o, s) = 1)
SELECT conv_id, turn, text AS name, type, sure::DOUBLE AS confidence, s::BIGINT AS first_token, e::BIGINT AS end_token FROM (
  SELECT {_CELL} FROM own o WHERE NOT west AND NOT EXISTS (SELECT 1 FROM has h WHERE h.conv_id = o.conv_id AND h.turn = o.turn)
  UNION ALL SELECT {_CELL} FROM firsts f WHERE NOT regexp_matches(text, '^(Th|Er)') AND (west OR EXISTS (SELECT 1 FROM has h WHERE h.conv_id = f.conv_id AND h.turn = f.turn))
  UNION ALL SELECT conv_id, turn, text, 'LOC', sure, s, e, 0 FROM places WHERE NOT regexp_matches(text, '^(Th|Er)'))"""


@query(_ENHANCED)
def tagged_entities(spark, d):
    """N1, N3 and N5 to N13 on turns whose tags and base entities come from how words are written."""
    rows = table(spark, d, "conversations").where("text is not null").select("conv_id", "turn", "text", F.regexp_extract_all("text", F.lit(f"[{_LETTERS}]+"), F.lit(0)).alias("tokens"))
    tag = lambda t: F.when(t.rlike("^([a-zà-ÿ]|E.*)$"), "NR").when(t.rlike("tion$"), "NS").when(t.rlike("d$"), "VV").otherwise("X")
    capital = F.transform("tokens", lambda t, i: F.when(t.rlike("^[A-Z]"), tagged.entity(t, F.when(t.rlike("^[A-M]"), "PER").otherwise("ORG"), 0.5, i, i + 1)))
    rows = rows.withColumn("tags", F.transform("tokens", tag)).withColumn("base", F.filter(capital, lambda e: e.isNotNull()))
    found = rows.select("conv_id", "turn", F.explode(tagged.enhanced(F.col("tokens"), F.col("tags"), F.col("base"), F.col("text"), _TAGGED)).alias("e"))
    return found.select("conv_id", "turn", F.col("e.text").alias("name"), "e.type", "e.confidence", F.col("e.start").cast("long").alias("first_token"), F.col("e.end").cast("long").alias("end_token"))
