"""The queries of this package: each applies an operator to the whole of its table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomspark.llm import html_text, language_id, quality
from loomspark.llm.filter_audit import filter_audit
from loomspark.llm.media import store_media
from loomspark.llm.minhash_dedup import near_duplicates
from loomspark.llm.mixing import mix_sources
from loomspark.llm.packing import pack_documents
from loomspark.llm.periodic_runs import periodic_runs, tail_repeated
from loomspark.llm.pii import find_pii
from loomspark.llm.secrets import scan_secrets
from loomspark.llm.substring_dedup import substring_dedup
from loomspark.llm.suffix_dedup import suffix_dedup
from loomspark.sources.tables import read_table, spread


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spread(read_table(spark, sf_dir, "documents"))


def op1_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    out = language_id.predict(docs, language_id.learn(docs))
    return out.select("doc_id", language_id.held_out().alias("held_out"), "lang_pred", "score", F.size("spans").cast("long").alias("n_spans"))


def op2_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan_secrets(documents(spark, sf_dir)).drop("found")


def op3_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    return quality.quality_rules(docs, quality.train(docs, spark.read.parquet(f"{sf_dir}/labels.parquet")))


def op4_source_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix_sources(documents(spark, sf_dir), texts=False).drop("copies")


def op5_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack_documents(documents(spark, sf_dir), ids=False).drop("ids")


def op6_media_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    return store_media(documents(spark, sf_dir), media=False).drop("media")


def op7_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = suffix_dedup(documents(spark, sf_dir), texts=False)
    return out.select("doc_id", "n_bytes", "n_removed", F.size("spans").cast("long").alias("n_spans"), "kept_sha256")


def op8_minhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(documents(spark, sf_dir))


def op9_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring_dedup(documents(spark, sf_dir), texts=False).select("doc_id", "n_words", "n_removed", "kept_sha256")


def op10_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return find_pii(documents(spark, sf_dir)).drop("found")


def op11_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = spread(read_table(spark, sf_dir, "pages"))
    return html_text.extract_text(pages, html_text.learn(pages))


def op12_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filter_audit(documents(spark, sf_dir), read_table(spark, sf_dir, "labels"))


def op13_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return periodic_runs(documents(spark, sf_dir), texts=False, rewrite=tail_repeated)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    found = (op1_language_id, op2_secret_scan, op3_quality_rules, op4_source_mix, op5_packing, op6_media_columns, op7_suffix_dedup, op8_minhash_dedup, op9_substring_dedup, op10_pii, op11_html_text, op12_filter_audit, op13_periodic_runs)
    return {f.__name__: f for f in found}


_WORDS = r"w AS (SELECT doc_id, regexp_extract_all(coalesce({text}, ''), '[^\x20\x09-\x0D]+') AS ws FROM documents), p AS (SELECT doc_id, unnest(ws) AS word, unnest(range(1, len(ws) + 1)) AS i FROM w)"

OP9_SQL = f"""WITH {_WORDS.format(text='text')},
h AS (SELECT doc_id, i, word, count(*) OVER f AS c, string_agg(word, ' ') OVER f AS k FROM p WINDOW f AS (PARTITION BY doc_id ORDER BY i ROWS BETWEEN CURRENT ROW AND 49 FOLLOWING)),
m AS (SELECT k, min(doc_id) AS least FROM h WHERE c = 50 GROUP BY k),
t AS (SELECT h.doc_id, i, word, coalesce(c = 50 AND h.doc_id > least, false) AS hit FROM h LEFT JOIN m ON h.k = m.k),
g AS (SELECT doc_id, i, word, max(hit::INT) OVER (PARTITION BY doc_id ORDER BY i ROWS BETWEEN 49 PRECEDING AND CURRENT ROW) = 1 AS gone FROM t),
d AS (SELECT doc_id, count(*) AS n_words, count_if(gone)::BIGINT AS n_removed, coalesce(string_agg(word, ' ' ORDER BY i) FILTER (NOT gone), '') AS kept FROM g GROUP BY doc_id)
SELECT w.doc_id, coalesce(n_words, 0)::BIGINT AS n_words, coalesce(n_removed, 0)::BIGINT AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256 FROM w LEFT JOIN d ON w.doc_id = d.doc_id"""

OP8_SQL = f"""WITH RECURSIVE {_WORDS.format(text="translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')")},
h AS (SELECT doc_id, i, count(*) OVER f AS c, string_agg(word, ' ') OVER f AS k, count(*) OVER (PARTITION BY doc_id) AS n FROM p WINDOW f AS (PARTITION BY doc_id ORDER BY i ROWS BETWEEN CURRENT ROW AND 2 FOLLOWING)),
s AS (SELECT DISTINCT doc_id, k FROM h WHERE c = 3 OR (i = 1 AND n < 3)),
z AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
x AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS m FROM s a JOIN s b ON a.k = b.k AND a.doc_id <> b.doc_id GROUP BY a.doc_id, b.doc_id),
l AS (SELECT a, b FROM x JOIN z za ON za.doc_id = a JOIN z zb ON zb.doc_id = b WHERE 100 * m >= 85 * (za.n + zb.n - m)),
r AS (SELECT doc_id AS a, doc_id AS b FROM documents UNION SELECT r.a, l.b FROM r JOIN l ON r.b = l.a)
SELECT d.doc_id, coalesce(z.n, 0)::BIGINT AS n_shingles, c.component_id, d.doc_id = c.component_id AS kept FROM documents d LEFT JOIN z ON d.doc_id = z.doc_id JOIN (SELECT a, min(b) AS component_id FROM r GROUP BY a) c ON d.doc_id = c.a"""


# Bytes as pairs of hexadecimal digits: DuckDB cuts strings, not blobs.
OP7_SQL = """WITH b AS (SELECT doc_id, hex(encode(coalesce(text, ''))) AS h FROM documents),
p AS (SELECT doc_id, unnest(range(length(h) // 2)) AS s, unnest(regexp_extract_all(h, '..')) AS byte FROM b),
w AS (SELECT doc_id, s, byte, CASE WHEN count(*) OVER f = 200 THEN md5(string_agg(byte, '') OVER f) END AS k FROM p WINDOW f AS (PARTITION BY doc_id ORDER BY s ROWS BETWEEN CURRENT ROW AND 199 FOLLOWING)),
t AS (SELECT *, k IS NOT NULL AND count(*) OVER (PARTITION BY k) > 1 AS hit FROM w),
g AS (SELECT doc_id, s, byte, max(hit::INT) OVER (PARTITION BY doc_id ORDER BY s ROWS BETWEEN 199 PRECEDING AND CURRENT ROW) = 1 AS gone FROM t),
e AS (SELECT *, gone AND NOT coalesce(lag(gone) OVER (PARTITION BY doc_id ORDER BY s), false) AS opens FROM g),
d AS (SELECT doc_id, count_if(gone)::BIGINT AS n_removed, count_if(opens)::BIGINT AS n_spans, string_agg(byte, '' ORDER BY s) FILTER (NOT gone) AS kept FROM e GROUP BY doc_id)
SELECT b.doc_id, length(h) // 2 AS n_bytes, coalesce(n_removed, 0)::BIGINT AS n_removed, coalesce(n_spans, 0)::BIGINT AS n_spans, sha256(unhex(coalesce(kept, ''))) AS kept_sha256 FROM b LEFT JOIN d ON b.doc_id = d.doc_id"""


# The pages' template: one <article> of <h1> and <p>, some of them cut short inside a character reference.
OP11_SQL = r"""WITH a AS (SELECT page_id, url, regexp_extract(coalesce(html, ''), '(?s)<article>(.*)</article>', 1) AS x FROM pages),
b AS (SELECT page_id, regexp_split_to_array(x, '</?(h1|p)>') AS bs FROM a),
c AS (SELECT page_id, unnest(bs) AS t, unnest(range(len(bs))) AS i FROM b),
d AS (SELECT page_id, i, trim(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(replace(regexp_replace(t, '<[^>]*>', '', 'g'), '&#x27;', chr(39)), '&lt;?', '<', 'g'), '&gt;?', '>', 'g'), '&quot;?', '"', 'g'), '&amp;?', '&', 'g'), '[\s\x{00A0}]+', ' ', 'g')) AS t FROM c),
e AS (SELECT page_id, string_agg(t, chr(10) ORDER BY i) AS text FROM d WHERE t <> '' GROUP BY page_id)
SELECT a.page_id, url, coalesce(text, '') AS text, length(coalesce(text, '')) AS n_chars FROM a LEFT JOIN e ON a.page_id = e.page_id"""

OP12_SQL = r"""WITH t AS (SELECT doc_id, coalesce(source, '') AS part, coalesce(text, '') AS x FROM documents),
w AS (SELECT *, regexp_extract_all(x, '[^\x20\x09-\x0D]+') AS ws FROM t),
l AS (SELECT doc_id, bool_or(quality = 1) AS good, bool_or(toxic = 1) AS toxic FROM labels GROUP BY doc_id),
f AS (SELECT part, [len(ws) < 50, 100 * len(list_distinct(ws)) < 65 * len(ws), 100 * len(regexp_extract_all(x, '[A-Z]')) > 5 * length(x), regexp_matches(x, '[#$%&*|]'), coalesce(w.doc_id > min(w.doc_id) OVER (PARTITION BY x), false)] AS fails, coalesce(good, false) AS good, coalesce(toxic, false) AS toxic FROM w LEFT JOIN l ON w.doc_id = l.doc_id),
c AS (SELECT part, fails, good, toxic, count(*) AS n FROM f GROUP BY ALL),
k AS (SELECT unnest(range(1, 6)) AS i),
o AS (SELECT [a.i, b.i, c.i, d.i, e.i] AS p FROM k a, k b, k c, k d, k e WHERE len(list_distinct([a.i, b.i, c.i, d.i, e.i])) = 5),
r AS (SELECT c.*, p, list_position(list_transform(p, lambda i: fails[i]), true) AS goes FROM c, o),
s AS (SELECT part, array_to_string(list_transform(p, lambda i: substr('ABCDE', i, 1)), '') AS filter_order, step, p[step] AS f,
  sum(n) FILTER (goes IS NULL OR goes > step) AS kept, sum(n) FILTER (goes = step) AS removed, sum(n) FILTER (fails[p[step]] AND goes < step) AS redundant,
  sum(n) FILTER (fails[p[step]] AND len(list_filter(fails, lambda y: y)) = 1) AS unique_fails, sum(n) FILTER (goes = step AND good) AS good_lost, sum(n) FILTER (goes = step AND toxic) AS toxic_lost
  FROM r, (SELECT i AS step FROM k) GROUP BY part, p, step)
SELECT part, filter_order, step::INT AS step, coalesce(kept, 0)::BIGINT AS kept, coalesce(removed, 0)::BIGINT AS removed, coalesce(redundant, 0)::BIGINT AS redundant, coalesce(unique_fails, 0)::BIGINT AS unique_fails, coalesce(good_lost, 0)::BIGINT AS good_lost, coalesce(toxic_lost, 0)::BIGINT AS toxic_lost, coalesce(sum(removed) OVER (PARTITION BY part, f), 0)::BIGINT AS shapley FROM s"""

# crc32 bit by bit; equal words at one distance, without a gap, are a stretch with that period.
OP13_SQL = rf"""WITH RECURSIVE {_WORDS.format(text='text')},
z(doc_id, s, pos, c, bits) AS (SELECT doc_id, doc_id::VARCHAR, 0, 4294967295::BIGINT, 0 FROM w WHERE doc_id IS NOT NULL
  UNION ALL SELECT doc_id, s, CASE WHEN bits = 0 THEN pos + 1 ELSE pos END, CASE WHEN bits = 0 THEN xor(c, ascii(s[pos + 1])::BIGINT) WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END, (bits + 1) % 9 FROM z WHERE bits > 0 OR pos < length(s)),
h AS (SELECT doc_id, xor(c, 4294967295) AS h FROM z WHERE bits = 0 AND pos = length(s)),
n AS (SELECT w.doc_id, len(ws) AS n, h % 10 = 0 AND len(ws) > 0 AS again, CASE WHEN len(ws) > 0 THEN (h // 10) % len(ws) END AS a, 3 + (h // 10) % 8 AS k FROM w LEFT JOIN h ON w.doc_id = h.doc_id),
m AS (SELECT n.doc_id, n, i - 1 AS i, CASE WHEN again AND i > a THEN 1 + a + (i - 1 - a) % (1 + (n - a) // k) ELSE i END AS j FROM n JOIN p ON n.doc_id = p.doc_id),
v AS (SELECT m.doc_id, n, m.i, p.word FROM m JOIN p ON m.doc_id = p.doc_id AND m.j = p.i),
e AS (SELECT a.doc_id, b.i - a.i AS q, a.i FROM v a JOIN v b ON a.doc_id = b.doc_id AND a.word = b.word AND b.i > a.i AND 4 * (b.i - a.i) <= a.n),
g AS (SELECT doc_id, q, i, i - row_number() OVER (PARTITION BY doc_id, q ORDER BY i) AS island FROM e),
u AS (SELECT doc_id, q, min(i) AS start, count(*) + q AS size FROM g GROUP BY doc_id, q, island HAVING count(*) >= 3 * q AND count(*) + q >= 6),
r AS (SELECT doc_id, start, size, min(q) AS q FROM u GROUP BY doc_id, start, size),
d AS (SELECT doc_id, count(*) AS n_runs, first(start ORDER BY size DESC, start, q) AS start, max(size) AS length, first(q ORDER BY size DESC, start, q) AS period, string_agg(concat(start, ',', size, ',', q, chr(10)), '' ORDER BY start, q) AS rs FROM r GROUP BY doc_id),
x AS (SELECT DISTINCT r.doc_id, v.i FROM r JOIN v ON r.doc_id = v.doc_id AND v.i >= r.start + r.q AND v.i < r.start + r.size),
y AS (SELECT v.doc_id, string_agg(word, ' ' ORDER BY v.i) AS kept FROM v ANTI JOIN x ON v.doc_id = x.doc_id AND v.i = x.i GROUP BY v.doc_id)
SELECT w.doc_id, coalesce(n_runs, 0) AS n_runs, start, length, period, 1000 * length // period AS exponent_milli, sha256(coalesce(rs, '')) AS runs_sha256, sha256(coalesce(kept, '')) AS collapsed_sha256 FROM w LEFT JOIN d ON w.doc_id = d.doc_id LEFT JOIN y ON w.doc_id = y.doc_id"""


def oracle_sql() -> dict[str, str]:
    return {"op7_suffix_dedup": OP7_SQL, "op8_minhash_dedup": OP8_SQL, "op9_substring_dedup": OP9_SQL, "op11_html_text": OP11_SQL, "op12_filter_audit": OP12_SQL, "op13_periodic_runs": OP13_SQL}
