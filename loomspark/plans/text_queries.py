"""Registered queries on texts of the first language, made from the rows of part: sentences around quotes, volumes and chapters."""

from __future__ import annotations

from dataclasses import replace

from pyspark.sql import Column
from pyspark.sql import functions as F

from loomspark.operators import quotes, segment
from loomspark.packs import ZH
from loomspark.plans.queries import long, query, table
from loomspark.sources.tables import spread

_QUOTED = ("他说：「你好。再见！」然后走了。{n}来了；没人。", "「{n}。」", "“甲。乙”丙！「丁。戊", "{n}\n\n「a。b」。c？ ", " 《书。名》里写着『不。』！；{t}", "")
_VOLUMES = (
    "第一章 {n}\n正文正文正文{t}正文。\n卷一 风起\n第一章 {t}\n内容内容内容内容{n}\n第二章 短\n短\n卷二\n第三章 末\n末尾内容末尾内容{n}",
    "前言\n第一章 {n}\n内容内容内容{t}内容\n第二章 {t}\n  更多内容更多内容更多  \n第三回",
    "卷一 {n}\n第一章 甲\n内容内容内容{t}{n}\n第二章 乙\n内容内容内容内容内容\n卷二 {t}\n第一节 丙\n内容内容内容内容内容内容",
)


def _made(templates: tuple[str, ...]) -> Column:
    out = F.lit(templates[0])
    for i, t in enumerate(templates[1:], 1):
        out = F.when(F.col("p_partkey") % len(templates) == i, F.lit(t)).otherwise(out)
    return F.replace(F.replace(out, F.lit("{n}"), F.col("p_name")), F.lit("{t}"), F.col("p_type"))


def _sql(templates: tuple[str, ...]) -> str:
    quoted = [t.replace("\n", "' || chr(10) || '") for t in templates]
    cases = " ".join(f"WHEN {i} THEN '{t}'" for i, t in enumerate(quoted))
    return f"t AS (SELECT p_partkey, replace(replace(CASE p_partkey % {len(templates)} {cases} END, '{{n}}', p_name), '{{t}}', p_type) AS text FROM part)"


def _texts(spark, d, templates):
    return spread(table(spark, d, "part")).select("p_partkey", _made(templates).alias("text"))


_ITEM = r"「[^」\n]*」|『[^』\n]*』|“[^”\n]*”|\"[^\"\n]*\"|〈[^〉\n]*〉|《[^》\n]*》|[^「『“\"〈《\n。！？；]+|\n|[。！？；]|."


@query(rf"""WITH {_sql(_QUOTED)}, i AS (SELECT p_partkey, regexp_extract_all(text, '{_ITEM}') AS its FROM t), e AS (SELECT p_partkey, unnest(its) AS item, unnest(range(len(its))) AS k FROM i),
g AS (SELECT *, (sum(length(item)) OVER w - length(item))::BIGINT AS pos, coalesce(sum((item IN ('。', '！', '？', '；') OR item = chr(10))::INT) OVER (PARTITION BY p_partkey ORDER BY k ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) + 0.5 * (item = chr(10))::INT AS part FROM e WINDOW w AS (PARTITION BY p_partkey ORDER BY k)),
s AS (SELECT p_partkey, part, min(pos) AS pos, string_agg(item, '' ORDER BY k) AS piece FROM g GROUP BY p_partkey, part),
c AS (SELECT p_partkey, pos + length(piece) - length(regexp_replace(piece, '^\s+', '')) AS start, regexp_replace(piece, '^\s+|\s+$', '', 'g') AS sentence FROM s)
SELECT p_partkey, row_number() OVER (PARTITION BY p_partkey ORDER BY start) - 1 AS sentence_index, start::BIGINT AS start, sentence FROM c WHERE sentence <> ''""")
def smart_sentences(spark, d):
    """Sentence ends inside quotes are none."""
    return segment.sentences(_texts(spark, d, _QUOTED), ZH, ["p_partkey"]).select("p_partkey", *long("sentence_index", "start"), "sentence")


_NUMBERS = "一二三四五六七八九十百千万零"


@query(rf"""WITH {_sql(_VOLUMES)}, l AS (SELECT p_partkey, text, unnest(string_split(text, chr(10))) AS line, unnest(range(len(string_split(text, chr(10))))) AS k FROM t),
p AS (SELECT *, (sum(length(line) + 1) OVER (PARTITION BY p_partkey ORDER BY k) - length(line) - 1)::BIGINT AS start FROM l),
v AS (SELECT * FROM p WHERE regexp_matches(line, '^卷[{_NUMBERS}\d]+')), h AS (SELECT * FROM p WHERE regexp_matches(line, '^第[{_NUMBERS}\d]+[章节回卷]')),
c AS (SELECT h.*, (SELECT count(*) FROM v WHERE v.p_partkey = h.p_partkey AND v.start <= h.start) AS vol, (SELECT arg_max(line, start) FROM v WHERE v.p_partkey = h.p_partkey AND v.start <= h.start) AS vt, (SELECT count(*) FROM v WHERE v.p_partkey = h.p_partkey) AS vols,
  least(coalesce(lead(h.start) OVER (PARTITION BY p_partkey ORDER BY start), length(text)), coalesce((SELECT min(v.start) FROM v WHERE v.p_partkey = h.p_partkey AND v.start > h.start), length(text))) AS stop FROM h),
f AS (SELECT *, regexp_replace(text[start + length(line) + 2:stop], '^\s+|\s+$', '', 'g') AS content FROM c)
SELECT p_partkey, CASE WHEN vols > 0 THEN vol - (min(vol) OVER (PARTITION BY p_partkey) > 0)::INT ELSE 0 END AS volume_index, CASE WHEN vols > 0 THEN coalesce(vt, '序卷') ELSE '全文' END AS volume_title, row_number() OVER (PARTITION BY p_partkey, vol ORDER BY start) - 1 AS chapter_index, line AS title, start, stop, content
FROM f WHERE length(content) >= 10""")
def volume_chapters(spark, d):
    """Chapters in volumes, with and without a prologue."""
    out = segment.split_chapters(_texts(spark, d, _VOLUMES), ZH, "p_partkey")
    return out.select("p_partkey", *long("volume_index"), "volume_title", *long("chapter_index"), "title", *long("start"), F.col("end").cast("long").alias("stop"), "content")


_SPOKEN = ("{n}沉声道：「好。」他走了。", "「{n}」是古卷上写着的话。", "他来到「天剑阁」，看见「白云」。", "只听「轰！」一声，「走吧」她说。", "书中记载「{t}，天地玄黄。」，众人随后说道", "“啊啊”「」那人道“走？”", "他道{n}{t}{n}「风」说", "「雷雷」，说「去\n吧」")
_VERBS, _BOOKS, _PLACES = ("沉声道", "说道", "道", "说"), ("写着", "记载", "古卷"), ("阁", "云")
_PACK = replace(ZH, speech_verbs=_VERBS, book_words=_BOOKS, place_suffixes=_PLACES)
_ANY = "|".join
_FRONT = "CASE " + " ".join(f"WHEN contains(b, '{v}') THEN right(b, instr(reverse(b), '{v[::-1]}') - 1)" for v in _VERBS) + " END"
_BACK = "list_min(list_filter([" + ", ".join(f"instr(a, '{v}')" for v in _VERBS) + "], lambda x: x > 0)) - 1"


@query(rf"""WITH {_sql(_SPOKEN)}, m AS (SELECT p_partkey, text, unnest(regexp_extract_all(text, '「[^」]*」|“[^”]*”')) AS hit, unnest(range(len(regexp_extract_all(text, '「[^」]*」|“[^”]*”')))) AS k, string_split_regex(text, '「[^」]*」|“[^”]*”') AS gaps, regexp_extract_all(text, '「[^」]*」|“[^”]*”') AS hits FROM t),
q AS (SELECT p_partkey, k, text, hit, (list_sum(list_transform(gaps[1:k + 1], lambda g: length(g))) + coalesce(list_sum(list_transform(hits[1:k], lambda g: length(g))), 0))::BIGINT AS s FROM m),
w AS (SELECT p_partkey, k, s, hit[2:length(hit) - 1] AS quote, text[greatest(s - 50, 0) + 1:s] AS b, text[s + length(hit) + 1:s + length(hit) + 50] AS a FROM q),
x AS (SELECT *, regexp_replace(quote, '^\s+|\s+$', '', 'g') AS t, {_FRONT} AS gap, {_BACK} AS near FROM w),
y AS (SELECT *, CASE WHEN gap IS NULL OR length(gap) > 10 THEN 0 WHEN regexp_matches(gap, '[：:，,]\s*$') OR regexp_replace(gap, '\s', '', 'g') = '' THEN 1.0 ELSE 0.7 END::DOUBLE AS front, CASE WHEN near IS NULL OR near > 10 THEN 0 WHEN regexp_matches(a[1:near], '^\s*[，,]') THEN 0.5 ELSE 0.3 END::DOUBLE AS back,
  regexp_matches(t, '[。！？；]') AS ends, regexp_matches(t, '[啊呀呢吧嘛哦呗哇哈嘿哼嗯]$') AS modal, regexp_matches(t, '^[一-龥·\-—~～]{{1,10}}$') AS noun, regexp_matches(t, '^[一-龥][！!]+$') AS shout, regexp_matches(t, '(?:{_ANY(_PLACES)})$') AS proper, length(t) = 2 AND t[1:1] = t[2:2] AS doubled, regexp_matches(t, '[？?]') AS asks,
  regexp_matches(right(b, 15) || '「' || quote || '」' || a[1:15], '{_ANY(_BOOKS)}') OR regexp_matches(right(b, 15) || '「' || quote || '」' || a[1:15], '[」"』]\s*(?:的)?(?:这句话|这行字|这些字|此句|此诗|此词)\s*(?:刻|写|留|题|录|记|载)') AS cites, regexp_matches(right(b, 10), '{_ANY(_BOOKS)}') AS close, regexp_matches(right(b, 20) || a[1:20], '{_ANY(_VERBS)}') AS speech FROM x),
z AS (SELECT *, regexp_matches(t, '^[一-龥]{{1,2}}$') AND NOT ends AND NOT modal AS short FROM y),
s AS (SELECT *, front + back + CASE WHEN gap IS NULL AND near IS NULL THEN 0.3 ELSE 0 END AS s1,
  greatest(0, least(1, 0.5 + CASE WHEN ends THEN 0.3 ELSE 0 END + CASE WHEN modal THEN 0.2 ELSE 0 END + CASE WHEN noun THEN CASE WHEN proper THEN -0.4 ELSE -0.2 END ELSE 0 END + CASE WHEN shout THEN -0.5 ELSE 0 END + CASE WHEN short AND (doubled OR proper) THEN -0.3 ELSE 0 END + CASE WHEN asks THEN 0.2 ELSE 0 END))::DOUBLE AS s2,
  greatest(0, least(1, 0.5 + CASE WHEN cites THEN -0.6 ELSE 0 END + CASE WHEN close THEN -0.5 ELSE 0 END + CASE WHEN regexp_matches(quote, '[\n\r]') THEN -0.3 ELSE 0 END + CASE WHEN length(quote) > 100 AND NOT speech THEN -0.3 ELSE 0 END))::DOUBLE AS s3,
  front > 0 OR (back > 0 AND NOT shout) OR (ends AND NOT shout) OR modal OR asks AS support, shout OR (short AND (doubled OR proper)) AS sound FROM z)
SELECT p_partkey, k AS quote_index, s AS start, quote, t <> '' AND NOT ((sound OR noun) AND NOT support) AS is_dialogue,
  round(CASE WHEN t = '' THEN 0 WHEN sound AND NOT support THEN 0.2 WHEN noun AND NOT support THEN 0.3 ELSE greatest(0.5, greatest(0, least(1, (s1 + s2 + s3) / 3))) END, 6)::DOUBLE AS confidence FROM s""")
def quote_verdicts(spark, d):
    """Q2 to Q6: whether quotes are speech, by verbs around them, their form and citation marks."""
    found = quotes.extract_all_quotes(_texts(spark, d, _SPOKEN), ["p_partkey"], pairs=(("「", "」"), ("“", "”")))
    out = quotes.boundary_verdict(found, _PACK)
    return out.select("p_partkey", *long("quote_index", "start"), "quote", "is_dialogue", F.round("confidence", 6).alias("confidence"))
