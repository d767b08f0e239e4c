"""HTML extraction, filter audit and periodic runs against brute force and on edge rows."""

import hashlib
import random
import re
import time
from collections import Counter
from itertools import permutations

import duckdb
import pytest

from loomspark.llm import html_text, periodic_runs, queries
from loomspark.llm.filter_audit import failure_cells, filter_audit, subset_survivors
from loomspark.llm.periodic_runs import Ends, least_repeats, periodic_stretches, tail_repeated
from tests.conftest import SF

WORD = re.compile(r"[^\x20\x09-\x0D]+")


@pytest.mark.parametrize("name", ["op11_html_text", "op12_filter_audit", "op13_periodic_runs"])
def test_against_sql(spark, name):
    con = duckdb.connect()
    for t in ("documents", "labels", "pages"):
        con.execute(f"create view {t} as select * from read_parquet('{SF}/{t}.parquet')")
    want = con.execute(queries.oracle_sql()[name])
    columns = [c[0] for c in want.description]
    assert Counter(want.fetchall()) == Counter(tuple(r) for r in queries.queries()[name](spark, SF).select(columns).collect())


# Periodic runs.


def brute_runs(w, least=6, exponent=4):
    found = {}
    for q in range(1, len(w) // exponent + 1):
        i = 0
        while i + q < len(w):
            s = i
            while i + q < len(w) and w[i] == w[i + q]:
                i += 1
            if i - s + q >= max(least, exponent * q):
                found.setdefault((s, i - s + q), q)
            i += i == s
    return sorted((s, n, q) for (s, n), q in found.items())


def random_words(r):
    w = [r.randrange(r.choice([1, 2, 3, 4])) for _ in range(r.randrange(60))]
    if w and r.random() < 0.6:
        p = r.randrange(1, 7)
        w = w + [w[i % min(p, len(w))] for i in range(r.randrange(50))] + w[:5]
    return w


@pytest.mark.parametrize("wide", [2048, 4])
def test_periodic_stretches_against_brute_force(monkeypatch, wide):
    monkeypatch.setattr(periodic_runs, "WIDE", wide)
    r = random.Random(1)
    for _ in range(600):
        w = random_words(r)
        for least, exponent in ((6, 4), (3, 2), (5, 3), (2, 2), (20, 4)):
            assert periodic_stretches(w, least, exponent) == brute_runs(w, least, exponent)


def test_every_run_lies_in_repeated_triples():
    r = random.Random(2)
    for least, exponent in ((6, 4), (3, 2), (5, 3)):
        times = least_repeats(least, exponent)
        for _ in range(200):
            w = random_words(r)
            grams = Counter(tuple(w[i : i + 3]) for i in range(len(w) - 2))
            for s, n, _ in brute_runs(w, least, exponent):
                assert all(any(0 <= a and a + 3 <= len(w) and grams[tuple(w[a : a + 3])] >= times for a in (i - 2, i - 1, i)) for i in range(s, s + n))


def test_ordered_positions(monkeypatch):
    monkeypatch.setattr(periodic_runs, "WIDE", 4)
    r = random.Random(3)
    values = r.sample(range(1000), 300)
    ends, known = Ends([values[0]]), {values[0]}
    for x in values[1:]:
        assert ends.put(x) == (max((y for y in known if y < x), default=-1), min((y for y in known if y > x), default=-1))
        known.add(x)
    assert list(ends) == sorted(known) and len(ends) == len(known)


def test_periodic_runs_on_edge_rows(spark, edge, nothing):
    rows = [(100, "a b " * 5), (101, "x " * 6), (102, "x " * 5), (103, "a a a a a b b b b b b b"), (104, "ä " * 50_000 + "end"), (105, ". " * 3 + "a b c d " * 4 + "z")]
    df = edge.select("doc_id", "text", "lang", "block").unionByName(spark.createDataFrame(rows, "doc_id long, text string"), allowMissingColumns=True)
    got = periodic_runs.periodic_runs(df, rewrite=tail_repeated).collect()
    plain = periodic_runs.periodic_runs(df).collect()
    assert len(got) == len(plain) == df.count()
    for rewrite, out in ((tail_repeated, got), (None, plain)):
        want = []
        for r in df.select("doc_id", "text").collect():
            w = WORD.findall(r.text or "")
            again = rewrite and rewrite(r.doc_id, len(w))
            if again:
                a, p = again
                w = w[:a] + [w[a + (i - a) % p] for i in range(a, len(w))]
            found = [(0, 50_000, 1)] if not again and len(w) > 20_000 else brute_runs(w) if len(w) < 20_000 else None
            if found is None:
                continue
            gone = {i for s, n, q in found for i in range(s + q, s + n)}
            text = " ".join(x for i, x in enumerate(w) if i not in gone)
            top = min(found, key=lambda x: (-x[1], x[0], x[2]), default=None)
            want.append((r.doc_id, len(found), *(top or (None, None, None)), top and 1000 * top[1] // top[2], hashlib.sha256("".join("%d,%d,%d\n" % x for x in found).encode()).hexdigest(), hashlib.sha256(text.encode()).hexdigest(), tuple(found), text))
        have = Counter((*tuple(r)[:8], tuple(tuple(x) for x in r.runs), r.collapsed) for r in out)
        assert not Counter(want) - have
    assert periodic_runs.periodic_runs(nothing).count() == 0


def test_long_periodic_texts_take_linear_time():
    for w in ([0] * 100_000, [i % 3 for i in range(100_000)], [i % 25_000 for i in range(100_000)]):
        start = time.time()
        assert len(periodic_stretches(w)) == 1
        assert time.time() - start < 10


# Filter audit.


def brute_audit(rows, labels):
    good, toxic = ({i for i, *x in labels if i is not None and x[k] == 1} for k in (0, 1))
    first = {}
    for i, text, _ in rows:
        if i is not None:
            first[text or ""] = min(first.get(text or "", i), i)
    docs = []
    for i, text, source in rows:
        t = text or ""
        w = WORD.findall(t)
        fails = (len(w) < 50, 100 * len(set(w)) < 65 * len(w), 100 * len(re.findall("[A-Z]", t)) > 5 * len(t), bool(re.search(r"[#$%&*|]", t)), i is not None and i > first[t])
        docs.append((source or "", fails, i in good, i in toxic))
    out, shapley = {}, Counter()
    parts = {d[0] for d in docs}
    for order in permutations(range(5)):
        for part in parts:
            left = [d for d in docs if d[0] == part]
            whole = list(left)
            for step, f in enumerate(order, 1):
                gone, left = [d for d in left if d[1][f]], [d for d in left if not d[1][f]]
                shapley[part, f] += len(gone)
                redundant = sum(d[1][f] for d in whole) - len(gone) - sum(d[1][f] for d in left)
                out[part, "".join("ABCDE"[i] for i in order), step] = [f, len(left), len(gone), redundant, sum(d[1][f] and sum(d[1]) == 1 for d in whole), sum(d[2] for d in gone), sum(d[3] for d in gone)]
    return {(*k, *v[1:], shapley[k[0], v[0]]) for k, v in out.items()}


def test_filter_audit_on_edge_rows(spark, edge, nothing):
    labels = [(1, 1, 0), (1, 0, 1), (2, 0, 1), (7, 1, None), (None, 1, 1), (99, 1, 1), (10, None, 1)]
    table = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    extra = spark.createDataFrame([(i, t, s) for i, t, s in ((30, "ÄÖ # | A", ""), (31, "w " * 50, "p"), (32, "AB" + "x" * 38, "p"), (33, "A" + "x" * 19, "p"), (-5, "one", "q"), (34, "", "q"), (35, None, "q"), (31, "w " * 50, "p"))], "doc_id long, text string, source string")
    df = edge.unionByName(extra, allowMissingColumns=True)
    rows = [tuple(r) for r in df.select("doc_id", "text", "source").collect()]
    got = [tuple(r) for r in filter_audit(df, table).collect()]
    assert len(got) == len(set(got)) == 600 * len({s or "" for _, _, s in rows})
    assert set(got) == brute_audit(rows, labels)
    assert filter_audit(nothing, table).count() == 0
    assert {r.good_lost for r in filter_audit(df, table.limit(0)).collect()} == {0}


def test_subset_survivors_count_the_whole_table_too(spark, edge):
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    rows = subset_survivors(failure_cells(edge, labels)).collect()
    whole = {r.subset: r.n for r in rows if r.part is None}
    assert whole[0] == edge.count()
    for subset, n in whole.items():
        assert n == sum(r.n for r in rows if r.part is not None and r.subset == subset)


# Extraction.

ARTICLE = "The tower stood beside the river, and nobody in the village remembered who had built it or why it leaned so far to the east."
PAGES = {
    "div": f"<html><head><title>Site</title></head><body><div id='site-header'>My site about towers and rivers and more</div><div class=sidebar><p>Most read stories of this week and of the last</p></div><div class='post-body'><h2>Towers</h2><p>{ARTICLE}</p><p>A second&nbsp;paragraph &amp; more <a href=/x>with a link</a> in it.</p></div><div class='comments'><p>I was there and did not like it at all, says a reader</p></div><div id=footer>All rights reserved</div></body>",
    "main": f"<body><header><h1>News</h1></header><nav>Home</nav><main><h1>Towers</h1><div class='ad-slot'>Buy now, a very long advert text that goes on</div><p>{ARTICLE}</p><aside>More about it</aside><p>A second paragraph &amp; more with a link in it.</p><form><p>Subscribe</p></form></main><section id='comments'><article>Nice one, I liked what you have to say</article></section><footer>&copy; us",
    "unmarked": f"<p>Short note</p><ul><li><a href=1>One</a></li><li><a href=2>Two</a></li></ul><div><b>Towers</b><br>{ARTICLE}<!-- a > b <p>not here</p> --><script>var x = '<p>no</p>';</script><style>p > a {{}}</style> A second paragraph &amp; more with a link in it.</div><ul><li><a href=1>Three</a></li><li><a href=2>Four</a></li></ul>",
}


def test_extraction_of_other_templates():
    for name, page in PAGES.items():
        text = html_text.main_text(page, html_text.START)
        assert ARTICLE in text and "A second paragraph & more" in text and "Towers" in text, name
        assert not re.search("site about|Most read|did not like|reserved|News|Home|Buy now|More about|Subscribe|liked|us$|One|Two|Three|not here|var x|<|  ", text), (name, text)


def test_regions_against_brute_force():
    r = random.Random(4)
    for _ in range(500):
        s = [r.choice([-2.0, -1.0, 0.0, 1.0, 2.0]) for _ in range(r.randrange(12))]
        best = max((sum(s[a:b]), -a, -b) for a in range(len(s) + 1) for b in range(a, len(s) + 1))
        a, b = html_text.best_region(s)
        assert sum(s[a:b]) == best[0]


def test_extraction_edge_rows(spark):
    rows = [(1, "u", None, 5), (2, None, "", 5), (None, "u", "<p>one two three</p>", 5), (3, "u", "<nav>only a menu", 5), (4, "u", "plain text, 1 < 2 &lt; 3", 5), (5, "u", "<p>a<p>b</p>\n\n c &#x41;&amp;lt;", 5), (5, "u", "<p>a<p>b</p>\n\n c &#x41;&amp;lt;", 5), (6, "u", "<!-- open <p>x", 5), (7, "u", "<p>x</p><footer>y", 5), (8, "u", "<nav><p>one two three four five six", 5), (9, "u", "<p>" + "long words here " * 100_000 + "</p>", 5), (10, "u", "&copy; <", 5)]
    df = spark.createDataFrame(rows, "page_id long, url string, html string, text int")
    weights = html_text.learn(df)
    assert weights == html_text.START
    got = html_text.extract_text(df, weights).collect()
    assert all(r.n_chars == len(r.text) for r in got) and len(got) == len(rows)
    texts = {(r.page_id, r.url): r.text for r in got}
    assert texts[1, "u"] == texts[2, None] == texts[3, "u"].replace("only a menu", "") == texts[6, "u"] == ""
    assert texts[None, "u"] == "one two three" and texts[4, "u"] == "plain text, 1 < 2 < 3" and texts[5, "u"] == "a\nb\nc A&lt;"
    assert texts[7, "u"] == "x" and texts[8, "u"] == "one two three four five six" and len(texts[9, "u"]) == 1_599_999 and texts[10, "u"] == "© <"
    assert html_text.extract_text(df.limit(0), weights).count() == 0 and html_text.learn(df.limit(0)) == html_text.START


def test_pages_of_tag_scraps_take_linear_time():
    for page in ('<a "' * 50_000, "<a " * 100_000, "<title>" * 50_000, "<div class='ad'>" * 50_000, "<!--" * 50_000, "<a <b '\" " * 50_000 + '"', "<nav>" * 50_000 + "</nav>" * 50_000, "<script" * 50_000, "x<" * 100_000):
        start = time.time()
        html_text.main_text(page, html_text.START)
        assert time.time() - start < 5, page[:20]


def test_learned_weights_restore_labelled_regions(spark):
    pages = spark.read.parquet(f"{SF}/pages.parquet")
    weights = html_text.learn(pages)
    assert weights["word"] > 0 > weights["cut"] and all(w < 0 for k, w in weights.items() if k not in ("word", "link word"))
    for r in pages.collect():
        tokens, a, b = html_text.labelled(r.html)
        x, y = html_text.region_of(tokens, weights)
        assert [t for t in tokens[x:y] if t[0] == "word"] == [t for t in tokens[a:b] if t[0] == "word"]
