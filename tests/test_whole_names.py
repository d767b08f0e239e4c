"""The name queries over texts of any length, against brute force."""

import re
import unicodedata
from collections import Counter, defaultdict
from itertools import permutations
from collections import Counter, defaultdict

import pytest

from loomspark.plans.queries import QUERIES

NAME = re.compile("[A-Z][a-zà-ÿ]+")
TEXTS = {
    1: "Al met Al. Alan saw Al, Bo",
    2: "Margaretha met Al\nBo and Margaretha met Christopher. Bo é\nno names here",
    3: "",
    4: "Al went far, " * 400 + "then Bo! Zed",  # over 3000 characters
    5: None,
    6: "Marga Margaretha, Marg? Marga\nMarg",
}
NAMES = {i: set(NAME.findall(t or "")) for i, t in TEXTS.items()}


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    path = tmp_path_factory.mktemp("names")
    spark.createDataFrame(list(TEXTS.items()), "doc_id long, text string").write.parquet(f"{path}/documents.parquet")
    return str(path)


def rows(spark, folder, name):
    got = [tuple(r) for r in QUERIES[name](spark, folder).collect()]
    assert len(set(got)) == len(got)
    return set(got)


def neighbours(text, name):
    after = "".join(text[m.end() : m.end() + 2] for m in re.finditer(re.escape(name), text))
    return len({c for c in after if not c.isspace() and not unicodedata.category(c).startswith("P")})


def test_right_neighbors_of_long_texts(spark, folder):
    short = {r for r in rows(spark, folder, "right_neighbors") if len(r[1]) <= 3}
    assert short == {(i, n, neighbours(TEXTS[i], n)) for i, names in NAMES.items() for n in names if len(n) <= 3}


def test_every_name_is_counted(spark, folder):
    assert rows(spark, folder, "name_occurrences") == {(i, n, TEXTS[i].count(n)) for i, names in NAMES.items() for n in names}
    assert rows(spark, folder, "right_neighbors") == {(i, n, neighbours(TEXTS[i], n)) for i, names in NAMES.items() for n in names}


def test_every_name_is_paired(spark, folder):
    lines = [NAME.findall(line) for t in TEXTS.values() for line in (t or "").split("\n")]
    pairs = Counter(p for names in lines for p in permutations(set(names), 2))
    assert rows(spark, folder, "cooccurrence_pairs") == {(a, b, n) for (a, b), n in pairs.items()}
    count, partners = Counter(n for names in lines for n in names), defaultdict(list)
    for (a, b), n in pairs.items():
        partners[a].append((b, n))
    assert rows(spark, folder, "high_conf_cooc") == {(a, len(p), sum(n for b, n in p if count[b] >= 50)) for a, p in partners.items()}


def test_tightness_is_a_share_of_all_names(spark, folder):
    count = Counter(n for t in TEXTS.values() for n in NAME.findall(t or ""))
    total = Counter(n[0] for n in count.elements())
    assert rows(spark, folder, "tightness") == {(n[0], n, k, round(k / total[n[0]], 6)) for n, k in count.items()}
