"""One-pass dictionaries, foreign names, names from surnames and the rules over tagged sentences."""

import random
import re
import time

import pytest
from pyspark.sql import functions as F

from loomspark.functions import dictionary
from loomspark.functions.dictionary import name_hits, names_in
from loomspark.operators import entities, name_rules, segment, tagged
from loomspark.operators.name_rules import NameRules
from loomspark.operators.tagged import TagRules

RULES = NameRules(surnames=tuple("王李张孙萧林陈药欧") + ("欧阳", "上官"))
TAGS = TagRules(RULES)


def test_hits_against_brute_force(spark):
    r = random.Random(1)
    rows = [(i, "".join(r.choice("ab ,。c") for _ in range(r.randrange(60))), ["".join(r.choice("abc") for _ in range(r.randrange(4))) for _ in range(r.randrange(6))]) for i in range(80)]
    rows += [(100, None, ["a"]), (101, "aba", None), (102, "", ["a"]), (103, "aaaa", ["aa", "a", None, ""])]
    df = spark.createDataFrame(rows, "i int, t string, n array<string>")
    got = {x.i: x.h for x in df.select("i", name_hits(F.col("t"), F.col("n"), width=2, before=3, after=4).alias("h")).collect()}
    for i, t, names in rows:
        want = []
        for n in sorted({n for n in names or [] if n}):
            at = [m.start() for m in re.finditer(re.escape(n), t or "")]
            near = sorted({c for s in at for c in t[s + len(n) : s + len(n) + 2] if c not in " ,。"})
            want.append((n, at, near, [t[max(0, s - 3) : s + len(n) + 4] for s in at]))
        assert [tuple(h) for h in got[i]] == want


def test_names_in_texts_as_entity_in_says(spark):
    rows = [(["王走了", "王", None, "", "x王y", "王五和李四"], ["王", "李四", "五和"]), (["a"], None), (None, ["a"])]
    df = spark.createDataFrame(rows, "t array<string>, n array<string>")
    assert [r.x for r in df.select(names_in(F.col("t"), F.col("n"), "[一-龥]").alias("x")).collect()] == [[[], ["王"], [], [], ["王"], ["五和", "李四"]], [[]], []]
    one = spark.createDataFrame([(1, i, s) for i, s in enumerate(["王走了", "王", None, "x王y", "王五和李四"])] + [(2, 0, "王"), (None, 0, "王")], "d int, sentence_index int, sentence string")
    names = spark.createDataFrame([(1, "王"), (1, "李四"), (1, "五和"), (1, "")], "d int, name string")
    for rows in (segment.with_entities(one, names, ["d"], together=2), segment.with_entities(one.drop("sentence_index").withColumn("sentence_index2", F.lit(0)), names, ["d"])):
        assert sorted((str(r.d), str(r.sentence), r.entities) for r in rows.collect()) == sorted([("1", "王走了", []), ("1", "王", ["王"]), ("1", "None", []), ("1", "x王y", ["王"]), ("1", "王五和李四", ["五和", "李四"]), ("2", "王", []), ("None", "王", [])])


def test_many_names_take_one_pass():
    r = random.Random(2)
    text = "".join(r.choice("abcdefghij ") for _ in range(128_000))
    times = []
    for n in (4_000, 8_000, 16_000):
        names = ["".join(r.choice("abcdefghij") for _ in range(5)) for _ in range(n)]
        start = time.perf_counter()
        dictionary.places(dictionary.automaton(names), text)
        times.append(time.perf_counter() - start)
    assert times[1] < 1 and times[2] < 2.5 * times[1] + 0.2 and times[1] < 2.5 * times[0] + 0.2


def brute_foreign(tokens, tags, rules):
    """Classes of tokens as letters, then one regular expression."""
    letters = ""
    for i, (t, g) in enumerate(zip(tokens, tags, strict=True)):
        more = i + 1 < len(tokens)
        name_next = more and tags[i + 1] == "NR"
        free_next = name_next and tokens[i + 1] not in rules.surnames
        if g == "NR":
            letters += "x" if t in rules.surnames else "P"
        elif t in rules.name_joints:
            letters += "j" if name_next else "x"
        elif t == " ":
            letters += "j" if free_next else "x"
        elif t in rules.foreign_titles:
            letters += "t"
        else:
            letters += "l" if t in rules.name_links and free_next else "x"
    out = []
    for m in re.finditer("P[Pjtl]*", letters):
        s, e = m.span()
        parts = sum(c in "Pt" for c in m[0])
        if parts > 1 or any(re.search("[·.-]", tokens[i]) for i in range(s, e) if letters[i] in "Pt"):
            out.append(("".join(t for i, t in enumerate(tokens[s:e]) if m[0][i] != "l"), s, e))
    return out


def test_foreign_names_against_brute_force(spark):
    r = random.Random(3)
    words = ["亚瑟", "艾德温", "伊莉雅", "王", "欧阳", "·", "-", " ", "和", "骑士", "走", "约翰·李", "国王"]
    rows = [(i, [r.choice(words) for _ in range(r.randrange(14))]) for i in range(300)]
    rows = [(i, t, ["NR" if w in words[:5] + ["约翰·李"] and r.random() < 0.9 else "NN" for w in t]) for i, t in rows]
    rows += [(1000, ["亚瑟", "·", "潘德拉贡", "说"] * 2000, ["NR", "PU", "NR", "VV"] * 2000), (1001, None, None), (1002, ["亚瑟", "骑士"], ["NR", None]), (1003, ["亚瑟", "骑士"], ["NR"])]
    df = spark.createDataFrame(rows, "i int, t array<string>, g array<string>")
    got = {x.i: [tuple(e) for e in x.e] for x in df.select("i", name_rules.foreign_names(F.col("t"), F.col("g"), RULES).alias("e")).collect()}
    for i, t, g in rows[:301]:
        assert got[i] == brute_foreign(t, g, RULES)
    assert got[1001] == [] and got[1002] == got[1003] == [("亚瑟骑士", 0, 2)]


def test_names_from_surnames(spark):
    text = "孙项明心中一动，欧阳锋的眼里。孙项明笑道：王回头看李四。张了了。上官飞燕来到，欧阳锋走了" + "。" * 300 + "林远远"
    df = spark.createDataFrame([(1, text), (2, None), (3, "")], "d int, text string")
    found = sorted((r.start, r.name) for r in name_rules.surname_mentions(df, ["d"], RULES).collect())
    assert found == [(0, "孙项明"), (8, "欧阳锋"), (15, "孙项明"), (25, "李四"), (32, "上官"), (39, "欧阳锋"), (344, "林远远")]
    quotes = spark.createDataFrame([(1, 20, 30)], "d int, start int, end int")
    roles = {r.name: (r.n_positions, r.first_position, r.positions) for r in name_rules.surname_roles(df, quotes, ["d"], RULES).collect()}
    assert roles == {"孙项明": (2, 0, [0, 15]), "欧阳锋": (2, 8, [8, 39])}
    assert name_rules.surname_mentions(df, ["d"], NameRules(surnames=())).count() == 0


def sentence(spark, words, base=(), rules=TAGS):
    tokens, tags = [w.split("/")[0] for w in words.split()], [w.split("/")[1] for w in words.split()]
    df = spark.createDataFrame([(tokens, tags, list(base), "".join(tokens))], f"tokens array<string>, tags array<string>, base array<{tagged.KIND}>, text string")
    return [tuple(e) for e in df.select(tagged.enhanced(F.col("tokens"), F.col("tags"), F.col("base"), F.col("text"), rules).alias("e")).first().e]


def test_rules_over_a_tagged_sentence(spark):
    got = sentence(spark, "老/JJ 陈/NR 和/CC 林/NR 少爷/NN 见/VV 王/NR 总/NN 、/PU 博士/NN 在/P 暗影/NN 会/NN", [("林少爷", "PER", 1.0, 3, 5), ("众人", "PER", 1.0, 10, 11)])
    assert got == [("老陈", "PER", 0.9, 0, 2), ("博士", "PER", 0.85, 9, 10), ("暗影会", "ORG", 0.85, 11, 13), ("林少爷", "PER", 0.95, 3, 5), ("王总", "PER", 0.9, 6, 8)]
    assert sentence(spark, "萧/NR 嗤/VV 笑/VV", [("萧", "PER", 1.0, 0, 1)]) == [("萧嗤", "PER", 0.85, 0, 1)]
    assert sentence(spark, "第一章/NN 京城/NR 哼/IJ", [("第一章", "LOC", 1.0, 0, 1), ("京城", "PER", 0.5, 1, 2), ("哼", "PER", 1.0, 2, 3)]) == [("京城", "LOC", 0.8, 1, 2), ("哼", "PER", 0.3, 2, 3)]
    assert sentence(spark, "天道/NR 云岚宗/NR 123/CD", [("天道", "PER", 1.0, 0, 1), ("云岚宗", "PER", 1.0, 1, 2), ("123", "PER", 1.0, 2, 3)], TagRules(NameRules(surnames=("天道", "云岚宗")))) == [("云岚宗", "ORG", 1.0, 1, 2)]
    assert sentence(spark, "亚瑟/NR 骑士/NN 来/VV") == [("亚瑟骑士", "PER", 1.0, 0, 2)]


def test_western_sentences_keep_the_taggers_names(spark):
    got = sentence(spark, "亚瑟/NR ·/PU 潘/NR 到/VV 灰石/NN 哨站/NN 和/CC 伦敦/NS", [("亚瑟·潘", "PER", 1.0, 0, 3), ("魔王", "PER", 1.0, 3, 4)])
    assert got == [("伦敦", "LOC", 0.9, 7, 8), ("灰石哨站", "LOC", 0.85, 4, 6), ("亚瑟·潘", "PER", 1.0, 0, 3)]


def test_tagged_rows_with_nulls(spark):
    df = spark.createDataFrame([(1, "x", None, None), (2, None, ["王", "总"], ["NR", "NN"]), (3, "", [], [])], "d int, text string, tokens array<string>, tags array<string>")
    assert [tuple(r) for r in tagged.tagged_names(df, ["d"], TAGS).collect()] == [(2, "王总", "PER", 0.9)]
    assert tagged.tagged_names(df.limit(0), ["d"], TAGS).count() == 0


@pytest.mark.parametrize("rows", [[], [(1, None)], [(1, "王")]])
def test_statistics_of_texts_without_names(spark, rows):
    docs = spark.createDataFrame(rows, "d int, text string")
    names = spark.createDataFrame([(1, "李"), (1, "")], "d int, name string")
    assert [r.n for r in entities.occurrence_counts(docs, names, ["d"]).collect()] == [0] * len(rows)
    assert entities.right_neighbours(docs, names, ["d"]).count() == 0
