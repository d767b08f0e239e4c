from pyspark.sql import functions as F

from loomspark.operators import classifiers, name_rules, speakers
from loomspark.operators.name_rules import NameRules
from loomspark.packs import ZH

RULES = NameRules(surnames=("王", "李", "张"), black=("东西",), places=("京城",))


def test_token_rules(spark):
    df = spark.createDataFrame([("王 长老 说 李 经理 说 老 张 李 主任 来 天剑 门派 医生 这个 公司".split(),)], "tokens array<string>")
    got = [(e.text, e.type, e.confidence) for e in df.select(name_rules.token_entities(F.col("tokens"), RULES).alias("e")).first().e]
    assert got == [("王长老", "PER", 0.95), ("老张", "PER", 0.9), ("李主任", "PER", 0.9), ("天剑门派", "ORG", 0.85), ("医生", "PER", 0.85)]


def test_foreign_names_and_places(spark):
    df = spark.createDataFrame([(1, "约翰·史密斯先生来到纽约堡，安娜·李。")], "id int, text string")
    assert [(r.text, r.start) for r in name_rules.dotted_names(df, ["id"]).orderBy("start").collect()] == [("约翰·史密斯先生", 0), ("安娜·李", 14)]
    assert df.select(name_rules.western_places(F.col("text"), RULES).alias("x")).first().x == ["纽约堡"]
    row = spark.createDataFrame([("甲", ["约翰", "汤姆"], ["NR", "NR"]), ("甲", ["王五", "汤姆"], ["NR", "NR"]), ("甲·乙", ["x"], ["O"])], "t string, k array<string>, g array<string>")
    assert [r.w for r in row.select(name_rules.is_western(F.col("t"), F.col("k"), F.col("g"), RULES.surnames).alias("w")).collect()] == [True, False, True]
    assert spark.range(1).select(name_rules.normal_type(F.lit("nr")).alias("x")).first().x == "PER"


def test_combining_and_screening(spark):
    schema = "d int, text string, type string, confidence double, start int, end int"
    model = spark.createDataFrame([(1, "王", "PER", 0.9, 0, 1), (1, "京城", "PER", 0.5, 5, 7), (2, "王", "PER", 0.9, 0, 1), (1, "东西", "PER", 0.9, 9, 11)], schema)
    ruled = spark.createDataFrame([(1, "王长老", "PER", 0.95, 0, 3)], schema)
    out = name_rules.screened(name_rules.combine(model, ruled, ["d"]), RULES)
    assert sorted((r.d, r.text, r.type, r.confidence) for r in out.collect()) == [(1, "京城", "LOC", 0.8), (1, "王长老", "PER", 0.95), (2, "王", "PER", 0.9)]
    assert spark.range(1).select(name_rules.expanded(F.lit("林"), F.lit("那林雪")).alias("x")).first().x == "林雪"
    names = spark.createDataFrame([(1, "萧炎"), (1, "欧阳锋")], "d int, name string")
    got = name_rules.trimmed_to_library(model.limit(0).union(spark.createDataFrame([(1, "萧炎冷", "PER", 0.5, 0, 3), (1, "欧阳锋笑", "PER", 0.5, 0, 4), (1, "路人", "PER", 0.5, 0, 2)], schema)), names, ["d"])
    assert sorted(r.text for r in got.collect()) == sorted(["萧炎", "欧阳锋", "路人"])


def test_classifiers(spark):
    rows = [("哈哈，太好了！", "joy"), ("赢了，太棒了！", "joy"), ("恭喜恭喜！", "joy"), ("滚！废物！", "anger"), ("混蛋，找死！", "anger"), ("放肆！", "anger")] * 4
    df = spark.createDataFrame(rows, "sentence string, label string")
    tree = classifiers.feature_tree(df, ZH.emotions)
    assert tree.transform(classifiers.with_features(df, ZH.emotions)).where("predicted = label").count() >= 20
    grams = classifiers.gram_classifier(df)
    assert grams.transform(classifiers.with_grams(df)).where("predicted = label").count() == 24


def test_speaker_formulas(spark):
    one = spark.range(1)
    value = lambda c: one.select(c.alias("x")).first().x
    assert round(value(speakers.pronoun_confidence(F.lit(0), F.lit(5), F.lit(1.0), F.lit(False), F.lit(True))), 4) == 0.945
    assert value(speakers.address_confidence(F.lit(3.0), F.lit(True))) == 0.59 and value(speakers.address_confidence(F.lit(3.0), F.lit(False))) == 0.6
    assert value(speakers.self_introduction(F.lit("我叫林雪，你呢"))) == "林雪"
    assert round(value(speakers.action_boost(F.lit(0.9), F.lit("林雪"), F.lit("林雪缓缓转身"), ("转身",))), 2) == 0.95
    assert round(value(speakers.semantic_confidence(F.lit(0.9))), 2) == 0.7


def test_spread_contexts_and_guards(spark):
    import pytest

    from loomspark.operators import characters as lib
    from loomspark.operators import entities, quotes

    p = spark.createDataFrame([(1, "林雪", 10), (1, "林雪", 7000), (1, "萧炎", 10)], "d int, name string, start int")
    c = spark.createDataFrame([(1, 0, 0, 6000), (1, 1, 6000, 9000)], "d int, chapter_index int, start int, end int")
    assert {r.name: r.n_chapters for r in entities.chapter_spread(p, c, ["d"]).collect()} == {"林雪": 2, "萧炎": 1}
    t = spark.createDataFrame([("匾上「天剑阁」三字", "天剑阁"), ("他道：「好。」", "好。"), ("无", "好")], "t string, q string")
    assert {r.q: r.is_dialogue for r in quotes.is_dialogue(t, ZH, "t", "q").collect()} == {"天剑阁": False, "好。": True, "好": True}
    d = spark.createDataFrame([(1, "「好。」林雪说道")], "d int, text string")
    assert [(r.kind, r.context) for r in quotes.speech_contexts(d, ZH, ["d"]).collect()] == [("after", "林雪说道")]
    lib_ = spark.createDataFrame([(1, "p", "林雪")], "id long, project string, name string")
    assert sorted(r.id for r in lib.with_narrator(lib_).collect()) == [-1, 1]
    with pytest.raises(ValueError):
        lib.same_count(lib_, lib_.limit(0))


def test_stratified_folds_and_macro_f1(spark):
    from collections import Counter

    rows = [(f"t{i}", "a" if i % 3 else "b") for i in range(101)] + [("same", "a")] * 7 + [(None, "b"), ("x", None)]
    folded = classifiers.stratified_folds(spark.createDataFrame(rows, "t string, y string"), "y", "t", 4).collect()
    assert len(folded) == len(rows) and {r.fold for r in folded} == {0, 1, 2, 3}
    for y in ("a", "b"):
        sizes = Counter(r.fold for r in folded if r.y == y).values()
        assert max(sizes) - min(sizes) <= 1
    pairs = [(0, "a", "a")] * 3 + [(0, "a", "b"), (0, "b", "b"), (0, "c", "a"), (1, "a", "b"), (1, "b", "a")]
    got = {r.k: r.macro_f1 for r in classifiers.macro_f1(spark.createDataFrame(pairs, "k int, y string, p string"), "y", "p", ["k"]).collect()}
    for k in (0, 1):
        mine = [(y, p) for f, y, p in pairs if f == k]
        scores = []
        for c in {x for pair in mine for x in pair}:
            tp, fp, fn = sum(y == p == c for y, p in mine), sum(p == c != y for y, p in mine), sum(y == c != p for y, p in mine)
            scores.append(2 * tp / (2 * tp + fp + fn))
        assert abs(got[k] - sum(scores) / len(scores)) < 1e-9
    said = [("哈哈，太好了！", "joy"), ("赢了，太棒了！", "joy"), ("滚！废物！", "anger"), ("混蛋，找死！", "anger")] * 6
    scores = classifiers.cross_validated(spark.createDataFrame([(f"{t}{i}", y) for i, (t, y) in enumerate(said)], "sentence string, label string"), ZH.emotions, folds=3).collect()
    assert len(scores) == 3 and all(r.macro_f1 > 0.8 for r in scores)
