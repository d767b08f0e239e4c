"""The rule tagger, names near verbs, windows, discoveries and mended operators."""

from pyspark.sql import functions as F

from loomspark.operators import characters as lib
from loomspark.operators import emotion, entities, nearby, segment, tagger
from loomspark.operators.tagger import TaggerRules
from loomspark.packs import ZH
from loomspark.plans.narrative import analyze
from tests.test_language_operators import SCHEMA

RULES = TaggerRules()


def test_tags_of_sentences(spark):
    rows = ["", None, "今天", "他笑了", "他冷笑道", "苦笑着怒吼", "滚！", "难道是他？", "他不高兴", "他并没有非常愤怒", "有点害怕，恐惧", "他怒道：“笑话”", "唉，惨！", "无悲伤，哭"]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(rows)], "i int, t string")
    got = {r.i: (r.x.emotion, round(r.x.confidence, 6), r.x.intensity, r.x.downgraded) for r in df.select("i", tagger.tag(F.col("t"), RULES).alias("x")).collect()}
    assert got[0] == got[1] == ("neutral", 1.0, "moderate", False) and got[2] == ("neutral", 0.0, "moderate", False)
    assert got[3] == ("joy", 0.1, "moderate", False) and got[4] == ("anger", 0.1, "moderate", False) and got[5] == ("sadness", 0.1, "moderate", False)
    assert got[6] == ("anger", 0.3, "moderate", False) and got[7] == ("surprise", round(0.7 / 3, 6), "moderate", False)
    assert got[8] == ("joy", 0.1, "mild", True) and got[9] == ("anger", 0.2, "moderate", True)  # 怒 and 愤怒; strong, one level down
    assert got[10] == ("fear", 0.2, "mild", False) and got[11][0] == "anger"  # the guide phrase and the text tie
    assert got[12] == ("sadness", round((2 * 0.3 + 0.7 * 0.5) / 3, 6), "moderate", False)
    assert got[13][3]
    labels = {r.i: {x.emotion: round(x.score, 6) for x in r.l} for r in df.select("i", tagger.labels(F.col("t"), RULES).alias("l")).collect()}
    assert labels[0] == labels[1] == labels[2] == {"neutral": 1.0} and labels[5] == {"joy": 0.2, "anger": 0.4} and labels[10] == {"fear": 0.4}


def test_library_in_narration(spark):
    people = spark.createDataFrame([(1, 1, "萧炎", ["岩枭"]), (1, 2, "林雪", None), (2, 3, "别人", [])], "project int, id int, name string, aliases array<string>")
    texts = spark.createDataFrame([(1, 1, "萧炎不语，" + "。" * 30 + "林雪点头"), (1, 2, "岩枭在此，林雪"), (1, 3, "没人"), (1, 4, None), (2, 5, "萧炎点头")], "project int, t int, text string")
    got = {r.t: (r.id, r.acts) for r in nearby.library_in_narration(texts, people, ["project"], ["t"], ("点头", "说")).collect()}
    assert got == {1: (2, True), 2: (1, False)}
    assert nearby.library_in_narration(texts, people.limit(0), ["project"], ["t"], ("说",)).count() == 0


def test_names_before_verbs(spark):
    docs = spark.createDataFrame([(1, "萧炎说道，" + "。" * 25 + "说。林雪儿说"), (2, "说说"), (3, None)], "d int, text string")
    names = spark.createDataFrame([(1, "萧炎"), (1, "林雪儿"), (1, "雪儿")], "d int, name string")
    assert sorted((r.d, r.verb, r.start) for r in nearby.verb_places(docs, ("说", "说道"), ["d"]).collect()) == [(1, "说", 2), (1, "说", 30), (1, "说", 35), (1, "说道", 2), (2, "说", 0), (2, "说", 1)]
    got = {(r.d, r.verb, r.start): (r.name, r.gap) for r in nearby.nearest_names(docs, names, ("说", "说道"), ["d"]).collect()}
    assert got == {(1, "说", 2): ("萧炎", 0), (1, "说道", 2): ("萧炎", 0), (1, "说", 30): (None, None), (1, "说", 35): ("林雪儿", 0), (2, "说", 0): (None, None), (2, "说", 1): (None, None)}


def test_windows_of_sentences(spark):
    rows = segment.sentences(spark.createDataFrame([(1, "一二三。四五六。七八九。")], "d int, text string"), ZH, ["d"], around=2).orderBy("start").collect()
    assert [r.window for r in rows] == ["一二三。四五", "三。四五六。七八", "六。七八九。"]


def test_discoveries_join_the_validated_names(spark):
    text = "药老说道。药老说道。药老说道。小炎说道。小炎说道"
    docs = spark.createDataFrame([(1, text)], "d int, text string")
    names = spark.createDataFrame([(1, "药", 0.5), (1, "小炎", 0.6)], "d int, name string, confidence double")
    tokens = spark.createDataFrame([(1, 0, ["云山", "说道"]), (1, 1, ["云山", "说道"]), (1, 2, ["小炎", "说道"])], "d int, sentence_index int, tokens array<string>")
    got = {r.name: r.new_confidence for r in entities.validate_and_discover(docs, names, ZH, ["d"], tokens=tokens).collect()}
    assert set(got) == {"药", "小炎", "药老", "云山"} and got["药老"] == 0.65 and got["云山"] == 0.6
    assert entities.validate_and_discover(docs.limit(0), names, ZH, ["d"]).count() == 0


def test_latest_status_and_short_words_of_a_large_lexicon(spark, monkeypatch):
    steps = spark.createDataFrame([(1, "a", "done", 1), (1, "a", "begun", 2), (1, "b", "z", 0)], "r int, s string, v string, t int")
    assert lib.progress_pivot(steps, "r", "s", "v", ["a", "b"], ["t"]).first()[1:] == ("begun", "z")
    monkeypatch.setattr(emotion, "LEXICON", 1)
    lexicon = spark.createDataFrame([("x", "a"), ("x", "bc"), ("y", "defg"), ("y", "defg")], "label string, word string")
    df = spark.createDataFrame([(1, "a bc defg"), (2, "def")], "d int, t string")
    assert [tuple(r) for r in emotion.keyword_votes(df, lexicon, ["d"], "t").collect()] == [(1, 3, "x", 2)]


def test_analysis_with_tagged_sentences(spark):
    from loomspark.operators.name_rules import NameRules
    from loomspark.operators.tagged import TagRules

    text = "第一章 相遇\n林雪走进门，笑道：「你终于来了。」\n老陈怒道：「滚！废物！」\n「好吧，萧炎。」林雪说道。\n路人甲说道：「走吧。」"
    library = spark.createDataFrame([(1, 1, "林雪", [], "female", 1, False), (2, 1, "萧炎", [], "male", 2, False), (3, 1, "老陈", [], "male", 2, False)], SCHEMA.replace("project string", "project long"))
    tokens = spark.createDataFrame([(1, 0, "老陈怒道", ["老", "陈", "怒", "道"], ["JJ", "NR", "VV", "VV"])], "doc_id long, sentence_index int, text string, tokens array<string>, tags array<string>")
    a = analyze(spark.createDataFrame([(1, text), (2, None)], "doc_id long, text string"), library, ZH, tokens=tokens, rules=TagRules(NameRules(surnames=("陈", "林"))), around=20)
    said = {r.quote: r.speaker for r in a.quotes.collect()}
    assert said == {"你终于来了。": "林雪", "滚！废物！": "老陈", "好吧，萧炎。": "林雪", "走吧。": None}
    assert "老陈" in {r.name for r in a.names.collect()} and a.errors.count() == 1
