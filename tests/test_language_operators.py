import pytest
from pyspark.sql import functions as F

from loomspark.operators import characters as lib
from loomspark.operators import emotion, entities, quotes, similarity, sounds, speakers
from loomspark.packs import ZH
from loomspark.plans.narrative import analyze


def docs(spark, *texts):
    return spark.createDataFrame(list(enumerate(texts, 1)), "doc_id long, text string")


@pytest.mark.parametrize(
    ("text", "label"),
    [
        ("滚！废物！", "anger"),
        ("哈哈，太好了，我们赢了！", "joy"),
        ("唉……再也见不到他了。", "sadness"),
        ("难道他还活着？怎么可能？", "surprise"),
        ("快跑！危险！", "fear"),
        ("他走在路上。", "neutral"),
        ("", "neutral"),
        ("背叛师门，死无葬身之地！", "anger"),
        ("救命！别杀我！", "fear"),
        ("我不生气。", "neutral"),
        ("他冷笑道：\"就凭你？\"", "anger"),
    ],
)
def test_emotion_labels(spark, text, label):
    row = emotion.classify(spark.createDataFrame([(text,)], "sentence string"), ZH).first()
    assert row.emotion_label == label
    assert 0 <= row.confidence <= 0.95 and len(row.emotion_vector) == 8


def test_emotion_class_and_vector(spark):
    rows = [("anger", 0.5, "excited"), ("anger", 0.3, "subdued"), ("joy", 0.3, "neutral"), ("joy", 0.4, "excited"), ("fear", 1.0, "subdued"), ("unknown", 1.0, "neutral")]
    df = spark.createDataFrame(rows, "l string, i double, want string")
    assert df.where(emotion.emotion_class(F.col("l"), F.col("i")) != F.col("want")).count() == 0
    v = df.where("l = 'fear'").select(emotion.emotion_vector(F.col("l"), F.lit(0.5), F.col("i")).alias("v")).first().v
    assert v == [0, 0, 0.1, 0.5, 0, 0, 0, 0]


def test_emotion_carries_over(spark):
    rows = [(1, 0, "唉……再也见不到他了。"), (1, 1, "那边，然后"), (1, 2, "他走在路上。"), (2, 0, "那边，然后")]
    df = spark.createDataFrame(rows, "chapter int, i int, sentence string")
    alone = {(r.chapter, r.i): r.emotion_label for r in emotion.classify(df, ZH).collect()}
    carried = {(r.chapter, r.i): (r.emotion_label, r.sentence) for r in emotion.classify_in_order(df, ZH, ["chapter"], "i").collect()}
    assert carried[1, 0][0] == alone[1, 0] == "sadness"
    assert alone[1, 1] == "neutral" and carried[1, 1] == ("sadness", "那边，然后")
    assert carried[2, 0][0] == "neutral"


def test_dialogue_extraction_and_suppression(spark):
    df = docs(spark, "林雪笑道：「你好啊。」他看见「天剑阁」三字。'嗯'「」")
    found = quotes.extract_dialogue(df, ZH, ["doc_id"])
    assert [r.quote for r in found.orderBy("start").collect()] == ["你好啊。", "天剑阁", "嗯"]
    judged = quotes.boundary_verdict(quotes.extract_all_quotes(df, ["doc_id"]), ZH)
    verdict = {r.quote: (r.is_dialogue, round(r.confidence, 2)) for r in judged.collect()}
    assert verdict["你好啊。"][0] and verdict["你好啊。"][1] >= 0.5
    assert verdict[""] == (False, 0.0)
    alone = quotes.boundary_verdict(quotes.extract_all_quotes(docs(spark, "匾上「天剑阁」三字，门前「砰！」一声"), ["doc_id"]), ZH)
    assert {r.quote: (r.is_dialogue, r.confidence) for r in alone.collect()} == {"天剑阁": (False, 0.3), "砰！": (False, 0.2)}
    left = quotes.remove_spans(quotes.extract_dialogue(docs(spark, "匾上「天剑阁」三字"), ZH, ["doc_id"]), alone.where(~F.col("is_dialogue")), ["doc_id"])
    assert left.count() == 0


def test_overlapping_pairs_give_way(spark):
    found = quotes.extract_dialogue(docs(spark, "「甲『乙』丙」『丁』"), ZH, ["doc_id"]).orderBy("start").collect()
    assert [r.quote for r in found] == ["甲『乙』丙", "丁"]


def test_marking_sentences(spark):
    s = spark.createDataFrame([(1, 0, "他说「好」"), (1, 1, "走了"), (2, 0, "他说「好」")], "doc_id long, sentence_index int, sentence string")
    q = spark.createDataFrame([(1, 1, "好", "乙"), (1, 0, "好", "甲"), (1, 2, " ", "丙")], "doc_id long, quote_index int, quote string, speaker string")
    got = {(r.doc_id, r.sentence_index): (r.is_dialogue, r.speaker) for r in quotes.mark_dialogue(s, q, ["doc_id"]).collect()}
    assert got == {(1, 0): (True, "甲"), (1, 1): (False, ""), (2, 0): (False, "")}


def test_groups_and_kinds(spark):
    df = spark.createDataFrame([("3人齐声道", "GROUP:3"), ("11人道", None), ("众人道", "GROUP:CROWD"), ("林雪道", None)], "c string, want string")
    assert df.where(~quotes.group_speaker(F.col("c"), ZH).eqNullSafe(F.col("want"))).count() == 0
    kind = df.limit(1).select(quotes.quotation_type(F.lit("纸上写着"), (("written", ("写着",)), ("speech", ("道", "说道")))).alias("k")).first().k
    assert kind.type == "written" and kind.confidence == 0.95
    sure = df.limit(1).select(quotes.sentence_kind(F.lit("「好」"), "x", "道", "y").alias("k")).first().k
    assert sure.is_dialogue and sure.confidence == 0.95


def test_mis_merged_names(spark):
    text = "萧炎看着。" * 12 + "萧炎冷道。"
    names = spark.createDataFrame([(1, "萧炎", 0.6), (1, "萧炎冷", 0.6)], "doc_id long, name string, confidence double")
    got = {r.name: r.new_confidence for r in entities.validate(docs(spark, text), names, ZH, ["doc_id"]).collect()}
    assert got["萧炎冷"] == 0.1 and got["萧炎"] >= 0.6


def test_confidence_ladder(spark):
    # n, diversity, co_diversity, high_co, templates, hits, wanted
    rows = [(1, 1, 0, 0, 0, 0, 0.3), (1, 1, 0, 0, 3, 5, 0.6), (3, 1, 0, 0, 0, 0, 0.2), (3, 1, 3, 2, 0, 0, 0.6), (5, 2, 0, 0, 0, 0, 0.8), (3, 2, 0, 0, 0, 0, 0.6), (4, 3, 0, 0, 3, 5, 0.6)]
    df = spark.createDataFrame(rows, "n int, d int, c int, h int, t int, k int, want double")
    got = entities.rescored(F.lit(0.6), F.col("n"), F.col("d"), F.col("c"), F.col("h"), F.col("t"), F.col("k"))
    assert df.where(got != F.col("want")).count() == 0


def test_role_names_near_quotes(spark):
    text = "林雪笑道：「好。」" + "字" * 300 + "\n林雪道：「走。」"
    found = quotes.extract_dialogue(docs(spark, text), ZH, ["doc_id"])
    from dataclasses import replace

    got = entities.role_names(docs(spark, text), found, replace(ZH, name_pattern="林雪|字字"), ["doc_id"]).collect()
    assert {r.name for r in got if r.n_positions == 2} == {"林雪"}


def test_compounds_suffixes_and_surnames(spark):
    text = "林雪说道。林雪走出。林木高。"
    heads = spark.createDataFrame([(1, "林")], "doc_id long, name string")
    got = entities.compound_names(docs(spark, text), heads, ZH, ["doc_id"]).collect()
    assert [(r.name, r.n) for r in got] == [("林雪", 2)]
    s = entities.surnames(docs(spark, "王长老李长老王长老王长老的长老"), ("长老",), ("王", "李")).collect()
    assert [(r.surname, r.n) for r in s] == [("王", 3)]
    stats = spark.createDataFrame([("甲尊", 9), ("乙尊", 8), ("丙尊", 7), ("丁x", 1)], "name string, n int")
    assert [(r.suffix, r.n_names) for r in entities.name_suffixes(stats, ZH).collect()] == [("尊", 3)]


def test_tokens_and_names(spark):
    t = spark.createDataFrame([(1, 0, "林", "PER"), (1, 1, "雪", "PER"), (1, 2, "在", "O"), (1, 3, "京", "LOC")], "d int, i int, token string, type string")
    assert sorted((r.first, r.entity) for r in entities.merge_runs(t, ["d"], "i").collect()) == [(0, "林雪"), (2, "在"), (3, "京")]
    b = spark.createDataFrame([(1, i, w) for i, w in enumerate("林雪 说道 林雪 说道 王五 说道".split())], "d int, i int, token string")
    known = spark.createDataFrame([(1, "张三")], "d int, name string")
    assert [(r.name, r.n) for r in entities.boundary_names(b, known, ZH, ["d"], "i").collect()] == [("林雪", 2)]
    one = spark.range(1)
    assert one.select(entities.cleaned_hint(F.lit("林雪轻轻地说道"), ZH).alias("x")).first().x == "林雪"
    assert one.select(entities.srl_agent(F.lit("门口的林雪"), ("长老",)).alias("x")).first().x == "林雪"
    assert one.select(entities.valid_name(F.lit("林雪的"), (), ("说",)).alias("x")).first().x is False
    assert one.select(entities.clean_person(F.lit("林"), ("王",), ()).alias("x")).first().x == 0.3
    assert one.select(entities.descriptive_roles(F.lit("白发的老者和少女，少女"), ZH).alias("x")).first().x == ["白发的老者", "少女"]


LIBRARY = [(1, "p", "林雪", ["雪儿"], "female", 1, False), (2, "p", "萧炎", [], "male", 2, False), (3, "q", "林雪", [], "female", 1, True)]
SCHEMA = "id long, project string, name string, aliases array<string>, gender string, first_appearance int, is_locked boolean"


def test_linking(spark):
    library = spark.createDataFrame(LIBRARY, SCHEMA)
    rows = [("p", "林雪", "PER", 0.3), ("p", "雪儿", "PER", 0.3), ("p", "萧炎哥", "PER", 0.3), ("p", "林", "PER", 0.9), ("p", "路人", "PER", 0.4), ("p", "路人甲", "PER", 0.7), ("p", "山", "LOC", 0.1)]
    got = {r.text: (r.standard_name, r.confidence, r.is_linked) for r in lib.link_entities(spark.createDataFrame(rows, "project string, text string, type string, confidence double"), library).collect()}
    assert got == {"林雪": ("林雪", 1.0, True), "雪儿": ("林雪", 1.0, True), "萧炎哥": ("萧炎", 0.6, True), "路人甲": (None, 0.7, False), "山": (None, 0.1, False)}


def test_library_changes(spark):
    c = spark.createDataFrame(LIBRARY, SCHEMA)
    assert lib.with_alias(c, 2, "炎帝").where("id = 2").first().aliases == ["炎帝"]
    assert lib.without_alias(c, 1, "雪儿").where("id = 1").first().aliases == []
    assert lib.set_gender(c, 1, "unknown").where("id = 1").first().gender == "unknown"
    with pytest.raises(ValueError):
        lib.set_gender(c, 1, "x")
    assert [r.id for r in lib.set_lock(c, "p", 2, True).where("is_locked").orderBy("id").collect()] == [2, 3]
    assert lib.all_names(c).count() == 4
    more = lib.add_columns(c, {"voice": "string", "name": "string"})
    assert more.columns[-1] == "voice" and more.count() == 3
    assert lib.insert_ignore(c, c.limit(2), ["project", "name"]).count() == 3
    assert lib.delete_rows(c, c.where("project = 'p'"), ["id"]).count() == 1
    new = lib.find_or_create(spark.createDataFrame([("p", "雪儿", ""), ("p", "王小姐", "她"), ("q", "赵四", "他")], "project string, name string, context string"), c, ZH)
    assert [(r.id, r.name, r.gender) for r in new.where("id > 3").orderBy("id").collect()] == [(4, "王小姐", "female"), (5, "赵四", "male")]


def test_speaker_hints_and_selection(spark):
    one = spark.range(1)
    hint = lambda t: one.select(speakers.speaker_hint(F.lit(t), ZH).alias("x")).first().x
    assert hint("林雪冷冷道：") == "林雪" and hint("萧炎对林雪说：") == "萧炎" and hint("天黑了") is None
    c = spark.createDataFrame([(1, "甲", 0.8, "a", 1), (1, "乙", 0.8, "b", 2), (1, "甲", 0.95, "c", 3), (2, "丙", 0.9, "a", 1)], "q int, name string, confidence double, source string, source_rank int")
    ranked = speakers.rank_candidates(c, ["q"], ("他",))
    assert [(r.name, r.confidence) for r in ranked.where("q = 1").orderBy("rank").collect()] == [("甲", 0.8), ("乙", 0.8)]
    library = spark.createDataFrame([(1, "p", "甲", [], "male", 1, False)], SCHEMA)
    assert {r.q: r.speaker for r in speakers.select_speaker(ranked, library, ["q"]).collect()} == {1: "甲", 2: None}


def test_activity_is_the_fold(spark):
    from math import exp

    turns = [(1, w, t) for t, w in enumerate("abacba")]
    want: dict = {}
    for _, w, t in turns:
        x, at = want.get(w, (0.0, t))
        want[w] = (x * exp(-0.05 * (t - at)) + 1, t)
    df = spark.createDataFrame(turns, "d int, w string, t int")
    for f in (speakers.activity_weights, speakers.activity_weights_by_join):
        got = {r.w: r.activity for r in f(df, ["d"], "w", "t").collect()}
        assert all(abs(got[w] - x * exp(-0.05 * (5 - at))) < 1e-9 for w, (x, at) in want.items())


def test_instability_and_backfill(spark):
    t = spark.createDataFrame([(1, i, s) for i, s in enumerate("ababab")], "d int, i int, s string")
    assert [r.changes for r in speakers.instability(t, ["d"], "i", "s").orderBy("i").collect()] == [0, 1, 2, 3, 4, 5][:5] + [5]
    s = spark.createDataFrame([(1, "萧炎冷笑", ""), (1, "没人", "未知"), (1, "林雪", "甲")], "d int, sentence string, speaker string")
    n = spark.createDataFrame([(1, "萧炎"), (1, "萧"), (1, "林雪")], "d int, name string")
    assert {r.sentence: r.speaker for r in speakers.backfill_unknown(s, n, ["d"]).collect()} == {"萧炎冷笑": "萧炎", "没人": "未知", "林雪": "甲"}


def test_prompts(spark):
    row = spark.createDataFrame([("好", "前", "后", ["甲", "乙"], " 2. 乙", "我选甲", "不知")], "q string, p string, s string, o array<string>, a string, b string, c string")
    got = row.select(speakers.model_prompt(F.col("q"), F.col("p"), F.col("s"), F.col("o")).alias("m"), *(speakers.parse_choice(F.col(x), F.col("o")).alias(x) for x in "abc")).first()
    assert got.m == "前「好」后\n1. 甲\n2. 乙" and (got.a, got.b, got.c) == ("乙", "甲", None)


def test_sounds(spark):
    rows = sounds.detect_sounds(docs(spark, "轰隆隆一声，砰！沙沙沙"), ZH, ["doc_id"]).orderBy("start").collect()
    assert [(r.word, r.start, r.type) for r in rows] == [("轰隆隆", 0, "impact"), ("砰", 6, "impact"), ("沙沙", 8, "nature"), ("沙沙", 9, "nature")]
    assert sounds.detect_sounds(docs(spark, "哒哒"), ZH, ["doc_id"], extra=("哒哒",)).first().type == "other"
    assert sounds.detect_sounds(docs(spark, "砰"), ZH, ["doc_id"], removed=("砰",)).count() == 0
    assert [r.word for r in sounds.detect_sounds(docs(spark, "轰，啦啦"), ZH, ["doc_id"], repeats="[啦轰]{2,}").collect()] == ["轰", "啦啦"]


def test_clusters_and_vectors(spark):
    e = spark.createDataFrame([("p", "林雪", 5, [1.0, 0.0]), ("p", "雪儿", 3, [0.99, 0.14]), ("p", "萧炎", 4, [0.0, 1.0]), ("p", "炎炎", 1, [0.6, 0.8])], "project string, name string, n int, vector array<double>")
    got = {r.name: r.leader for r in similarity.leader_clusters(e, ["project"]).collect()}
    assert got == {"林雪": "林雪", "雪儿": "林雪", "萧炎": "萧炎", "炎炎": "炎炎"}
    relabelled = similarity.relabel(e.withColumn("confidence", F.lit(0.5)), similarity.leader_clusters(e, ["project"]), ["project"])
    assert sorted((r.name, r.confidence) for r in relabelled.collect()) == [("林雪", 0.5), ("林雪", 0.7), ("炎炎", 0.5), ("萧炎", 0.5)]
    pairs = similarity.character_overlap(spark.createDataFrame([("林雪", "雪儿")], "a string, b string"), "a", "b").first()
    assert pairs.overlap == pytest.approx(1 / 3)


STORY = '第一章 相遇\n林雪走进门，笑道：「你终于来了。」\n萧炎怒道：「滚！废物！」\n「好吧。」\n她转身离开，再也见不到他了。\n第二章 离别\n萧炎说道：「保重，后会有期。」天色已晚，他走远了。'


def test_whole_analysis(spark):
    library = spark.createDataFrame([(1, 1, "林雪", [], "female", 1, False), (2, 1, "萧炎", [], "male", 2, False)], SCHEMA.replace("project string", "project long"))
    a = analyze(docs(spark, STORY), library, ZH)
    assert a.chapters.count() == 2
    said = {r.quote: r.speaker for r in a.quotes.collect()}
    assert said["你终于来了。"] == "林雪" and said["滚！废物！"] == "萧炎" and said["保重，后会有期。"] == "萧炎"
    rows = {r.sentence: r for r in a.sentences.collect()}
    angry = next(r for s, r in rows.items() if "废物" in s)
    assert angry.emotion_label == "anger" and angry.is_dialogue and angry.speaker == "萧炎"
    assert sum(r.n_sentences for r in a.statistics.collect()) == len(rows)
