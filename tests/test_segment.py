import pytest
from pyspark.sql import functions as F

from loomspark.functions.text import keep_earliest, last_index, matches, occurrences, positions, strip
from loomspark.operators import segment
from loomspark.packs import LATIN, ZH


def docs(spark, *texts):
    return spark.createDataFrame(list(enumerate(texts, 1)), "doc_id long, text string")


def value(spark, text, column):
    return spark.createDataFrame([(text,)], "t string").select(column(F.col("t")).alias("v")).first().v


@pytest.mark.parametrize(
    ("text", "want"),
    [
        ("苏夜说道：「你好。我是苏夜。」", ["苏夜说道：「你好。我是苏夜。」"]),
        ("苏夜站在门口。\n「滚出去！」\n林雪愣住了。", ["苏夜站在门口。", "「滚出去！」", "林雪愣住了。"]),
        ("第一章。苏夜醒来。他看了看四周。", ["第一章。", "苏夜醒来。", "他看了看四周。"]),
        ("什么？！", ["什么？", "！"]),
        ("没有引号「未完。后面。", ["没有引号「未完。", "后面。"]),
        ('"一。二。"他说。完', ['"一。二。"他说。', "完"]),
        ("\n \n", []),
        ("", []),
    ],
)
def test_smart_sentences(spark, text, want):
    assert value(spark, text, lambda c: segment.smart_sentences(c, ZH)) == want


def test_smart_sentences_of_a_long_line(spark):
    text = "他说「好。」" * 20000 + "。"
    got = value(spark, text, lambda c: segment.smart_sentences(c, ZH))
    assert got == [text]


def test_sentence_offsets_of_repeats(spark):
    rows = segment.sentences(docs(spark, "a. b. a. a."), LATIN, ["doc_id"]).orderBy("sentence_index").collect()
    assert [(r.start, r.end, r.sentence) for r in rows] == [(0, 2, "a."), (3, 5, "b."), (6, 8, "a."), (9, 11, "a.")]


NOVEL = "序言在这里，足够长的内容。\n卷一 起\n第一章 开始\n内容内容内容内容内容内容。\n第二章 继续\n更多更多更多更多更多更多。\n卷二 落\n第三章 转折\n结尾结尾结尾结尾结尾结尾。\n第四章 短\n短。"


def test_chapters_restart_in_every_volume(spark):
    rows = segment.split_chapters(docs(spark, NOVEL), ZH).orderBy("start").collect()
    assert [(r.volume_index, r.chapter_index, r.title) for r in rows] == [(0, 0, "第一章 开始"), (0, 1, "第二章 继续"), (1, 0, "第三章 转折")]
    assert rows[1].content == "更多更多更多更多更多更多。" and rows[1].volume_title == "卷一 起"


def test_chapters_before_the_first_volume(spark):
    rows = segment.split_chapters(docs(spark, "第一章 前\n" + "字" * 20 + "\n卷一 起\n第一章 后\n" + "字" * 20), ZH).orderBy("start").collect()
    assert [(r.volume_index, r.volume_title, r.chapter_index) for r in rows] == [(0, "序卷", 0), (1, "卷一 起", 0)]


def test_chapter_patterns(spark):
    for head in ("第12章 甲", "Chapter 3 x", "一、甲", "3. x", "【第一章】甲", "## 第一章：甲"):
        rows = segment.split_chapters(docs(spark, f"{head}\n" + "字" * 12), ZH).collect()
        assert [r.title for r in rows] == [head]
    info = segment.structure_info(segment.split_chapters(docs(spark, NOVEL), ZH)).orderBy("volume_index").collect()
    assert [(r.n_chapters, r.titles) for r in info] == [(2, "第一章 开始|第二章 继续"), (1, "第三章 转折")]


def test_repeated_heading_nearby_counts_once(spark):
    rows = segment.split_chapters(docs(spark, "第一章 甲\n第一章 甲\n" + "字" * 20), ZH).collect()
    assert len(rows) == 1


@pytest.mark.parametrize("n", [0, 1, 5000, 5001, 9800, 9801, 12345])
def test_chunks_cover_a_text_without_headings(spark, n):
    text = "".join(chr(97 + i % 26) for i in range(n))
    rows = segment.split_chapters(docs(spark, text), ZH).orderBy("start").collect()
    assert rows[0].start == 0 and rows[-1].end == n
    assert all(r.content == text[r.start : r.end] for r in rows)
    assert all(a.end - b.start == 200 for a, b in zip(rows, rows[1:], strict=False))
    assert rows[0].title == ("全文" if n <= 5000 else "第1段（自动分割）")


def test_fragments(spark):
    got = value(spark, "他笑道：「你好。」然后走了。", lambda c: segment.fragments(c, ZH))
    assert [(x.type, x.text) for x in got] == [("narration", "他笑道："), ("dialogue", "「你好。」"), ("narration", "然后走了。")]
    whole = value(spark, "「你好。」", lambda c: segment.fragments(c, ZH))
    assert [(x.type, x.text) for x in whole] == [("narration", "「你好。」")]


def test_entity_boundaries(spark):
    rows = [("「林」走了", "林", True), ("林走了", "林", False), ("树林里", "林", False), ("树林", "林", False), ("林", "林", True), ("萧炎道", "萧炎", True), ("x", "y", False)]
    df = spark.createDataFrame(rows, "s string, n string, want boolean")
    assert df.where(segment.entity_in(F.col("s"), F.col("n")) != F.col("want")).count() == 0


def test_narration_and_samples(spark):
    assert value(spark, "他说「好」，走了“嗯”", segment.narration) == "他说，走了"
    row = segment.dialogue_samples(docs(spark, "林雪问道：「你要去哪里呢？」说完"), ZH).first()
    assert (row.quote, row.has_guide_word, row.is_question) == ("你要去哪里呢？", True, True)
    grams = [r.gram for r in segment.keyword_grams(docs(spark, "你好吗 ab 再见"), ["doc_id"], "text").collect()]
    assert sorted(grams) == sorted(["你好", "好吗", "你好吗", "再见"])


def test_text_functions(spark):
    got = value(spark, "a「b」c「d」", lambda c: matches(c, "「[^」]+」"))
    assert [(x.start, x.end, x.text) for x in got] == [(1, 4, "「b」"), (5, 8, "「d」")]
    assert value(spark, "", lambda c: matches(c, "x")) == []
    assert value(spark, "abcabcab", lambda c: positions(c, F.lit("ab"))) == [0, 3, 6]
    assert value(spark, "a.b.c", lambda c: positions(c, F.lit("."))) == [1, 3]
    assert value(spark, "aaaa", lambda c: occurrences(c, F.lit("aa"))) == 2
    assert value(spark, "abcab", lambda c: last_index(c, F.lit("ab"))) == 3
    assert value(spark, "abc", lambda c: last_index(c, F.lit("x"))) == -1
    assert value(spark, "　 a \n", strip) == "a"
    spans = value(spark, "x", lambda c: keep_earliest(F.from_json(F.lit('[{"start":0,"end":5,"text":"a"},{"start":3,"end":8,"text":"b"},{"start":5,"end":6,"text":"c"}]'), "array<struct<start:int,end:int,text:string>>")))
    assert [s.text for s in spans] == ["a", "c"]


def test_strided(spark):
    df = spark.range(10).select("id", (F.col("id") % 2).alias("g"))
    assert sorted(r.id for r in segment.strided(df, ["id"], ["g"], 2).collect()) == [0, 1, 4, 5, 8, 9]
