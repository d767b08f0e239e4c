import pandas as pd
import pytest
from pyspark.sql import functions as F

from loomspark.operators import metrics, voices
from loomspark.sources import stores, texts
from loomspark.streaming import state


def test_reading_texts(spark, tmp_path):
    (tmp_path / "甲.txt").write_text("你好", encoding="utf-8")
    (tmp_path / "乙.txt").write_bytes("中文内容".encode("gbk"))
    (tmp_path / "空.txt").write_text(" ")
    (tmp_path / "x.md").write_text("no")
    rows = {r.title: (r.text, r.error) for r in texts.read_texts(spark, str(tmp_path)).collect()}
    assert rows == {"甲": ("你好", None), "乙": ("中文内容", None), "空": (None, "empty")}
    guarded = texts.guarded(spark.createDataFrame([("a",), ("bbbb",), (None,)], "text string"), 3).collect()
    assert [r.error for r in guarded] == [None, "too long", "encoding"]
    assert texts.inline_text(spark, "t", "x").first().title == "t"


def test_stores(spark, tmp_path):
    df = spark.createDataFrame([("1", "t", "x")], "id string, title string, text string")
    stores.write_project_store(df, str(tmp_path / "p"))
    assert stores.read_project_store(spark, str(tmp_path / "p")).collect() == df.collect()
    (tmp_path / "l.json").write_text('{"words": ["砰", "轰"]}')
    assert {r.word for r in stores.read_lexicon(spark, str(tmp_path / "l.json"), ["砰", "咚"]).collect()} == {"砰", "轰", "咚"}
    (tmp_path / "k.md").write_text("# t\n| id | label |\n|----|----|\n| 1 | joy |\n| 2 | fear |\n")
    assert [tuple(r) for r in stores.read_table_lines(spark, str(tmp_path / "k.md"), ["id", "label"]).collect()] == [("1", "joy"), ("2", "fear")]
    names = spark.createDataFrame([(1, "林雪", [3, 9]), (1, "萧炎", [5])], "doc_id long, name string, positions array<int>")
    back = stores.read_role_store(stores.role_store(names))
    assert sorted(map(tuple, back.collect())) == sorted(map(tuple, names.collect()))


def test_exports(spark):
    s = spark.createDataFrame([(1, 1, "b<c"), (1, 0, "a")], "ch int, i int, t string")
    plain = stores.chapters_ssml(s, ["ch"], "i", "t", F.lit("T")).first().ssml
    assert plain == "<p><!-- T --><s>a</s><s>b<c</s></p>"
    assert "<s>b&lt;c</s>" in stores.chapters_ssml(s, ["ch"], "i", "t", F.lit("T"), True).first().ssml
    assert stores.chapters_json(s, ["ch"], "i", ["i", "t"]).first().json == '{"total_sentences":2,"sentences":[{"i":0,"t":"a"},{"i":1,"t":"b<c"}]}'


def test_metrics(spark):
    rows = [("a", "a"), ("a", "b"), ("b", "b"), ("b", None), ("c", "unknown")]
    df = spark.createDataFrame(rows, "gold string, predicted string").withColumn("g", F.lit(1))
    acc = metrics.accuracy(df, ["g"]).first()
    assert (acc.total, acc.correct, acc.accuracy, acc.unknown_rate) == (5, 2, 0.4, 0.4)
    prf = {r["class"]: (r.precision, r.recall, round(r.f1, 4)) for r in metrics.precision_recall(df).collect()}
    assert prf == {"a": (1.0, 0.5, 0.6667), "b": (0.5, 0.5, 0.5), "c": (0.0, 0.0, 0.0), "unknown": (0.0, 0.0, 0.0)}
    both = {r.mode: r.accuracy for r in metrics.compare_modes(df, df.where("gold = predicted"), ("x", "y")).collect()}
    assert both == {"x": 0.4, "y": 1.0}
    card = metrics.scorecard(spark.createDataFrame([(1.0, 0.5, -50.0)], "a double, b double, p double"), {"a": 0.5, "b": 0.5}, "p").first()
    assert (card.score, card.grade) == (45.0, "F")
    steps = spark.createDataFrame([(12000.0, 1.0), (600.0, 0.7), (5.0, 0.5)], "c double, want double")
    assert steps.where(metrics.speed_score(F.col("c")) != F.col("want")).count() == 0
    tier = spark.createDataFrame([("他说", "pronoun"), ("林雪道", "explicit"), ("x", "other")], "t string, want string")
    assert tier.where(metrics.difficulty(F.col("t"), [("pronoun", "他"), ("explicit", "道")]) != F.col("want")).count() == 0


def test_timeline(spark):
    s = spark.createDataFrame([(1, 0, "a", 2.0), (1, 1, " ", 5.0), (1, 2, "b", 3.0)], "ch int, i int, text string, d double")
    got = [(r.start_time, r.end_time) for r in voices.timeline(s, ["ch"], "i", F.col("d")).orderBy("i").collect()]
    assert got == [(0.0, 2.0), (2.0, 2.0), (2.0, 5.0)]


def stream(spark, tmp_path, batches, schema, build, mode):
    folder, sink = tmp_path / "in", f"t_{tmp_path.name.replace('-', '_')}"
    folder.mkdir()
    for i, b in enumerate(batches):
        spark.createDataFrame(b, schema).coalesce(1).write.parquet(str(folder / f"b{i}"))
    flat = tmp_path / "flat"
    flat.mkdir()
    for i in range(len(batches)):
        next((folder / f"b{i}").glob("part-*.parquet")).rename(flat / f"{i}.parquet")
    q = build(state.chapter_stream(spark, str(flat), schema, 1)).writeStream.format("memory").queryName(sink).outputMode(mode).option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
    q.awaitTermination(120)
    return spark.table(sink)


def test_streamed_promotion(spark, tmp_path):
    batches = [[("a", 1), ("b", 2), ("a", 3)], [("a", 4), ("b", 5)], [("a", 6), ("b", 7)]]
    got = stream(spark, tmp_path, batches, "name string, pos long", lambda s: state.streamed_promotions(s, "name", "pos"), "append")
    assert sorted((r.name, r.n, r.pos) for r in got.collect()) == [("a", 3, 4), ("b", 3, 7)]


def test_cold_start(spark, tmp_path):
    batches = [[("p", "x" * 2000)], [("p", "x" * 1500), ("q", "y")], [("p", "x" * 5000)]]
    got = stream(spark, tmp_path, batches, "project string, text string", lambda s: state.cold_start(s, "project", "text"), "append")
    assert [tuple(r) for r in got.collect()] == [("p", 3500)]


def test_windowed_activity_needs_no_zone(spark, tmp_path):
    t = pd.Timestamp("2024-01-01 00:10:00")
    batches = [[(t.to_pydatetime(), 1)], [((t + pd.Timedelta(minutes=5)).to_pydatetime(), 1)]]
    got = stream(spark, tmp_path, batches, "ts timestamp_ntz, user_id long", lambda s: state.windowed_activity(s, "ts", ["user_id"]), "complete")
    assert [r.n for r in got.collect()] == [2]


@pytest.mark.parametrize("name", ["entry", "queries", "oracle_sql"])
def test_contract(spark, name):
    import __spark_entry__ as e

    if name == "entry":
        assert e.entry(spark).count() > 0
    else:
        assert set(e.oracle_sql()) <= set(e.queries()) and len(e.queries()) > 50
