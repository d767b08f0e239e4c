"""Steps whose time or memory grew too fast."""

import time

from pyspark.sql import functions as F

from loomspark.operators import entities, name_rules, tagger
from loomspark.packs import LATIN
from loomspark.plans.tagger_queries import _RULES
from loomspark.sources.tables import BATCH_ROWS


def test_foreign_names_of_many_tokens(spark):
    rules = name_rules.NameRules(surnames=("x",), foreign_titles=("Sir",), name_joints=("·",), name_links=("and",))
    tokens, tags = ["A", "·", "B", "z", "A", " ", "B", "Sir", "z", "A", "z"], ["NR", "", "NR", "", "NR", "", "NR", "", "", "NR", ""]
    df = spark.createDataFrame([(tokens * 20_000, tags * 20_000)], "t array<string>, g array<string>").repartition(1).cache()
    df.count()
    start = time.time()
    got = df.select(F.explode(name_rules.foreign_names(F.col("t"), F.col("g"), rules)).alias("e")).groupBy("e.text").agg(F.count(F.lit(1)).alias("n"), F.min("e.start").alias("s"), F.max("e.end").alias("e")).collect()
    assert time.time() - start < 15
    assert {tuple(r) for r in got} == {("A·B", 20_000, 0, 219_992), ("A BSir", 20_000, 4, 219_997)}


def test_tags_of_many_sentences(spark):
    rows = spark.range(400_000, numPartitions=4).select(F.concat(F.lit("No erra, said Thingen ver and un "), F.col("id").cast("string"), F.lit(" la bleon.")).alias("s")).cache()
    rows.count()
    start = time.time()
    assert rows.select(tagger.tag(F.col("s"), _RULES).alias("t")).groupBy("t.emotion").count().collect()[0][1] == 400_000
    assert time.time() - start < 15


def test_texts_go_to_python_in_small_batches(spark):
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "10000")
    docs = spark.createDataFrame([(1, "Qa the Qa and Qb of")], "doc_id long, text string")
    heads = spark.createDataFrame([(1, "Q")], "doc_id long, name string")
    assert {(r.name, r.n) for r in entities.compound_names(docs, heads, LATIN, ["doc_id"]).collect()} == {("Qa", 2)}
    assert int(spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")) <= BATCH_ROWS


def test_one_small_file_is_dealt_over_the_cores(spark, tmp_path):
    from loomspark.plans.queries import QUERIES
    from tests.conftest import SF

    cores = spark.sparkContext.defaultParallelism
    assert QUERIES["volume_chapters"](spark, SF).rdd.getNumPartitions() >= cores
    assert QUERIES["foreign_names"](spark, SF).rdd.getNumPartitions() >= cores


def written(spark, run):
    """The most rows that a stage of run() writes to a shuffle, and what run() gives."""
    sc = spark.sparkContext
    store, bus = sc._jsc.sc().statusStore(), sc._jsc.sc().listenerBus()
    stages = lambda: (bus.waitUntilEmpty(), {(x.stageId(), x.attemptId()): x.shuffleWriteRecords() for x in map(store_list().apply, range(store_list().size()))})[1]
    store_list = lambda: store.stageList(None, False, False, sc._gateway.new_array(sc._jvm.double, 0), sc._jvm.java.util.ArrayList())
    before = stages()
    got = run()
    return max(n for k, n in stages().items() if k not in before), got


def test_names_of_many_documents_are_not_paired(spark, tmp_path):
    from loomspark.plans.queries import QUERIES

    many = ["Q" + "".join(chr(97 + i // 26**k % 26) for k in range(3)) for i in range(300)]
    lines = [(i, " ".join(many)) for i in range(60)]
    lines += [(100, f"Lone x Lone x Lone {many[0]} {many[1]}\n{many[2]} Lone"), (101, "Sole x Sole\nSole x"), (None, "Nil Nil Nil Qaaa Qbaa Qcaa")]
    spark.createDataFrame(lines, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    most, rows = written(spark, lambda: QUERIES["confidence_ladder"](spark, str(tmp_path)).collect())
    assert most <= 61 * 300  # not 300 * 299 / 2 pairs a task
    got = {r.name: (r.n, r.confidence) for r in rows}
    assert len(got) == 303 and got["Lone"] == (4, 0.6) and got["Sole"] == (3, 0.2) and got["Nil"] == (3, 0.2) and {got[n][1] for n in many} == {0.8}


def test_pairs_of_asked_names_are_those_of_all_pairs(spark):
    # document 1 has two rows; its first lines are one group
    rows = [(1, 0, "A"), (1, 0, "B"), (1, 0, "A"), (1, 1, "A"), (1, 0, "C"), (2, 0, "B"), (2, 0, "C"), (2, 1, "A"), (2, 1, "C"), (3, 0, "C"), (None, 0, "B"), (None, 0, "D")]
    seen = spark.createDataFrame(rows, "d long, n int, name string").repartition(3)
    whole = {tuple(r) for r in entities.cooccurrence(seen, ["d", "n"]).collect()}
    assert whole == {(x, y, k) for a, b, k in (("A", "B", 1), ("A", "C", 2), ("B", "C", 2)) for x, y in ((a, b), (b, a))}
    assert {tuple(r) for r in entities.cooccurrence(seen, ["d", "n"], tasks=7).collect()} == whole
    of = spark.createDataFrame([(1, "B"), (3, "C"), (4, "A")], "d long, name string")
    for tasks in (None, 7):
        assert {tuple(r) for r in entities.cooccurrence(seen, ["d", "n"], of=of, tasks=tasks).collect()} == {("B", "A", 1), ("B", "C", 1)}
    counts = spark.createDataFrame([("A", 5), ("B", 4), ("C", 9)], "name string, n long")
    assert {tuple(r) for r in entities.cooccurrence_stats(entities.cooccurrence(seen, ["d", "n"]), counts).collect()} == {("A", 2, 2), ("B", 2, 3), ("C", 2, 2)}


def test_partners_of_many_names_in_a_line_are_not_paired(spark):
    """Texts and names are dealt by their ids and nothing else moves: a line's pairs were 4.5 million rows of two shuffles here."""
    words = [f"N{i:04}" for i in range(3000)]
    docs = spark.createDataFrame([(1, " ".join(words) + "\n" + " ".join(words[:2] * 6)), (1, "N0000"), (2, None), (None, "N0000 N0001")], "doc_id long, text string")
    names = spark.createDataFrame([(i, n, 0.6) for i in (1, 2, None) for n in words], "doc_id long, name string, confidence double")
    out = entities.validate(docs, names, LATIN, ["doc_id"])
    assert out._jdf.queryExecution().executedPlan().toString().count("Exchange hashpartitioning") == 2
    got = {(r.doc_id, r.name, r.n): (r.co_diversity, r.high_conf_co) for r in out.collect()}
    assert len(got) == 9000 and all(i is not None for i, _, _ in got)  # N0000 and others have a row for each text
    assert got[1, "N0000", 7] == (2999, 2) and got[1, "N0000", 1] == (2999, 2) and got[1, "N0001", 7] == (2999, 2) and got[1, "N2999", 1] == (2999, 2)
    assert got[2, "N0000", 0] == (None, None)
