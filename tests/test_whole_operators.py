"""Operators at the bounds of what they once did."""

from collections import Counter

import numpy as np

from loomspark.operators import characters, entities, similarity
from loomspark.packs import ZH
from loomspark.plans.queries import QUERIES


def test_sounds_beyond_100000_characters(spark, tmp_path):
    text = "the shore re " * 9000 + "rere"
    spark.createDataFrame([(1, text)], "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    n, total = Counter(), Counter()
    for s in range(len(text)):
        if word := next((w for w in ("rere", "the", "th", "sh", "re", "er") if text.startswith(w, s)), None):
            n[word] += 1
            total[word] += s
    assert {(r.word, r.n, r.sum_start) for r in QUERIES["sfx_longest_match"](spark, str(tmp_path)).collect()} == {(w, n[w], total[w]) for w in n}


def test_more_queries_than_one_block(spark):
    vectors = np.random.default_rng(5).normal(size=(60, 8)).tolist()
    items = spark.createDataFrame(list(enumerate(vectors)), "id long, v array<double>")
    show = lambda most, **k: {(r.query_id, r.id, round(r.similarity, 6)) for r in similarity.rank_by_similarity(items.where("id % 2 = 0"), items, "id", "v", most_queries=most, **k).collect()}
    for k in ({"top": 5, "threshold": -1.0}, {"threshold": 0.3}):
        assert show(7, **k) == show(100, **k)


def test_core_name_that_is_an_alias(spark):
    library = spark.createDataFrame([(1, "p", "林雪", ["小白"])], "id long, project string, name string, aliases array<string>")
    found = spark.createDataFrame([("p", "小白姑娘", "PER", 0.3)], "project string, text string, type string, confidence double")
    assert [(r.standard_name, r.confidence, r.is_linked) for r in characters.link_entities(found, library).collect()] == [("林雪", 0.6, True)]


def test_validation_counts_partners(spark):
    text = "\n".join(["甲一，乙二乙二，丙三丙三，丁四。"] * 3)
    docs = spark.createDataFrame([(1, text)], "doc_id long, text string")
    names = spark.createDataFrame([(1, n, 0.4) for n in ("甲一", "乙二", "丙三", "丁四")], "doc_id long, name string, confidence double")
    got = {r.name: r for r in entities.validate(docs, names, ZH, ["doc_id"]).collect()}
    assert (got["甲一"].co_diversity, got["甲一"].high_conf_co) == (3, 6)
    assert got["甲一"].new_confidence == 0.5


def test_prefix_that_no_word_follows(spark, tmp_path):
    rows = [(i, "Abcde.") for i in range(21)] + [(21, "Abcdes the rest.")]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    assert [tuple(r) for r in QUERIES["prefix_mismerge"](spark, str(tmp_path)).collect()] == [("Abcdes", "Abcde")]


def test_ranks_of_many_copies_and_repeated_ids(spark):
    rng = np.random.default_rng(7)
    vectors = rng.normal(size=(40, 4)).tolist()
    rows = [(i, vectors[i % 40]) for i in range(1500)] + [(0, vectors[1]), (7, None)]
    items = spark.createDataFrame(rows, "id long, v array<double>").repartition(3)
    got = similarity.rank_by_similarity(items.where("id = 50"), items, "id", "v", 5, -1.0)
    assert [(r.id, round(r.similarity, 6)) for r in got.orderBy("rank").collect()] == [(10, 1.0), (90, 1.0), (130, 1.0), (170, 1.0), (210, 1.0)]
    from loomspark.operators.similarity import BLOCK, CHUNK

    assert BLOCK * CHUNK * 8 <= 16e6  # bytes of one product, of which a task holds a few


def test_many_leaders_in_one_project(spark):
    import time

    vectors = np.random.default_rng(3).normal(size=(6000, 32)).tolist()
    rows = [("p", f"v{i:05}", 0, v) for i, v in enumerate(vectors)] + [("p", f"w{i:05}", -1, vectors[i]) for i in range(50)]
    entities_ = spark.createDataFrame(rows, "project string, name string, n int, vector array<double>").cache()
    entities_.count()
    start = time.time()
    got = {r.name: r.leader for r in similarity.leader_clusters(entities_, ["project"]).collect()}
    assert time.time() - start < 20  # a step for each pair took longer
    assert all(got[f"v{i:05}"] == f"v{i:05}" for i in range(6000)) and all(got[f"w{i:05}"] == f"v{i:05}" for i in range(50))
