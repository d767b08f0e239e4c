import corpus_pipeline
from tests.conftest import SF


def test_pipeline_stages(spark):
    first = spark.read.parquet(f"{SF}/documents.parquet")
    docs = first
    seen = {}
    for name, stage in corpus_pipeline.STAGES:
        docs = corpus_pipeline.kept(stage(spark, docs, SF), name)
        seen[name] = docs
        if name != "packing":
            assert docs.dtypes == first.dtypes
    ids = lambda name: {r.doc_id for r in seen[name].select("doc_id").collect()}
    assert len(ids("language_id")) >= 0.98 * first.count()
    assert ids("near_dedup") < ids("language_id") and ids("pii") == ids("near_dedup")
    assert ids("source_mix") <= ids("pii")
    assert seen["pii"].where("text rlike '[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+([.][A-Za-z0-9-]+)+'").count() == 0
    rows = seen["packing"].selectExpr("sum(length) n").first().n
    assert rows == seen["source_mix"].mapInArrow(_tokens, "n long").selectExpr("sum(n) n").first().n


def _tokens(batches):
    import pyarrow as pa
    from tokenizers import Tokenizer

    from loomspark.llm.packing import tokenizer_path

    tok = Tokenizer.from_file(tokenizer_path())
    for b in batches:
        yield pa.record_batch([pa.array([len(tok.encode(t, add_special_tokens=False).ids) + 1 for t in b.column("text").to_pylist()], pa.int64())], names=["n"])


def test_registered(spark):
    import __spark_entry__ as entry

    names = entry.queries()
    assert "pipeline" in names and sum(n.startswith("op") for n in names) == 13


def test_stages_on_edge_rows_and_on_none(spark, edge, nothing):
    """Nulls, empty, repeated and copied texts and repeated ids through every stage, and an empty table through all of them."""
    columns = "doc_id long, text string, lang string, source string, n_chars long"
    docs = edge.selectExpr("doc_id", "text", "lang", "source", "cast(length(text) as long) n_chars")
    seen = {"start": docs}
    for name, stage in corpus_pipeline.STAGES:
        docs = corpus_pipeline.kept(stage(spark, docs, SF), name)
        seen[name] = docs
        assert name == "packing" or docs.columns == seen["start"].columns
    good = {r.doc_id for r in seen["language_id"].select("doc_id").collect()}
    assert good >= {1, 2, 3, 9, 10, 12} and not good & {4, 5, 6}
    near = [r.doc_id for r in seen["near_dedup"].select("doc_id").collect()]
    assert len([i for i in near if i is not None]) == len(set(near) - {None})  # repeated rows of an id stay once
    assert 1 in near and not {2, 3} & set(near)
    assert seen["pii"].count() == len(near)
    assert {r.doc_id for r in seen["packing"].select("doc_id").collect()} == {r.doc_id for r in seen["source_mix"].select("doc_id").collect()}
    docs = spark.createDataFrame([], columns)
    for name, stage in corpus_pipeline.STAGES:
        docs = corpus_pipeline.kept(stage(spark, docs, SF), name)
        assert docs.count() == 0
