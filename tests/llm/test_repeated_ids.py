from loomspark.llm.minhash_dedup import near_duplicates
from tests.llm.conftest import prose
from tests.llm.test_dedup import brute_components


def test_texts_of_one_id_are_linked(spark):
    a, b = prose(60, 1), prose(60, 2)
    rows = [(3, a), (5, a), (5, b), (9, b), (11, prose(60, 6))]
    want, _ = brute_components(rows, 3, 85)
    got = near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert len(got) == len(rows) and {(r.doc_id, r.component_id) for r in got} == set(want.items()) == {(3, 3), (5, 3), (9, 3), (11, 11)}
