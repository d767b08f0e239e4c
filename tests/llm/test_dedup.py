import hashlib
import os
import re
from collections import Counter

import numpy as np

from loomspark.llm.components import components
from loomspark.llm.exchange import LEAST_BITS, LEAST_BLOB, MOST_BITS, Blocks, Keys, bucketed, discard, kept, shared_keys
from loomspark.llm.minhash_dedup import near_duplicates
from loomspark.llm.substring_dedup import lengths, substring_dedup
from loomspark.llm.suffix_dedup import cover_for, suffix_dedup
from tests.llm.conftest import EDGE

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def sha(b: bytes) -> str:
    return hashlib.sha256(b).hexdigest()


def test_cover_reaches_every_pair():
    for length in (5, 60, 200, 1000):
        v, cover = cover_for(length)
        assert v <= length
        assert {(a - b) % v for a in cover.tolist() for b in cover.tolist()} == set(range(v))


def test_suffix_dedup_against_brute_force(spark, edge, nothing):
    n = 200
    texts = [(i, (t or "").encode()) for i, t in EDGE]
    count = Counter(b[k : k + n] for _, b in texts for k in range(len(b) - n + 1))
    want = Counter()
    for i, b in texts:
        gone = np.zeros(len(b), bool)
        for k in range(len(b) - n + 1):
            if count[b[k : k + n]] > 1:
                gone[k : k + n] = True
        spans = int(np.diff(np.concatenate([[0], gone.astype(int)])).clip(0).sum())
        want[i, len(b), int(gone.sum()), spans, sha(bytes(np.frombuffer(b, np.uint8)[~gone]))] += 1
    got = Counter((r.doc_id, r.n_bytes, r.n_removed, len(r.spans), r.kept_sha256) for r in suffix_dedup(edge).collect())
    assert got == want
    assert suffix_dedup(nothing).count() == 0


def test_substring_dedup_against_brute_force(spark, edge, nothing):
    n = 50
    texts = [(i, WORD.findall(t or "")) for i, t in EDGE]
    least: dict[tuple, int] = {}
    for i, w in texts:
        if i is not None:
            for k in range(len(w) - n + 1):
                key = tuple(w[k : k + n])
                least[key] = min(least.get(key, i), i)
    want = Counter()
    for i, w in texts:
        gone = [False] * len(w)
        for k in range(len(w) - n + 1):
            if i is not None and least[tuple(w[k : k + n])] < i:
                gone[k : k + n] = [True] * n
        want[i, len(w), sum(gone), sha(" ".join(x for x, g in zip(w, gone, strict=True) if not g).encode())] += 1
    got = Counter((r.doc_id, r.n_words, r.n_removed, r.kept_sha256) for r in substring_dedup(edge).collect())
    assert got == want
    assert substring_dedup(nothing).count() == 0


def test_level_lengths():
    assert lengths(50, 13) == [13, 25, 50]
    assert lengths(50, 25) == [25, 50]
    assert lengths(50, 8) == [8, 13, 25, 50]
    assert lengths(10, 20) == [10]


def brute_components(rows, k, percent):
    sets = {}
    for i, t in rows:
        w = WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
        sets.setdefault(i, []).append(frozenset(tuple(w[j : j + k]) for j in range(len(w) - k + 1)) if len(w) >= k else frozenset([tuple(w)] if w else []))
    parent = {i: i for i in sets if i is not None}

    def find(a):
        while parent[a] != a:
            a = parent[a]
        return a

    ids = sorted(parent)
    for a in ids:
        for b in ids:
            if a < b and any(x and y and 100 * len(x & y) >= percent * len(x | y) for x in sets[a] for y in sets[b]):
                x, y = find(a), find(b)
                parent[max(x, y)] = min(x, y)
    return {i: find(i) for i in ids}, sets


def test_near_duplicates_against_brute_force(spark, edge, nothing):
    for k, percent in ((3, 85), (5, 80)):
        want, sets = brute_components(EDGE, k, percent)
        rows = near_duplicates(edge, shingle=k, percent=percent).collect()
        assert len(rows) == len(EDGE)
        for r in rows:
            if r.doc_id is None:
                assert r.component_id is None and r.kept
            else:
                assert r.component_id == want[r.doc_id] and r.kept == (r.doc_id == r.component_id)
                assert r.n_shingles in {len(s) for s in sets[r.doc_id]}
    assert near_duplicates(nothing).count() == 0


def test_near_duplicates_in_a_large_group(spark):
    """Copies of one text with different amounts of change: linked to it, to each other, or to nothing."""
    r = np.random.default_rng(3)
    base = [f"w{i}" for i in r.integers(0, 5000, 160)]
    rows = [(0, " ".join(base))]
    for i in range(1, 160):
        w = list(base)
        for j in r.choice(len(w), int(r.integers(0, 14)), replace=False):
            w[j] = f"v{r.integers(0, 5000)}"
        rows.append((i, " ".join(w)))
    want, _ = brute_components(rows, 3, 85)
    got = near_duplicates(spark.createDataFrame(rows, "doc_id long, text string").repartition(3)).collect()
    assert {x.doc_id: x.component_id for x in got} == want
    assert 1 < len(set(want.values())) < len(rows)


def test_tables_go_once_nothing_reads_them(spark, edge):
    before = {t.name for t in spark.catalog.listTables()}
    found = near_duplicates(edge)
    assert found.count() == len(EDGE) and {t.name for t in spark.catalog.listTables()} == before
    table = bucketed(spark.range(9), "gone", "id", 2)
    both = kept(table, "gone")
    discard(table)
    assert both.count() == 9 and not os.path.exists(table.loomspark_path.removeprefix("file:"))


def test_components_of_a_long_path(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(60)] + [(100, 200), (7, 7)], "u long, v long")
    got = {r.node: r.label for r in components(edges).collect()}
    assert got == {i: 0 for i in range(61)} | {100: 100, 200: 100}


def test_keys_of_a_bucket_in_ranges():
    r = np.random.default_rng(4)
    what, owners = r.integers(0, 60, 200).astype(np.uint64) << np.uint64(58), r.integers(0, 9, 200)
    for ranges in (0, 1, 3):
        hit, late = shared_keys(what, None, ranges)
        assert hit.tolist() == [(what == w).sum() > 1 for w in what]
        assert late.tolist() == [bool((what[:i] == w).any()) for i, w in enumerate(what)]
        hit, _ = shared_keys(what, owners, ranges)
        assert hit.tolist() == [bool((owners[what == w] < o).any()) for w, o in zip(what, owners, strict=True)]


def test_blobs_of_a_block_are_bounded():
    """However large the corpus, a block sends no more than 2**MOST_BITS blobs, and more than 2**LEAST_BITS only of LEAST_BLOB bytes or so."""
    r = np.random.default_rng(5)
    where, what = (r.integers(0, 1 << 63, 200_000).astype(np.uint64) * np.uint64(2) for _ in range(2))
    for total in (1 << 27, 1 << 35, 1 << 40, 1 << 47):
        count = max(1, total // (4 << 20))
        bits = Blocks(None, total, count, 1).bits_for(total / 5)
        (blobs,) = Keys(where, what, bits, True).blobs(0, 0, 0)
        assert LEAST_BITS <= bits <= MOST_BITS and blobs.num_rows <= 1 << bits
        assert bits == LEAST_BITS or 4 * len(what) / blobs.num_rows >= LEAST_BLOB / 4
        assert sum(len(b.as_py()) for b in blobs.column("keys")) == 4 * len(what)


def test_substring_levels_end_early(spark):
    docs = spark.createDataFrame([(1, " ".join(f"a{i}" for i in range(90))), (2, " ".join(f"b{i}" for i in range(90)))], "doc_id long, text string")
    assert {(r.doc_id, r.n_words, r.n_removed) for r in substring_dedup(docs).collect()} == {(1, 90, 0), (2, 90, 0)}


def test_keys_of_equal_hash_are_told_apart_by_the_second():
    import numpy as np

    from loomspark.llm.exchange import Keys

    where, what = np.array([5, 5, 5, 9, 9], np.uint64), np.array([1, 2, 1, 2, 2], np.uint64)
    keys = Keys(where, what, 4, False)
    assert len(keys.what) == 3 and keys.twice[keys.place].tolist() == [True, False, True, True, True]
    owned = Keys(where, what, 4, False, np.array([3, 3, 4, 1, 2]))
    assert len(owned.what) == 5


def test_windows_that_only_one_hash_takes_for_equal(spark, monkeypatch):
    """With a first hash that is always the same, the second still tells windows of a block apart."""
    from loomspark.llm import suffix_dedup as op

    import numpy as np

    real = op.byte_span_hashes
    monkeypatch.setattr(op, "byte_span_hashes", lambda data, length, wanted, family=0: real(data, length, wanted, family=1) if family else np.full(len(wanted), 7, np.uint64))
    row = {"lens": np.array([300, 300], np.int64).tobytes(), "data": (bytes(range(256)) + bytes(44) + bytes(range(255, -1, -1)) + bytes(44)), "replies": []}
    b = op._Block(row, 200, 4)
    b.settle_samples()
    assert len(b.suffixes) and not b.gone().any()


def test_tabulated_hashes_tell_words_apart():
    import numpy as np

    from loomspark.llm.text import Words

    r = np.random.default_rng(5)
    words = list({bytes(r.integers(97, 103, int(n)).astype(np.uint8)) for n in np.concatenate([r.integers(1, 9, 3000), r.integers(60, 70, 200), [300, 64, 65]])})
    text = b" ".join(words + words[:50])
    w = Words(np.frombuffer(text, np.uint8), np.array([len(text)]))
    for family in (0, 1):
        h = w.tabulated(family)
        assert len(set(h[: len(words)].tolist())) == len(words) and (h[len(words) :] == h[:50]).all()
    assert (w.tabulated(0) != w.tabulated(1)).all()
    assert len(Words(np.zeros(0, np.uint8), np.zeros(0, np.int64)).tabulated(0)) == 0
    ab, ba = (Words(np.frombuffer(t, np.uint8), np.array([5])).tabulated(0).tolist() for t in (b"ab cd", b"ba cd"))
    assert ab[0] != ba[0] and ab[1] == ba[1]


def _blocks_of(spark, monkeypatch, op, run):
    """How many blocks the operator makes of 4 MB in one partition, the largest's bytes, and the bytes that one batch brings to Python."""
    from loomspark.llm import exchange

    class Seen(Exception):
        pass

    def stop(*args):
        raise Seen(exchange.text_blocks(*args))

    monkeypatch.setattr(op, "text_blocks", stop)
    docs = spark.range(0, 400, 1, 1).selectExpr("id as doc_id", "repeat(concat('w', id, ' '), 2000) as text")
    try:
        run(docs)
    except Seen as seen:
        blocks = seen.args[0]
        count, largest = blocks.table.selectExpr("count(*)", "max(size)").first()
        discard(blocks.table)
        return count, largest, int(spark.conf.get("spark.sql.execution.arrow.maxBytesPerBatch"))


def test_blocks_of_near_duplicates_are_small(spark, monkeypatch):
    from loomspark.llm import minhash_dedup as op

    count, largest, batch = _blocks_of(spark, monkeypatch, op, op.near_duplicates)
    assert count >= 4 and largest <= 1 << 20 and batch <= 4 << 20


def test_blocks_of_substring_dedup_are_small(spark, monkeypatch):
    from loomspark.llm import substring_dedup as op

    count, largest, batch = _blocks_of(spark, monkeypatch, op, op.substring_dedup)
    assert count >= 4 and largest <= 1 << 20 and batch <= 4 << 20
