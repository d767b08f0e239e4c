"""Quality rules: hashed n-gram logistic regression, calibrated, beside counted base rules.

Features are shares, not counts: how much of a text's words, word pairs and 3- and 4-grams of characters fall on
each hashed place.  A text's logit is then the mean of the weights over its n-grams, found without building a
vector.  Training takes a bounded, hash-chosen sample of the labelled rows; the fold not
trained on fixes the two calibration parameters (Platt).  Scoring runs in Arrow batches, and the probability is held against
the fixed THRESHOLDS: their number that it reaches is the band, and KEEP_BAND or more is kept.

Cases: a null text has no words and fails the base rule; without labelled rows of both values the model keeps
everything that passes the base rule; null or repeated ids pass through (of a labelled id's texts the least is trained on); a
probability that ties with a threshold reaches it; an empty table gives an empty result; extra columns are ignored.  A text of any length
is scored whole: one longer than a block is a block of its own.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomspark.llm.text import Words, bounded, covered, mix, slices, span_hashes, text_bytes, tidy

BITS = 12  # per family: words, word pairs, 3-grams, 4-grams
FAMILIES = 4
SAMPLE = 2000
THRESHOLDS = (0.25, 0.5, 0.75)
KEEP_BAND = 2
_SYMBOL = np.zeros(256, bool)
_SYMBOL[list(b"#*$%&|<>")] = True
_SHIFT = np.uint64(64 - BITS)


def code_points(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where the characters of UTF-8 bytes start, and their code points."""
    at = np.flatnonzero((data & 0xC0) != 0x80)
    lead = data[at].astype(np.uint32)
    wide = np.flatnonzero(lead >= 0x80)
    if len(wide):
        more = np.append(data, np.zeros(3, np.uint8))
        one, two, three = (more[at[wide] + k].astype(np.uint32) & np.uint32(0x3F) for k in (1, 2, 3))
        x = lead[wide]
        short, middle = (x & np.uint32(0x1F)) << np.uint32(6) | one, (x & np.uint32(0x0F)) << np.uint32(12) | one << np.uint32(6) | two
        long = (x & np.uint32(0x07)) << np.uint32(18) | one << np.uint32(12) | two << np.uint32(6) | three
        lead[wide] = np.where(x < 0xE0, short, np.where(x < 0xF0, middle, long))
    return at, lead


def families(words: Words) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(document, hashed place) of all n-grams of a block, one family at a time."""
    h = words.hashes()
    yield words.doc, (h >> _SHIFT).astype(np.int64)
    two = words.doc[:-1] == words.doc[1:]
    yield words.doc[:-1][two], (mix(h[:-1][two], h[1:][two]) >> _SHIFT).astype(np.int64)
    at, code = code_points(words.data)
    doc = np.repeat(np.arange(words.n_docs, dtype=np.int32), np.diff(np.concatenate([[0], words.doc_end])))[at]
    gram = code
    for size in (2, 3, 4):
        gram = gram[:-1] * np.uint32(0x01000193) + code[size - 1 :] if len(gram) else gram
        if size > 2:
            same = doc[: len(gram)] == doc[size - 1 :]
            yield doc[: len(gram)][same], ((gram[same] * np.uint32(0x9E3779B1)) >> np.uint32(32 - BITS)).astype(np.int64)


@dataclass
class Model:
    weights: np.ndarray  # families x 2**BITS
    bias: float
    slope: float
    shift: float

    def probability(self, words: Words) -> np.ndarray:
        logit = np.full(words.n_docs, self.bias)
        for f, (doc, place) in enumerate(families(words)):
            n = np.bincount(doc, minlength=words.n_docs)
            logit += np.bincount(doc, self.weights[f][place], words.n_docs) / np.maximum(n, 1)
        return 1 / (1 + np.exp(-np.clip(self.slope * logit + self.shift, -50, 50)))


class Rows:
    """Labelled rows as sparse shares: row, column and value of every share that isn't 0."""

    def __init__(self, cells: list[tuple[np.ndarray, np.ndarray]], width: int):
        self.n, self.width = len(cells), width
        self.row = np.repeat(np.arange(self.n), [len(c[0]) for c in cells])
        self.col = np.concatenate([c[0] for c in cells]).astype(np.int64)
        self.val = np.concatenate([c[1] for c in cells])

    def pick(self, which: np.ndarray) -> Rows:
        """The rows of a mask."""
        out = object.__new__(Rows)
        keep = which[self.row]
        out.n, out.width = int(which.sum()), self.width
        out.row, out.col, out.val = (np.cumsum(which) - 1)[self.row[keep]], self.col[keep], self.val[keep]
        return out

    def times(self, w: np.ndarray) -> np.ndarray:
        return np.bincount(self.row, self.val * w[self.col], self.n)

    def turned(self, r: np.ndarray) -> np.ndarray:
        return np.bincount(self.col, self.val * r[self.row], self.width)


def fit(x: Rows, y: np.ndarray, rounds: int = 150, rate: float = 0.02, decay: float = 0.01) -> tuple[np.ndarray, float]:
    """Full-batch logistic regression with Adam on columns divided by their deviation; returns weights for raw columns and the bias."""
    mean = np.bincount(x.col, x.val, x.width) / x.n
    spread = np.sqrt(np.maximum(np.bincount(x.col, x.val**2, x.width) / x.n - mean**2, 0))
    scale = 1 / (spread + 1e-4) / np.sqrt(x.width)
    w, b = np.zeros(x.width), 0.0
    m, v = np.zeros(x.width + 1), np.zeros(x.width + 1)
    for t in range(1, rounds + 1):
        sw = scale * w
        p = 1 / (1 + np.exp(-np.clip(x.times(sw) - mean @ sw + b, -30, 30)))
        r = (p - y) / x.n
        g = np.append(scale * (x.turned(r) - mean * r.sum()) + decay * w / x.width, r.sum())
        m, v = 0.9 * m + 0.1 * g, 0.99 * v + 0.01 * g * g
        step = (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.99**t)) + 1e-8)
        w, b = w - rate * step[:-1], b - 0.05 * step[-1]
    return scale * w, float(b - mean @ (scale * w))


def platt(logit: np.ndarray, y: np.ndarray) -> tuple[float, float]:
    """Slope and shift that make sigmoid(slope * logit + shift) a probability, by Newton steps on smoothed targets."""
    pos, neg = y.sum(), len(y) - y.sum()
    t = np.where(y > 0, (pos + 1) / (pos + 2), 1 / (neg + 2))
    x = np.stack([logit, np.ones_like(logit)], 1)
    c = np.array([1.0, 0.0])
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x @ c, -30, 30)))
        hess = (x * (p * (1 - p))[:, None]).T @ x + 1e-3 * np.eye(2)
        step = np.linalg.solve(hess, x.T @ (p - t) + 1e-3 * (c - [1, 0]))
        c -= np.clip(step, -2, 2)
    return float(max(c[0], 1e-3)), float(c[1])


def train(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", sample: int = SAMPLE) -> Model:
    """Trains on at most `sample` labelled rows, chosen by hash; each sends at most FAMILIES * 2**BITS shares to the driver."""
    few = labels.where(F.col("quality").isNotNull() & F.col(id_col).isNotNull()).select(F.col(id_col).alias("id"), F.col("quality").cast("int").alias("y")).distinct().orderBy(F.xxhash64("id"), "id", "y").limit(sample)
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text")).join(F.broadcast(few), "id")  # `sample` rows at most
    rows = rows.groupBy("id", "y").agg(F.min("text").alias("text"))  # one row for each labelled row, however often an id repeats
    width = FAMILIES << BITS

    def shares(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for piece in slices(batch, "text", 1 << 20):
                words = Words(*text_bytes(piece.column("text")))
                n = piece.num_rows
                places, values, docs_of = [], [], []
                for f, (doc, place) in enumerate(families(words)):
                    key, count = np.unique(doc.astype(np.int64) << BITS | place, return_counts=True)
                    d = key >> BITS
                    places.append((f << BITS | key & (1 << BITS) - 1).astype(np.uint16))
                    values.append((count / np.bincount(d, count, n)[d]).astype(np.float32))
                    docs_of.append(d)
                d = np.concatenate(docs_of)
                order = np.argsort(d, kind="stable")
                place, value, cut = np.concatenate(places)[order], np.concatenate(values)[order], np.searchsorted(d[order], np.arange(n + 1))
                yield pa.record_batch([piece.column("id").cast(pa.int64()), piece.column("y").cast(pa.int32()), pa.array([place[a:b].tobytes() for a, b in zip(cut[:-1], cut[1:], strict=True)], pa.binary()), pa.array([value[a:b].tobytes() for a, b in zip(cut[:-1], cut[1:], strict=True)], pa.binary())], names=["id", "y", "places", "shares"])

    got = rows.mapInArrow(tidy(shares), "id long, y int, places binary, shares binary").toArrow().sort_by([("id", "ascending"), ("y", "ascending")])
    y = got.column("y").to_numpy().astype(np.float32)
    if not 0 < (y > 0).sum() < len(y):
        return Model(np.zeros((FAMILIES, 1 << BITS)), 0.0, 1.0, 10.0)
    x = Rows([(np.frombuffer(p, np.uint16), np.frombuffer(s, np.float32)) for p, s in zip(got.column("places").to_pylist(), got.column("shares").to_pylist(), strict=True)], width)
    y = (y > 0).astype(np.float64)
    test = np.arange(len(y)) % 4 == 3
    if not (0 < y[~test].sum() < (~test).sum() and 0 < y[test].sum() < test.sum()):
        test[:] = True  # too few rows for a fold of their own
        w, b = fit(x, y)
    else:
        w, b = fit(x.pick(~test), y[~test])
    slope, shift = platt((x.times(w) + b)[test], y[test])
    return Model(w.reshape(FAMILIES, 1 << BITS), b, slope, shift)


def base_counts(words: Words) -> dict[str, np.ndarray]:
    """Per document: words, their code points, symbols, repeated lines, and words in 3-word windows that occur twice."""
    n, data = words.n_docs, words.data
    begin = np.concatenate([[0], words.doc_end[:-1]]) if n else np.zeros(0, np.int64)
    total = lambda mask: (c := np.concatenate([[0], np.cumsum(mask)]))[words.doc_end] - c[begin]
    # Lines end at \n and at a document's end.
    stop = data == 10
    size = np.diff(np.concatenate([[0], words.doc_end]))
    line_doc = np.repeat(np.arange(n), total(stop) + 1)
    cut = np.sort(np.concatenate([np.flatnonzero(stop), words.doc_end - 0.5]))  # a document's end lies before the next one's first byte
    line_end = np.ceil(cut).astype(np.int64)
    line_start = np.concatenate([[0], np.where(cut[:-1] == np.floor(cut[:-1]), line_end[:-1] + 1, line_end[:-1])]) if len(cut) else line_end
    solid = np.concatenate([[0], np.cumsum(words.solid)])
    with_word = solid[line_end] > solid[line_start]
    raw = data.tobytes()
    seen: dict[bytes, int] = {}
    dup = np.zeros(n, np.int64)
    now = -1
    for d, s, e in zip(line_doc[with_word].tolist(), line_start[with_word].tolist(), line_end[with_word].tolist(), strict=True):
        if d != now:
            now = d
            seen = {}
        line = raw[s:e]
        if line in seen:
            dup[d] += 1
        else:
            seen[line] = 1
    assert len(size) == n
    three = span_hashes(words.hashes(), 3)
    at = np.flatnonzero(words.doc[: len(three)] == words.doc[2:][: len(three)]) if len(three) else np.zeros(0, np.int64)
    key = mix(three[at], words.doc[at].astype(np.uint64))
    order = np.argsort(key)
    k = key[order]
    same = np.zeros(len(k) + 1, bool)
    same[1:-1] = k[1:] == k[:-1]
    again = at[order[same[:-1] | same[1:]]]
    in_window = covered(again, 3, len(words.start))
    return {"n_words": words.count, "word_chars": total(words.solid & ((data & 0xC0) != 0x80)), "n_symbols": total(_SYMBOL[data]), "n_dup_lines": dup, "n_repeat_words": np.bincount(words.doc[in_window], minlength=n).astype(np.int64)}


OUT = "doc_id long, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, base_failed boolean, kept boolean, quality_probability double, quality_band int"


def quality_rules(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text", thresholds: tuple[float, ...] = THRESHOLDS, keep_band: int = KEEP_BAND) -> DataFrame:
    """Base counts and verdict of every whole text; a text that passes the base rules is kept if its probability of good quality reaches keep_band of the thresholds."""
    shared = docs.sparkSession.sparkContext.broadcast(model)  # FAMILIES * 2**BITS weights

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for piece in slices(batch, "text"):
                words = Words(*text_bytes(piece.column("text")))
                c = base_counts(words)
                failed = (c["n_words"] < 50) | (100 * c["n_repeat_words"] > 50 * c["n_words"])
                p = shared.value.probability(words)
                band = np.searchsorted(thresholds, p, "right")
                yield pa.record_batch([piece.column("id"), *(pa.array(v.astype(np.int64)) for v in c.values()), pa.array(failed), pa.array(~failed & (band >= keep_band)), pa.array(p), pa.array(band, pa.int32())], names=["doc_id", *c, "base_failed", "kept", "quality_probability", "quality_band"])

    return bounded(docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))).mapInArrow(tidy(work), OUT)
