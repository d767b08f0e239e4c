"""Language identification of mixed-language text.

Learning: hashed letter n-gram counts of each language and the scripts it is written in, from a bounded, hash-chosen
sample of the labelled rows (PER_LANGUAGE rows of each language are expected, all rows of a rarer one).
Prediction: script ranges narrow a word's candidate languages, naive Bayes scores its n-grams under each, and
Viterbi over the words with a switching penalty labels spans.  The document's language is the one
with most of its lettered words, and the score is their share.

Viterbi runs only where it can matter: where no run of words favours another language by more
than half the penalty, a constant path is optimal (a path of k > 1 segments pays k-1 penalties and gains at
most k halves).  The rest run in step, all documents of a block at once.

Cases: null text, or text without a letter, is `und` with score 0; so is everything if nothing was
learned; rows with a null language teach nothing; null and repeated ids pass through; ties go to the language first in code
point order; an empty table gives an empty result; extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomspark.llm.text import Words, bounded, mix, slices, text_bytes, tidy

FEATURE_BITS = 15
PER_LANGUAGE = 1500
PENALTY = 8.0
UNKNOWN = "und"
#: First code points of ranges and their scripts (0: no letter's own); fixed by the Unicode blocks.
_RANGES = [(0x0, 0), (0x41, 1), (0x250, 0), (0x370, 2), (0x400, 3), (0x530, 4), (0x590, 5), (0x600, 6), (0x780, 0), (0x900, 7), (0x980, 8), (0xE00, 9), (0xE80, 0), (0x10A0, 10), (0x1100, 11), (0x1200, 12), (0x1380, 0), (0x1E00, 1), (0x1F00, 2), (0x2000, 0), (0x2C60, 1), (0x2C80, 0), (0x3040, 13), (0x3100, 0), (0x3400, 14), (0xA000, 0), (0xAC00, 11), (0xD7B0, 0), (0xF900, 14), (0xFB00, 1), (0xFB07, 0), (0x20000, 14), (0x32000, 0)]
_STARTS, _SCRIPTS = np.array([r[0] for r in _RANGES]), np.array([r[1] for r in _RANGES])
N_SCRIPTS = 15


class _Distinct:
    """The distinct words of a block: hashed n-grams, script, and whether there is a letter."""

    def __init__(self, words: Words):
        self.codes, _ = words.codes() if len(words.start) else (np.zeros(0, np.int64), [])
        coded = words.array().dictionary_encode().dictionary if len(words.start) else pa.array([], pa.binary())
        texts = coded.cast(pa.large_string() if pa.types.is_large_binary(coded.type) else pa.string())
        self.lettered = pc.match_substring_regex(texts, r"\p{L}").to_numpy(zero_copy_only=False).astype(bool)
        data, lens = text_bytes(pc.utf8_lower(pc.replace_substring_regex(texts, r"[^\p{L}\p{M}]+", "")))
        # n-grams of 1 to 4 bytes of "<word>", the markers as bytes that UTF-8 never has
        end = np.cumsum(lens)
        n = len(lens)
        wrapped = np.insert(data, np.concatenate([end - lens, end]), np.repeat(np.array([0xFE, 0xFF], np.uint8), n)) if n else data
        owner = np.repeat(np.arange(n), lens + 2)
        self.grams: list[tuple[np.ndarray, np.ndarray]] = []
        code = np.zeros(len(wrapped), np.uint64)
        for size in range(1, 5):
            code = code[: len(wrapped) - size + 1] * np.uint64(256) + wrapped[size - 1 :]
            same = owner[: len(code)] == owner[size - 1 :]
            if size == 1:
                same &= wrapped < 0xFE
            h = mix(code[same], np.uint64(size)) >> np.uint64(64 - FEATURE_BITS)
            self.grams.append((owner[: len(code)][same], h.astype(np.int64)))
        points = np.frombuffer("".join(texts.to_pylist()).encode("utf-32-le"), np.uint32)
        each = pc.utf8_length(texts).to_numpy(zero_copy_only=False).astype(np.int64)
        script = _SCRIPTS[np.searchsorted(_STARTS, points, "right") - 1]
        counts = np.zeros((n, N_SCRIPTS), np.int32)
        np.add.at(counts, (np.repeat(np.arange(n), each), script), 1)
        counts[:, 0] = 0
        self.script = np.where(counts.any(1), counts.argmax(1), 0) if n else np.zeros(0, np.int64)


@dataclass
class Model:
    langs: list[str]
    log_p: np.ndarray  # features x languages
    written: np.ndarray  # scripts x languages, bool
    penalty: float

    def word_scores(self, d: _Distinct) -> np.ndarray:
        n = len(d.lettered)
        out = np.zeros((n, len(self.langs)))
        for owner, feature in d.grams:
            for k in range(len(self.langs)):
                out[:, k] += np.bincount(owner, self.log_p[feature, k], n)
        out *= 0.5  # neighbouring n-grams tell much the same
        out -= out.max(1, keepdims=True)
        np.maximum(out, -12.0, out=out)
        allowed = self.written[d.script]
        out[~allowed & allowed.any(1, keepdims=True)] = -24.0
        out[~d.lettered] = 0.0
        return out

    def label(self, words: Words) -> tuple[np.ndarray, np.ndarray]:
        """Each word's language number, and whether it has a letter."""
        d = _Distinct(words)
        if not len(d.codes):
            return np.zeros(0, np.int64), np.zeros(0, bool)
        scores = self.word_scores(d)[d.codes]
        return viterbi(scores, words.first, self.penalty), d.lettered[d.codes]


def viterbi(scores: np.ndarray, first: np.ndarray, penalty: float) -> np.ndarray:
    """The best label of every item; items first[d] to first[d+1] are sequence d; changing labels costs the penalty."""
    n, k = scores.shape
    count = np.diff(first)
    full = np.flatnonzero(count)
    path = np.zeros(n, np.int64)
    if not len(full):
        return path
    totals = np.add.reduceat(scores, first[full], axis=0)
    best = totals.argmax(1)
    path[:] = np.repeat(best, count[full])
    if k == 1:
        return path
    rank = np.repeat(np.arange(len(full)), count[full])
    own = scores[np.arange(n), path]
    rivals = np.full(n, -np.inf)
    drop = (np.abs(scores).sum() + penalty + 1) * rank
    for lang in range(k):
        gain = np.cumsum(scores[:, lang] - own)
        low = np.concatenate([[0.0], gain[:-1]]) - drop  # a sequence starts below all before it
        np.maximum(rivals, gain - drop - np.minimum.accumulate(low), out=rivals)
    hard = full[np.maximum.reduceat(rivals, first[full]) > penalty / 2]
    if not len(hard):
        return path
    hard = hard[np.argsort(-count[hard], kind="stable")]
    at, size = first[hard], count[hard]
    came = np.zeros((n, k), np.int16)
    v = scores[at].copy()
    active = np.searchsorted(-size, -np.arange(1, size[0] + 1), "right")
    for t in range(1, size[0]):
        a = active[t]
        top = v[:a].argmax(1)
        high = v[np.arange(a), top] - penalty
        switch = v[:a] < high[:, None]
        i = at[:a] + t
        came[i] = np.where(switch, top[:, None], np.arange(k))
        v[:a] = np.where(switch, high[:, None], v[:a]) + scores[i]
    state = v.argmax(1)
    for t in range(size[0] - 1, -1, -1):
        a = active[t]
        i = at[:a] + t
        path[i] = state[:a]
        if t:
            state[:a] = came[i, state[:a]]
    return path


def held_out(id_col: str = "doc_id") -> Column:
    """Rows that are never learned from: crc32 of the id as text, modulo 4, is 2; a null id is not held out."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string").cast("binary")) % 4 == 2, F.lit(False))


def learn(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", per_language: int = PER_LANGUAGE, penalty: float = PENALTY) -> Model:
    """Learns from at most about per_language hash-chosen labelled rows of each language; what comes to the driver is bounded by languages x 2**FEATURE_BITS counts."""
    rows = docs.where(~held_out(id_col) & F.col(lang_col).isNotNull() & F.col(text_col).isNotNull())
    sizes = {r[0]: r[1] for r in rows.groupBy(lang_col).count().collect()}
    if not sizes:
        return Model([], np.zeros((1 << FEATURE_BITS, 0)), np.zeros((N_SCRIPTS, 0), bool), penalty)
    share = F.create_map(*(F.lit(x) for k, v in sizes.items() for x in (k, min(1.0, per_language / v))))
    # A document that is chosen counts with its first words only if it is very long in comparison; here all of it counts.
    chosen = rows.where(F.pmod(F.xxhash64(id_col, F.lit(11)), F.lit(1 << 20)) < share[F.col(lang_col)] * (1 << 20))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table: dict[str, np.ndarray] = {}
        for batch in batches:
            for piece in slices(batch, "text"):
                words = Words(*text_bytes(piece.column("text")))
                if not len(words.start):
                    continue
                d = _Distinct(words)
                lang = np.array(piece.column("lang").to_pylist(), object)[words.doc]
                for name in set(lang):
                    often = np.bincount(d.codes[lang == name], minlength=len(d.lettered)) * d.lettered
                    into = table.setdefault(name, np.zeros((1 << FEATURE_BITS) + N_SCRIPTS))
                    for owner, feature in d.grams:
                        into += np.bincount(feature, often[owner], len(into))
                    into += np.bincount((1 << FEATURE_BITS) + d.script, often, len(into))
        for name, into in table.items():
            at = np.flatnonzero(into)
            yield pa.record_batch([pa.array([name] * len(at), pa.string()), pa.array(at, pa.int32()), pa.array(into[at])], names=["lang", "feature", "n"])

    counted = chosen.select(F.col(text_col).cast("string").alias("text"), F.col(lang_col).cast("string").alias("lang")).mapInArrow(tidy(count), "lang string, feature int, n double")
    got = counted.groupBy("lang", "feature").agg(F.sum("n").alias("n")).toArrow()
    langs = sorted({x for x in got.column("lang").to_pylist()})
    table = np.zeros(((1 << FEATURE_BITS) + N_SCRIPTS, len(langs)))
    number = {x: i for i, x in enumerate(langs)}
    table[got.column("feature").to_numpy(), [number[x] for x in got.column("lang").to_pylist()]] = got.column("n").to_numpy()
    grams, scripts = table[: 1 << FEATURE_BITS], table[1 << FEATURE_BITS :]
    log_p = np.log(grams + 0.5) - np.log(grams.sum(0) + 0.5 * len(grams))
    written = scripts >= np.maximum(0.01 * scripts.sum(0), 1)
    written[0] = True
    return Model(langs, log_p, written, penalty)


OUT = "doc_id long, lang_pred string, score double, spans array<struct<start:long,end:long,lang:string>>"


def predict(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text", carry: tuple[str, ...] = ()) -> DataFrame:
    """Language, score and spans (word numbers, end exclusive) of every whole text; columns named in `carry` are passed on."""
    shared = docs.sparkSession.sparkContext.broadcast(model)  # languages x 2**FEATURE_BITS doubles

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        names = np.array([*m.langs, UNKNOWN], object)
        for batch in batches:
            for piece in slices(batch, "text"):
                words = Words(*text_bytes(piece.column("text")))
                k, n = len(m.langs), piece.num_rows
                label, lettered = m.label(words) if k else (np.zeros(len(words.start), np.int64), np.zeros(len(words.start), bool))
                votes = np.bincount(words.doc[lettered] * max(k, 1) + label[lettered], minlength=n * max(k, 1)).reshape(n, -1)
                total = votes.sum(1)
                pick = np.where(total > 0, votes.argmax(1), k)
                score = np.where(total > 0, votes.max(1) / np.maximum(total, 1), 0.0)
                new = np.ones(len(label), bool)
                new[1:] = (label[1:] != label[:-1]) | (words.doc[1:] != words.doc[:-1])
                starts = np.flatnonzero(new & (total > 0)[words.doc]) if len(label) else np.zeros(0, np.int64)
                ends = np.append(np.flatnonzero(new), len(label))[np.searchsorted(np.flatnonzero(new), starts, "right")] if len(starts) else starts
                base = words.first[:-1][words.doc[starts]]
                offsets = np.concatenate([[0], np.cumsum(np.bincount(words.doc[starts], minlength=n))])
                spans = pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.StructArray.from_arrays([pa.array(starts - base), pa.array(ends - base), pa.array(names[label[starts]], pa.string())], names=["start", "end", "lang"]))
                yield pa.record_batch([piece.column("id"), pa.array(names[pick], pa.string()), pa.array(score), spans, *(piece.column(f"_{c}") for c in carry)], names=["doc_id", "lang_pred", "score", "spans", *(f"_{c}" for c in carry)])

    plain = bounded(docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"), *(F.col(c).alias(f"_{c}") for c in carry)))
    extra = "".join(f", _{c} {plain.schema[f'_{c}'].dataType.simpleString()}" for c in carry)
    return plain.mapInArrow(tidy(work), OUT + extra)
