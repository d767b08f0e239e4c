"""Exact removal of repeated byte strings by difference-cover blockwise suffix comparison.

Two suffixes share a prefix of `length` bytes iff they agree at some cover sample and around it.  With a
difference cover D modulo v, any two positions i and j have an offset d < v at which both i+d and j+d are
sample positions, and a sample string of length-v+1 bytes from there still lies inside both prefixes.

1. Samples: fingerprints of the strings at the cover positions are exchanged and each is found alone in the
   corpus, or repeated.  This is 1/11 of all positions at v = 133.
2. Windows: a suffix can only repeat if one of the samples in its first v places is repeated; of those suffixes
   alone, a hash of the first `length` bytes is dealt into buckets, and equal hashes are the repeated ones.
   Neither step holds more than a block or a bucket.

No suffix is sorted and no tie is resolved through sample ranks: the samples only choose which windows are hashed.
Only equality of `length`-byte prefixes is asked for, which the hash answers without an order.

Whole texts that occur more than once are settled by one key each in step 1: all of their bytes go, and only
the first copy's suffixes are dealt, so thousands of copies cost what one does.

Cases: null and empty texts have no bytes and lose none; ids may be null or repeat (each row is judged as a
document of its own); an empty table gives an empty result; extra columns are ignored.  A document longer
than a block is a block of its own.  Windows are told apart by a hash of 64 bits and the bucket's bits of a second, independent one.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import lru_cache
from itertools import product

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomspark.llm.exchange import BLOB, Keys, answer, discard, each_block, kept, merged, text_blocks, with_replies
from loomspark.llm.text import byte_span_hashes, covered, mix, runs

OUT = "doc_id long, n_bytes long, n_removed long, kept_sha256 string, spans array<struct<start:long,end:long>>, kept_text string"
_SAMPLE, _WHOLE, _SUFFIX = 0, 1, 2


@lru_cache
def difference_cover(q: int) -> tuple[int, np.ndarray]:
    """Modulus q*q+q+1 and a cover of q+1 residues for a prime q (Singer): the zeros of a maximal recurrence of order 3 over GF(q)."""
    v = q * q + q + 1
    for a, b, c in product(range(q), range(q), range(1, q)):
        s, zeros = (0, 0, 1), []
        for i in range(v):
            if s[0] == 0:
                zeros.append(i)
            s = (s[1], s[2], (a * s[2] + b * s[1] + c * s[0]) % q)
        if len(zeros) == q + 1 and len({(x - y) % v for x in zeros for y in zeros}) == v:
            return v, np.array(zeros)
    raise ValueError(f"no cover for {q}")


def cover_for(length: int) -> tuple[int, np.ndarray]:
    """The largest cover whose sample strings keep at least a third of the length."""
    best = max((q for q in (2, 3, 5, 7, 11, 13, 17, 19, 23) if length - (q * q + q) >= length / 3), default=None)
    return difference_cover(best) if best else (1, np.array([0]))


class _Block:
    def __init__(self, row: dict, length: int, bits: int):
        self.length, self.bits = length, bits
        self.v, self.cover = cover_for(length)
        self.lens = np.frombuffer(row["lens"], np.int64)
        self.data = np.frombuffer(row["data"], np.uint8)
        self.end = np.cumsum(self.lens)
        self.begin = self.end - self.lens
        self.replies = row.get("replies") or []
        self.m = length - self.v + 1
        inside = np.arange(len(self.data)) - np.repeat(self.begin, self.lens)
        left = np.repeat(self.end, self.lens) - np.arange(len(self.data))
        is_cover = np.zeros(self.v, bool)
        is_cover[self.cover] = True
        long_doc = np.repeat(self.lens >= length, self.lens)
        # Equal texts of this block: the first speaks for all.
        self.whole = np.flatnonzero(self.lens >= length)
        raw = self.data.tobytes()
        self.print = [xxhash.xxh3_128_intdigest(raw[self.begin[d] : self.end[d]]) for d in self.whole]
        high = np.fromiter((p >> 64 for p in self.print), np.uint64, len(self.print))
        low = np.fromiter((p & (2**64 - 1) for p in self.print), np.uint64, len(self.print))
        self.whole_keys = Keys(high, low, bits, False)
        first = np.full(len(self.whole_keys.what), -1, np.int64)
        place = self.whole_keys.place
        first[place[::-1]] = self.whole[::-1]
        self.copy = np.zeros(len(self.lens), bool)  # not the first of its text in this block
        self.copy[self.whole] = first[place] != self.whole
        live = long_doc & ~np.repeat(self.copy, self.lens)
        self.samples = np.flatnonzero(is_cover[inside % self.v] & (left >= self.m) & live)
        self.fits = (left >= length) & live

    def sample_keys(self) -> Keys:
        h = byte_span_hashes(self.data, self.m, self.samples)
        return Keys(mix(h, np.uint64(3)), h, self.bits, True)

    def settle_samples(self) -> None:
        """Uses the replies to step 1: which texts repeat, and which suffixes must be compared."""
        self.repeated_doc = np.zeros(len(self.lens), bool)
        wk = self.whole_keys
        self.repeated_doc[self.whole] = (wk.reply(self.replies, _WHOLE) | wk.twice)[wk.place]
        later = np.zeros(len(self.lens), bool)
        later[self.whole] = wk.reply(self.replies, _WHOLE, "later")[wk.place]
        keys = self.sample_keys()
        hit = self.samples[(keys.reply(self.replies, _SAMPLE) | keys.twice)[keys.place]]
        maybe = covered(np.maximum(hit - (self.v - 1), 0), self.v, len(self.data)) if len(hit) else np.zeros(len(self.data), bool)
        # A cut at offset 0 only reaches suffixes of a block's first document that precede the sample.
        self.suffixes = np.flatnonzero(maybe & self.fits & ~np.repeat(later, self.lens))

    def suffix_keys(self) -> Keys:
        where, what = (byte_span_hashes(self.data, self.length, self.suffixes, family=f) for f in (1, 0))
        return Keys(where, what, self.bits, False)

    def gone(self) -> np.ndarray:
        keys = self.suffix_keys()
        hit = self.suffixes[(keys.reply(self.replies, _SUFFIX) | keys.twice)[keys.place]]
        return covered(hit, self.length, len(self.data)) | np.repeat(self.repeated_doc, self.lens)


def suffix_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", length: int = 200, texts: bool = True) -> DataFrame:
    """Removes each byte covered by a `length`-byte string that also starts anywhere else in the corpus.

    Returns per document doc_id, n_bytes, n_removed, kept_sha256 (of the remaining bytes), the removed
    spans (byte offsets, end exclusive) and, if texts is set, the remaining text (torn characters replaced).
    """
    blocks = text_blocks(docs, id_col, text_col)
    bits = blocks.bits_for(blocks.total / 2)
    cols = ["shard", "block", "ids", "lens", "data"]

    def emit_samples(row: dict) -> Iterator[pa.RecordBatch]:
        b = _Block(row, length, bits)
        yield from b.whole_keys.blobs(row["shard"], row["block"], _WHOLE)
        yield from b.sample_keys().blobs(row["shard"], row["block"], _SAMPLE)

    ranks = kept(answer(each_block(blocks.table.select(cols), emit_samples, BLOB), {_SAMPLE}, bits), "ranks")

    def emit_suffixes(row: dict) -> Iterator[pa.RecordBatch]:
        b = _Block(row, length, bits)
        b.settle_samples()
        yield from b.suffix_keys().blobs(row["shard"], row["block"], _SUFFIX)

    found = answer(each_block(with_replies(blocks.table.select(cols), ranks), emit_suffixes, BLOB), set(), bits)
    both = kept(merged(ranks, found), "ranks")

    def finish(row: dict) -> Iterator[pa.RecordBatch]:
        b = _Block(row, length, bits)
        b.settle_samples()
        gone = b.gone()
        raw, stay = b.data.tobytes(), ~gone
        total_gone = np.concatenate([[0], np.cumsum(gone)])
        removed = total_gone[b.end] - total_gone[b.begin]
        shas, kept_texts, spans = [], [], []
        for d in range(len(b.lens)):
            s, e = b.begin[d], b.end[d]
            if removed[d]:
                piece = b.data[s:e][stay[s:e]].tobytes()
                spans.append([{"start": int(x), "end": int(y)} for x, y in zip(*runs(gone[s:e]), strict=True)])
            else:
                piece = raw[s:e]
                spans.append([])
            shas.append(hashlib.sha256(piece).hexdigest())
            kept_texts.append(piece.decode("utf-8", "replace") if texts else None)
        span = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))
        yield pa.record_batch([pa.array(row["ids"], pa.int64()), pa.array(b.lens), pa.array(removed), pa.array(shas, pa.string()), pa.array(spans, span), pa.array(kept_texts, pa.string())], names=["doc_id", "n_bytes", "n_removed", "kept_sha256", "spans", "kept_text"])

    out = kept(each_block(with_replies(blocks.table.select(cols), both), finish, OUT), "dedup")
    discard(blocks.table)
    return out
