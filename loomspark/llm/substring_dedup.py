"""Exact removal of repeated word windows by level-wise doubling.

Windows of a short length that occur once in the corpus cannot be part of a longer repeated one.  So the
lengths double (the last step overlaps its halves): at each level only windows whose two halves both
survived are keyed and exchanged, and the ones that occur once drop out; the levels end early when none is left.
At the target length the keys carry document ids, and a window is marked where a smaller id has it too.

Cases: a null text has no words; a null id is never smaller than another and has none below it, so
its words stay and remove nobody's; rows that share an id (repeated rows too) remove nothing from each other, and of texts
that tie the smallest id keeps its words; an empty table gives an empty result; extra columns are ignored.  A text of any length is
judged whole: one longer than a block is a block of its own, whose task holds some 40 bytes for each of its own.  Windows are told
apart by 64 bits and the bucket's of a second hash, which has another hash of each word too.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from loomspark.llm.exchange import BLOB, SMALL_BLOCK, Keys, alive, answer, discard, each_block, has_any, kept, merged, text_blocks, with_replies
from loomspark.llm.text import Words, covered, mix, runs, span_hashes

OUT = "doc_id long, n_words long, n_removed long, kept_sha256 string, spans array<struct<start:long,end:long>>, kept_text string"


def lengths(target: int, first: int) -> list[int]:
    """The window lengths of the levels: target, its half rounded up and so on, down to `first` or just below twice it."""
    out = [target]
    while out[0] > first:
        out.insert(0, max(first, (out[0] + 1) // 2))
    return out


class _Level:
    """The state of one block on its way through the levels."""

    def __init__(self, row: dict, sizes: list[int], bits: int):
        self.lens = np.frombuffer(row["lens"], np.int64)
        self.words = Words(np.frombuffer(row["data"], np.uint8), self.lens)
        self.ids = np.array([-1 if i is None else i for i in row["ids"]], np.int64)
        self.known = np.array([i is not None for i in row["ids"]], bool)
        self.sizes, self.bits = sizes, bits
        self.replies = row.get("replies") or []
        self.hash = self.words.tabulated(0)
        self.starts: np.ndarray | None = None

    def keys(self, level: int) -> Keys:
        """The keys of a level; the levels before must have been answered."""
        n, size = len(self.hash), self.sizes[level]
        h = span_hashes(self.hash, size)
        ok = np.zeros(max(0, n - size + 1), bool)
        if self.starts is None:
            ok[:] = True
        else:
            half = np.zeros(n + 1, bool)
            half[self.starts] = True
            ok = half[: len(ok)] & half[size - self.sizes[level - 1] :][: len(ok)]
        if len(ok):
            doc = self.words.doc
            ok &= (doc[: len(ok)] == doc[size - 1 :]) & self.known[doc[: len(ok)]]
        self.at = np.flatnonzero(ok)
        h = h[self.at]
        last = level == len(self.sizes) - 1
        where = span_hashes(self.words.tabulated(1), size)[self.at] if last else mix(h, np.uint64(7 + level))  # a filter can do without a second hash
        return Keys(where, h, self.bits, not last, self.ids[self.words.doc[self.at]] if last else None)

    def settle(self, level: int) -> None:
        keys = self.keys(level)
        found = keys.reply(self.replies, level)
        if level < len(self.sizes) - 1:
            found = found | keys.twice
        else:  # the least owner may sit in this block
            found = found | _above_least(keys)
        self.starts = self.at[found[keys.place]]


def _above_least(keys: Keys) -> np.ndarray:
    new = np.ones(len(keys.what), bool)
    new[1:] = (keys.where[1:] != keys.where[:-1]) | (keys.what[1:] != keys.what[:-1])
    least = keys.owners[np.flatnonzero(new)][np.cumsum(new) - 1] if len(new) else keys.owners
    return keys.owners > least


def substring_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = 50, first: int = 13, texts: bool = True) -> DataFrame:
    """Removes every word covered by a window of `window` words whose words also start in a document with a smaller id.

    Returns per document doc_id, n_words, n_removed, kept_sha256 (of the kept words joined by one
    space), the removed spans (word numbers, end exclusive) and, if texts is set, the kept text.
    """
    sizes = lengths(window, first)
    blocks = text_blocks(docs, id_col, text_col, SMALL_BLOCK)
    bits = blocks.bits_for(blocks.total)
    cols = ["shard", "block", "ids", "lens", "data"]
    replies: DataFrame | None = None
    levels = len(sizes)  # those that have candidates

    def joined() -> DataFrame:
        table = blocks.table.select(cols)
        return table if replies is None else with_replies(table, replies)

    for level in range(len(sizes)):
        last = level == len(sizes) - 1

        def emit(row: dict, level: int = level) -> Iterator[pa.RecordBatch]:
            state = _Level(row, sizes, bits)
            for k in range(level):
                state.settle(k)
            keys = state.keys(level)
            if len(keys.what):
                yield alive(row["shard"], row["block"])
                yield from keys.blobs(row["shard"], row["block"], level)

        got = kept(answer(each_block(joined(), emit, BLOB), set() if last else {level}, bits), "replies")
        if not has_any(got):  # no window of this length has two halves that repeat, so no longer one repeats either
            levels = level
            break
        replies = got if replies is None else kept(merged(replies, got), "replies")

    def finish(row: dict) -> Iterator[pa.RecordBatch]:
        state = _Level(row, sizes, bits)
        if levels == len(sizes):
            for k in range(len(sizes)):
                state.settle(k)
        w = state.words
        starts = state.starts if levels == len(sizes) else np.zeros(0, np.int64)
        gone = covered(starts, window, len(w.start))
        # One space before every kept word but a document's first, none elsewhere.
        keep_word = ~gone
        seen = np.cumsum(keep_word)
        base = np.concatenate([[0], seen])[w.first[:-1]]
        lead = keep_word & (seen - base[w.doc] > 1)
        size = (w.end - w.start) * keep_word + lead
        off = np.concatenate([[0], np.cumsum(size)])
        out = np.full(off[-1], 32, np.uint8)
        if len(w.data):
            by = np.repeat(keep_word, w.end - w.start)
            hole = np.zeros(len(out) + 1, bool)
            hole[off[:-1][lead]] = True
            out[~hole[:-1]] = w.data[w.solid][by]
        ends = off[w.first]
        buf = out.tobytes()
        removed = np.add.reduceat(np.append(gone, False).astype(np.int64), w.first[:-1]) * (w.count > 0) if w.n_docs else np.zeros(0, np.int64)
        shas, kept_texts, spans = [], [], []
        for d in range(w.n_docs):
            piece = buf[ends[d] : ends[d + 1]]
            shas.append(hashlib.sha256(piece).hexdigest())
            kept_texts.append(piece.decode("utf-8", "replace") if texts else None)
            if removed[d]:
                s, e = runs(gone[w.first[d] : w.first[d + 1]])
                spans.append([{"start": int(a), "end": int(b)} for a, b in zip(s, e, strict=True)])
            else:
                spans.append([])
        span = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))
        yield pa.record_batch([pa.array(row["ids"], pa.int64()), pa.array(w.count), pa.array(removed), pa.array(shas, pa.string()), pa.array(spans, span), pa.array(kept_texts, pa.string())], names=["doc_id", "n_words", "n_removed", "kept_sha256", "spans", "kept_text"])

    out = kept(each_block(joined(), finish, OUT), "dedup")
    discard(blocks.table)
    return out
