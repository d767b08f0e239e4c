"""Packing documents into token sequences of balanced attention cost.

A document's cost is linear + quadratic in its tokens.  In descending order each goes to the lowest-cost sequence
with room for all of it, or else is cut at the room of the lowest-cost sequence that has any.  A block of texts fills whole
sequences; what is left of it, less than one, is packed with the next block of the task, and at the task's end one sequence for each
power of two takes the rest, so none is padded.  Every task packs what it reads: nothing is shuffled, and a lost task only repeats itself.

Tokens: a word's ids don't depend on its neighbours, since white space ends a token and is dropped, so each
distinct word is encoded once per worker (the cache is emptied at CACHE_WORDS words).

Cases: null and empty texts are the end id alone; null or repeated ids pass through, repeated rows are packed each; documents
of equal length go in the order in which they are read, and of sequences of equal cost the first is taken; an empty table gives an
empty result; extra columns are ignored.  A text of any length is encoded whole and cut into as many pieces as it needs.
"""

from __future__ import annotations

import os
import zlib
from collections.abc import Iterator
from functools import lru_cache
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from xxhash import xxh3_64_intdigest

from loomspark.llm.text import Words, bounded, slices, text_bytes, tidy

TOKENIZER = "word_bpe_49k.json"
END_ID = 2
LENGTH = 4096
LINEAR, QUADRATIC = 1.0, 1.0 / 512
CACHE_WORDS = 1_200_000
ENCODE_AT_ONCE = 20_000
SLICE_BYTES = 4 << 20


def tokenizer_path(name: str = TOKENIZER) -> str:
    import public_tokenizers

    return str(public_tokenizers.path(name))


class Encoder:
    """Token ids of whole texts, by distinct word."""

    def __init__(self, path: str):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        vocabulary = self.tokenizer.get_vocab()
        self.closes = np.zeros(max(vocabulary.values()) + 1, bool)
        self.closes[[i for token, i in vocabulary.items() if token.endswith("</w>")]] = True
        self.marks = {c.encode(): ids[0] for c in ".,;:!?" if len(ids := self.tokenizer.encode(c, add_special_tokens=False).ids) == 1 and ids[0] > 0}
        self.clear()

    def clear(self) -> None:
        self.hash = np.zeros(0, np.uint64)  # of the known words, ascending
        self.size = np.zeros(0, np.int64)
        self.at = np.zeros(0, np.int64)
        self.ids = np.zeros(1 << 16, np.uint32)
        self.used = 0

    def _encoded(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Counts and ids of the words.

        A run of ASCII letters is one unit of the tokenizer in lower case, and a mark after it another, so such words
        are encoded as one text of distinct runs, whose units end where a token ends a word.  Other words go one by one.
        """
        runs: dict[bytes, int] = {}
        run, mark, odd = np.full(len(words), -1, np.int64), np.zeros(len(words), np.int64), []
        for i, w in enumerate(words):
            if w.isalpha():
                run[i] = runs.setdefault(w.lower(), len(runs))
            elif w[:-1].isalpha() and w[-1:] in self.marks:
                run[i] = runs.setdefault(w[:-1].lower(), len(runs))
                mark[i] = self.marks[w[-1:]]
            else:
                odd.append(w)
        names = [r.decode() for r in runs]
        parts = [np.array(self.tokenizer.encode_batch_fast([" ".join(names[i : i + ENCODE_AT_ONCE])], add_special_tokens=False)[0].ids, np.uint32) for i in range(0, len(names), ENCODE_AT_ONCE)]
        flat = np.concatenate([*parts, np.zeros(0, np.uint32)])
        ends = np.flatnonzero(self.closes[flat]) + 1
        if len(ends) != len(names):
            raise ValueError("this tokenizer doesn't encode runs of letters one by one")
        size_of = np.diff(ends, prepend=0)
        got = [e.ids for i in range(0, len(odd), ENCODE_AT_ONCE) for e in self.tokenizer.encode_batch_fast([w.decode("utf-8", "replace") for w in odd[i : i + ENCODE_AT_ONCE]], add_special_tokens=False)]
        odd_size = np.fromiter(map(len, got), np.int64, len(got))
        source = np.concatenate([flat, np.fromiter(chain.from_iterable(got), np.uint32, int(odd_size.sum()))])
        plain = run >= 0
        size, start = np.empty(len(words), np.int64), np.empty(len(words), np.int64)
        size[plain], start[plain] = size_of[run[plain]], (ends - size_of)[run[plain]]
        size[~plain], start[~plain] = odd_size, len(flat) + np.cumsum(odd_size) - odd_size
        full = size + (mark > 0)
        out = np.empty(int(full.sum()), np.uint32)
        at = np.cumsum(full) - full
        spread = np.arange(int(size.sum())) - np.repeat(np.cumsum(size) - size, size)
        out[np.repeat(at, size) + spread] = source[np.repeat(start, size) + spread]
        out[(at + size)[mark > 0]] = mark[mark > 0]
        return full, out

    def numbers(self, words: list[bytes]) -> np.ndarray:
        """The cache's number of each distinct word; new words are encoded.  Words are known by 64-bit hashes, some 40 bytes each in all."""
        if len(self.hash) > CACHE_WORDS:
            self.clear()
        h = np.fromiter(map(xxh3_64_intdigest, words), np.uint64, len(words))
        spot = np.searchsorted(self.hash, h)
        known = np.zeros(len(h), bool)
        inside = spot < len(self.hash)
        known[inside] = self.hash[spot[inside]] == h[inside]
        new = np.flatnonzero(~known)
        if len(new):
            new = new[np.argsort(h[new])]
            size, flat = self._encoded([words[i] for i in new])
            if self.used + len(flat) > len(self.ids):
                self.ids = np.concatenate([self.ids[: self.used], np.zeros(max(len(flat), len(self.ids) // 2), np.uint32)])
            self.ids[self.used : self.used + len(flat)] = flat
            into = spot[new]
            self.hash, self.size, self.at = np.insert(self.hash, into, h[new]), np.insert(self.size, into, size), np.insert(self.at, into, self.used + np.cumsum(size) - size)
            self.used += len(flat)
            spot = np.searchsorted(self.hash, h)
        return spot

    def encode(self, words: Words, end_id: int) -> tuple[np.ndarray, np.ndarray]:
        """All ids of a block of documents, each closed by end_id, and every document's count."""
        codes, distinct = words.codes() if len(words.start) else (np.zeros(0, np.int64), [])
        number = self.numbers(distinct)[codes]
        size = self.size[number]
        start = np.cumsum(size) - size
        flat = self.ids[np.repeat(self.at[number] - start, size) + np.arange(size.sum())]
        ends = np.concatenate([[0], np.cumsum(size)])[words.first]
        return np.insert(flat, ends[1:], end_id), np.diff(ends) + 1


@lru_cache(1)
def encoder(path: str) -> Encoder:
    return Encoder(path)


def rooms(total: int, length: int) -> np.ndarray:
    """Sequence sizes that hold exactly `total` tokens: full ones, then one for each power of two in the rest."""
    rest = total % length
    return np.array([length] * (total // length) + [1 << k for k in range(rest.bit_length() - 1, -1, -1) if rest >> k & 1], np.int64)


def deal(counts: np.ndarray, length: int, last: bool) -> tuple[np.ndarray, int]:
    """Rows (document, start, tokens, sequence, offset) for documents with these token counts, and the number of sequences.

    If more documents follow, what fills no whole sequence gets the number after the last one: it is taken up only when nothing else
    has room, and is packed again with what follows.
    """
    total = int(counts.sum())
    size = rooms(total, length) if last else np.array([length] * (total // length) + [total % length] * (total % length > 0), np.int64)
    n_sequences = len(size) if last else total // length
    left, cost = size.copy(), np.zeros(len(size))
    cost[n_sequences:] = 1e300
    out = []
    for d in np.argsort(-counts, kind="stable").tolist():
        start, need = 0, int(counts[d])
        while need:
            fits = left >= min(need, length)
            s = int(np.where(fits if fits.any() else left > 0, cost, np.inf).argmin())
            n = min(need, int(left[s]))
            out.append((d, start, n, s, int(size[s] - left[s])))
            left[s] -= n
            cost[s] += LINEAR * n + QUADRATIC * n * n
            start, need = start + n, need - n
    return np.array(out, np.int64).reshape(-1, 5), n_sequences


def pack(counts: np.ndarray, length: int = LENGTH) -> np.ndarray:
    """The rows of deal() for documents that nothing follows."""
    return deal(counts, length, True)[0]


OUT = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long, ids array<int>"


def pack_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", tokenizer: str | None = None, end_id: int = END_ID, length: int = LENGTH, ids: bool = True) -> DataFrame:
    """The pieces of all documents, with their place in a sequence and, if ids is set, their token ids.

    length must be a power of two.  sequence_id is unique; it depends on how the input is read in parts.
    """
    path = tokenizer or tokenizer_path()

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, first = TaskContext.get().partitionId() << 33, 0
        enc = encoder(path)
        kept_ids, kept_start, kept_total, kept_counts = pa.array([], pa.int64()), *(np.zeros(0, np.int64) for _ in range(3))
        kept_flat = np.zeros(0, np.uint32)

        def packed(ids_: pa.Array, begun: np.ndarray, total: np.ndarray, counts: np.ndarray, flat: np.ndarray, last: bool) -> Iterator[pa.RecordBatch]:
            """Packs items (pieces kept back, then documents) and keeps back what fills no sequence, unless these are the last."""
            nonlocal first, kept_ids, kept_start, kept_total, kept_counts, kept_flat
            rows, n_sequences = deal(counts, length, last)
            begin = (np.cumsum(counts) - counts)[rows[:, 0]] + rows[:, 1]
            spread = lambda r, b: np.repeat(b - (np.cumsum(r[:, 2]) - r[:, 2]), r[:, 2]) + np.arange(r[:, 2].sum())
            out = rows[:, 3] < n_sequences
            back, back_begin = rows[~out], begin[~out]
            kept_ids, kept_start, kept_total = ids_.take(pa.array(back[:, 0])), begun[back[:, 0]] + back[:, 1], total[back[:, 0]]
            kept_counts, kept_flat = back[:, 2], flat[spread(back, back_begin)]
            rows, begin = rows[out], begin[out]
            crc = [zlib.crc32(flat[s:e]) for s, e in zip(begin.tolist(), (begin + rows[:, 2]).tolist(), strict=True)]
            if ids:
                lists = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(rows[:, 2])]), pa.int32()), pa.array(flat[spread(rows, begin)].astype(np.int32)))
            else:
                lists = pa.nulls(len(rows), pa.list_(pa.int32()))
            yield pa.record_batch([ids_.take(pa.array(rows[:, 0])), pa.array(begun[rows[:, 0]] + rows[:, 1]), pa.array(rows[:, 2]), pa.array(crc, pa.int64()), pa.array(total[rows[:, 0]]), pa.array(part + first + rows[:, 3]), pa.array(rows[:, 4]), lists], names=["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset", "ids"])
            first += n_sequences

        for batch in batches:
            for piece in slices(batch, "text", SLICE_BYTES):
                flat, counts = enc.encode(Words(*text_bytes(piece.column("text"))), end_id)
                begun = np.concatenate([kept_start, np.zeros(len(counts), np.int64)])
                yield from packed(pa.concat_arrays([kept_ids, piece.column("id")]), begun, np.concatenate([kept_total, counts]), np.concatenate([kept_counts, counts]), np.concatenate([kept_flat, flat]), False)
        if len(kept_counts):
            yield from packed(kept_ids, kept_start, kept_total, kept_counts, kept_flat, True)

    return bounded(docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))).mapInArrow(tidy(work), OUT)
