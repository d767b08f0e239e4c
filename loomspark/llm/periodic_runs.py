"""Periodic runs of words: a suffix automaton whose end-position sets are merged small to large.

A run is a stretch of words with smallest period q that no neighbouring word extends.  The automaton of a stretch of words has a state
for each class of substrings with the same end positions.  Going up the suffix links from the longest states, the smaller of two ordered
sets of end positions is put into the larger, and each inserted position meets its new neighbours: two ends x < y of a state of
length m are ends of equal strings, so a distance d = y - x of at most m is a square's.  Their longest common suffix is
the state's length, so the square's run begins at x - m + 1; of a run's squares that one gives the result which the word after y
ends, since w[y + 1] differs from w[y + 1 - d].  A stretch found with several periods has the least of them.

Only a state of length (exponent - 1) * d can hold a run of that exponent, so sets of shorter states than any run needs aren't merged.
And only words that lie in a repeated triple enter an automaton: each triple of a run recurs in it (least_repeats() counts how often at
least), so a stretch of words between those that don't is taken for itself.  Triples are counted by hash, and equal hashes of different ones
only let more words in.

A document's work is in its own row: no shuffle, nothing collected.  Memory follows the longest stretch of repeated words of one document
(some 500 bytes a word in the automaton); a set of more than WIDE positions is kept in pieces, so that an insertion stays cheap.

Cases: a null or empty text has no words and no runs; a null id is never rewritten; repeated rows are worked on one by one; of longest
runs that tie the first, then the least period is reported; texts of any length count whole; an empty table gives an
empty result; columns beyond the id and the text are ignored.
"""

from __future__ import annotations

import hashlib
import zlib
from bisect import bisect_left
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomspark.llm.text import Words, bounded, covered, mix, runs, slices, span_hashes, text_bytes, tidy

MIN_LENGTH, MIN_EXPONENT = 6, 4
GRAM = 3
WIDE = 2048
OUT = "doc_id long, n_runs long, start long, length long, period long, exponent_milli long, runs_sha256 string, collapsed_sha256 string"


class Ends:
    """An ordered set of positions in pieces of at most WIDE."""

    def __init__(self, ordered: list[int]):
        self.pieces = [ordered[i : i + WIDE // 2] for i in range(0, len(ordered), WIDE // 2)]
        self.firsts = [p[0] for p in self.pieces]
        self.size = len(ordered)

    def __len__(self) -> int:
        return self.size

    def __iter__(self) -> Iterator[int]:
        for p in self.pieces:
            yield from p

    def put(self, x: int) -> tuple[int, int]:
        """Inserts a position; returns its neighbours, -1 where there is none."""
        k = max(0, bisect_left(self.firsts, x) - 1)
        piece = self.pieces[k]
        j = bisect_left(piece, x)
        low = piece[j - 1] if j else -1
        high = piece[j] if j < len(piece) else self.firsts[k + 1] if k + 1 < len(self.firsts) else -1
        piece.insert(j, x)
        self.size += 1
        if not j:
            self.firsts[k] = x
        if len(piece) > WIDE:
            half = len(piece) // 2
            self.pieces.insert(k + 1, piece[half:])
            self.firsts.insert(k + 1, piece[half])
            del piece[half:]
        return low, high


def automaton(words: list[int]) -> tuple[list[int], list[int], list[int]]:
    """Length, suffix link and own end position (-1 for a clone) of the states of a sequence's suffix automaton; state 0 is the empty string."""
    length, link, own = [0], [-1], [-1]
    moves: list[dict[int, int]] = [{}]
    last = 0
    for i, w in enumerate(words):
        new, p = len(moves), last
        moves.append({})
        length.append(i + 1)
        link.append(0)
        own.append(i)
        while p >= 0 and w not in moves[p]:
            moves[p][w] = new
            p = link[p]
        if p >= 0:
            q = moves[p][w]
            if length[q] == length[p] + 1:
                link[new] = q
            else:
                clone = len(moves)
                moves.append(moves[q].copy())
                length.append(length[p] + 1)
                link.append(link[q])
                own.append(-1)
                link[q] = link[new] = clone
                while p >= 0 and moves[p].get(w) == q:
                    moves[p][w] = clone
                    p = link[p]
        last = new
    return length, link, own


def periodic_stretches(words: list[int], min_length: int = MIN_LENGTH, min_exponent: int = MIN_EXPONENT) -> list[tuple[int, int, int]]:
    """(start, length, period) of the maximal runs of a sequence with at least that length and exponent (2 or more), by start, then period."""
    n = len(words)
    # A run of period d is seeded in a state of its length less d.
    least = min(max(min_length - d, (min_exponent - 1) * d) for d in range(1, min_length + 1))
    length, link, own = automaton(words)
    ends: list = [None if x < 0 else [x] for x in own]
    found: dict[tuple[int, int], int] = {}
    for v in np.argsort(-np.array(length), kind="stable").tolist():
        p = link[v]
        if p < 0 or length[p] < least:
            ends[v] = None
            continue
        big, small, m = ends[p], ends[v], length[p]
        ends[v] = None
        if big is None:
            ends[p] = small
            continue
        if len(big) < len(small):
            big, small = small, big
        if len(big) > WIDE and isinstance(big, list):
            big = Ends(big)
        before = -1
        for x in small:
            if isinstance(big, list):
                j = bisect_left(big, x)
                low, high = big[j - 1] if j else -1, big[j] if j < len(big) else -1
                big.insert(j, x)
            else:
                low, high = big.put(x)
            for a, b in ((-1 if low == before else low, x), (x, high)):  # two of the smaller set met in an earlier state
                d = b - a
                if a >= 0 and 0 < d <= m and (b + 1 == n or words[b + 1] != words[a + 1]):
                    span = a - m + 1, m + d
                    found[span] = min(found.get(span, d), d)
            before = x
        ends[p] = big
    return sorted((s, size, d) for (s, size), d in found.items() if size >= max(min_length, min_exponent * d))


def least_repeats(min_length: int, min_exponent: int) -> int:
    """How often each triple of a run recurs in it, at least."""
    return min(min_exponent - 1, *((max(min_length, min_exponent * q) - GRAM + 1) // q for q in range(1, GRAM)))


def repeated_words(codes: np.ndarray, doc: np.ndarray, times: int) -> np.ndarray:
    """Which words lie in a triple that their document has at least so many times."""
    n = len(codes)
    if n < GRAM:
        return np.zeros(n, bool)
    gram = span_hashes(mix(codes.astype(np.uint64), np.uint64(1)), GRAM)
    at = np.flatnonzero(doc[: n - GRAM + 1] == doc[GRAM - 1 :])
    _, which, count = np.unique(mix(gram[at], doc[at].astype(np.uint64)), return_inverse=True, return_counts=True)
    return covered(at[count[which] >= times], GRAM, n)


def tail_repeated(doc_id: int | None, n: int) -> tuple[int, int] | None:
    """(first word, period) from which on a document of n words repeats itself in the query's table, or None."""
    h = None if doc_id is None else zlib.crc32(str(doc_id).encode())
    if h is None or h % 10 or not n:
        return None
    a = h // 10 % n
    return a, 1 + (n - a) // (3 + h // 10 % 8)


def periodic_runs(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_length: int = MIN_LENGTH, min_exponent: int = MIN_EXPONENT, texts: bool = True, rewrite: Callable[[int | None, int], tuple[int, int] | None] | None = None) -> DataFrame:
    """The runs of every whole text, its longest one, digests, and with texts the runs as an array and the text without their repetitions.

    A word goes if a run has it after its first period.  rewrite: from the id and the number of words, from which word on with which period
    the text is to repeat itself before the search; None where it stays.
    """
    times = least_repeats(min_length, min_exponent)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for piece in slices(batch, "text"):
                words = Words(*text_bytes(piece.column("text")))
                codes, distinct = words.codes()
                codes = codes.astype(np.int64)
                ids, first = piece.column("id").to_pylist(), words.first.tolist()
                if rewrite:
                    for i, doc_id in enumerate(ids):
                        s, e = first[i], first[i + 1]
                        again = rewrite(doc_id, e - s)
                        if again:
                            a, p = again
                            codes[s + a : e] = codes[s + a + np.arange(e - s - a) % p]
                open_ = repeated_words(codes, words.doc, times)
                rows = []
                for i in range(len(ids)):
                    s, e = first[i], first[i + 1]
                    found, gone = [], np.zeros(e - s, bool)
                    for a, b in zip(*runs(open_[s:e]), strict=True):
                        if b - a >= min_length:
                            found += [(int(a) + x, size, q) for x, size, q in periodic_stretches(codes[s + a : s + b].tolist(), min_length, min_exponent)]
                    for x, size, q in found:
                        gone[x + q : x + size] = True
                    longest = min(found, key=lambda r: (-r[1], r[0], r[2]), default=None)
                    kept = b" ".join([distinct[c] for c in codes[s:e][~gone].tolist()])
                    row = {"doc_id": ids[i], "n_runs": len(found), "start": None, "length": None, "period": None, "exponent_milli": None}
                    if longest:
                        row |= {"start": longest[0], "length": longest[1], "period": longest[2], "exponent_milli": 1000 * longest[1] // longest[2]}
                    row |= {"runs_sha256": hashlib.sha256("".join(f"{x},{size},{q}\n" for x, size, q in found).encode()).hexdigest(), "collapsed_sha256": hashlib.sha256(kept).hexdigest()}
                    rows.append(row | ({"runs": [{"start": x, "length": size, "period": q} for x, size, q in found], "collapsed": kept.decode()} if texts else {}))
                yield pa.RecordBatch.from_pylist(rows, schema)

    texts_ = ", runs array<struct<start:long,length:long,period:long>>, collapsed string" if texts else ""
    kinds = {"runs": pa.list_(pa.struct([(c, pa.int64()) for c in ("start", "length", "period")])), "collapsed": pa.string(), "runs_sha256": pa.string(), "collapsed_sha256": pa.string()}
    schema = pa.schema([(c.split()[0], kinds.get(c.split()[0], pa.int64())) for c in (OUT.split(", ") + (["runs x", "collapsed x"] if texts else []))])
    plain = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))
    return bounded(plain).mapInArrow(tidy(work), OUT + texts_)
