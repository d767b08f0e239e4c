"""Personal data: a character-level bidirectional LSTM with CRF transitions beside exact base patterns.

The tagger reads characters (each ASCII character by itself, others by 32 hashed buckets).  It is written and trained in numpy, from labelled spans that a seeded generator sets into invented
prose, in many more spellings than the base patterns know (numbers without +, other separators) and among numbers that are no personal
data (dates, amounts, versions, references).  Inference cuts a text into overlapping windows; every
window is decoded by Viterbi, each character takes the label of the window in which it lies farthest from an edge, and
the joined labels give spans that may cross windows.  Every kind has a digit or an @ by definition, so
windows without one need not be run.  Model spans must meet their kind's least form and never displace a base span.

Offsets are code points, end exclusive.  Cases: a null text is empty; null or repeated ids pass through, repeated rows are judged
each; spans that start together are listed in the order of KINDS; an empty table gives an empty result; other columns are ignored
(redact keeps them).  A text of any length is read whole: it is cut into windows, of which few are held at a time.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomspark.llm.text import bounded, tidy

KINDS = ("email", "ip", "card", "phone")
HIDDEN = 16
WINDOW, STRIDE = 128, 64
DECODE = 256
LONGEST = 512  # of a model span
LABELS = 1 + 2 * len(KINDS)  # outside, then begin and inside of every kind

_DOMAIN = re.compile(r"@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
_LOCAL = re.compile(r"[A-Za-z0-9._%+-]")
_IP = re.compile(r"(?<![0-9])[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)")  # inside a run of digits nothing matches that doesn't at its start
_CARD = re.compile(r"[0-9]([\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_HINT = re.compile(r"[0-9@]")


def _digits(s: str) -> str:
    return "".join(c for c in s if "0" <= c <= "9")


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        n = int(c) * (1 + i % 2)
        total += n - 9 if n > 9 else n
    return total % 10 == 0


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, kind number, end) of the base patterns' matches."""
    out, past = [], 0
    at = text.find("@")
    while at >= 0:
        start = at
        while start > past and _LOCAL.match(text[start - 1]):
            start -= 1
        if start < at and (m := _DOMAIN.match(text, at)):
            out.append((start, 0, m.end()))
            past = m.end()
        at = text.find("@", at + 1)
    for m in _IP.finditer(text):
        if all(len(p.lstrip("0")) < 4 and int(p.lstrip("0") or 0) < 256 for p in m[0].split(".")):
            out.append((m.start(), 1, m.end()))
    for m in _CARD.finditer(text):
        if 14 <= len(d := _digits(m[0])) <= 19 and luhn(d):
            out.append((m.start(), 2, m.end()))
    if "+" in text:
        out += [(m.start(), 3, m.end()) for m in _PHONE.finditer(text) if 10 <= len(_digits(m[0])) <= 15]
    return sorted(out)


# The alphabet: padding, every ASCII character by itself, and a bucket for every other character.
OTHERS = 32
CHARACTERS = 1 + 128 + OTHERS


def characters(text: str) -> np.ndarray:
    """Numbers of a text's characters; 0 is kept for padding."""
    points = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
    return np.where(points < 128, points + 1, 129 + (points * np.uint32(2654435761) >> np.uint32(27))).astype(np.int16)


class Tagger:
    """Bidirectional LSTM with a CRF layer on characters.  The two directions (axis 0) run side by side, the second on reversed windows."""

    def __init__(self, seed: int = 5):
        r = np.random.default_rng(seed)
        w = lambda *shape: (r.standard_normal(shape) / np.sqrt(shape[-2])).astype(np.float32)
        self.p = {"x": 3 * w(2, CHARACTERS, 4 * HIDDEN), "h": w(2, HIDDEN, 4 * HIDDEN), "b": np.zeros((2, 1, 4 * HIDDEN), np.float32), "o": w(2 * HIDDEN, LABELS), "ob": np.zeros(LABELS, np.float32), "t": np.zeros((LABELS, LABELS), np.float32)}
        self.p["b"][:, :, HIDDEN : 2 * HIDDEN] = 1  # remember at first

    def _states(self, x: np.ndarray, keep: bool) -> tuple[np.ndarray, list]:
        """Hidden states (steps, windows, 2 * HIDDEN) and, if asked, what the gradients need."""
        n, steps = x.shape
        half = np.full(4 * HIDDEN, 0.5, np.float32)  # a sigmoid is (1 + tanh(z / 2)) / 2
        half[3 * HIDDEN :] = 1
        table, wh = (self.p["x"] + self.p["b"]) * half, self.p["h"] * half
        given = np.stack([table[0][x.T], table[1][x[:, ::-1].T]], 1)  # steps, 2, windows, gates
        h = c = np.zeros((2, n, HIDDEN), wh.dtype)
        out, tape = np.empty((steps, 2, n, HIDDEN), wh.dtype), []
        for s in range(steps):
            g = np.tanh(given[s] + h @ wh)
            g[:, :, : 3 * HIDDEN] *= 0.5
            g[:, :, : 3 * HIDDEN] += 0.5
            i, f, o, u = (g[:, :, k * HIDDEN : (k + 1) * HIDDEN] for k in range(4))
            before = c
            c = f * c + i * u
            e = np.tanh(c)
            h = o * e
            out[s] = h
            if keep:
                tape.append((i, f, o, u, e, before))
        return np.concatenate([out[:, 0], out[::-1, 1]], 2), tape

    def decode(self, x: np.ndarray) -> np.ndarray:
        """Viterbi labels of windows (n, steps)."""
        e = self._states(x, False)[0] @ self.p["o"] + self.p["ob"]
        steps, n, _ = e.shape
        back = np.empty((steps, n, LABELS), np.int8)
        v = e[0]
        for s in range(1, steps):
            m = v[:, :, None] + self.p["t"][None]
            back[s] = m.argmax(1)
            v = m.max(1) + e[s]
        path = np.empty((n, steps), np.int8)
        path[:, -1] = v.argmax(1)
        for s in range(steps - 1, 0, -1):
            path[:, s - 1] = back[s][np.arange(n), path[:, s]]
        return path

    def _crf(self, e: np.ndarray, y: np.ndarray) -> tuple[float, np.ndarray, np.ndarray]:
        """Mean negative log likelihood and its gradients by emissions and transitions; sums are scaled at every step."""
        steps, n, k = e.shape
        t, top = self.p["t"], e.max(2, keepdims=True)
        w, b = np.exp(t), np.exp(e - top)
        fore, scale = np.empty_like(e), np.empty((steps, n, 1), e.dtype)
        a = b[0]
        for s in range(steps):
            a = b[s] * (a @ w) if s else a
            scale[s] = a.sum(1, keepdims=True)
            a = a / scale[s]
            fore[s] = a
        back = np.ones_like(e)
        for s in range(steps - 2, -1, -1):
            back[s] = (b[s + 1] * back[s + 1]) @ w.T / scale[s + 1]
        ge = fore * back
        arrive = b[1:] * back[1:] / scale[1:]
        gt = w * (fore[:-1].reshape(-1, k).T @ arrive.reshape(-1, k))
        at, rows = np.arange(steps)[:, None], np.arange(n)
        gold = e[at, rows, y.T].sum(0) + t[y[:, :-1], y[:, 1:]].sum(1)
        ge[at, rows, y.T] -= 1
        np.add.at(gt, (y[:, :-1], y[:, 1:]), -1)
        return float((np.log(scale[:, :, 0]).sum(0) + top[:, :, 0].sum(0) - gold).mean()), ge / n, gt / n

    def gradients(self, x: np.ndarray, y: np.ndarray) -> tuple[float, dict[str, np.ndarray]]:
        states, tape = self._states(x, True)
        loss, ge, gt = self._crf(states @ self.p["o"] + self.p["ob"], y)
        g = {"t": gt, "o": states.reshape(-1, 2 * HIDDEN).T @ ge.reshape(-1, LABELS), "ob": ge.sum((0, 1))}
        gh = ge @ self.p["o"].T
        gh = np.stack([gh[:, :, :HIDDEN], gh[::-1, :, HIDDEN:]], 1)
        n, steps = x.shape
        wt = self.p["h"].transpose(0, 2, 1)
        dz = np.empty((steps, 2, n, 4 * HIDDEN), wt.dtype)
        dh = dc = np.zeros((2, n, HIDDEN), wt.dtype)
        for s in range(steps - 1, -1, -1):
            i, f, o, u, e, before = tape[s]
            dh = dh + gh[s]
            dc = dc + dh * o * (1 - e * e)
            z = dz[s]
            z[:, :, :HIDDEN] = dc * u * i * (1 - i)
            z[:, :, HIDDEN : 2 * HIDDEN] = dc * before * f * (1 - f)
            z[:, :, 2 * HIDDEN : 3 * HIDDEN] = dh * e * o * (1 - o)
            z[:, :, 3 * HIDDEN :] = dc * i * (1 - u * u)
            dh, dc = z @ wt, dc * f
        past = np.stack([states[:-1, :, :HIDDEN], states[1:, :, HIDDEN:][::-1]], 1)  # of every step but the first
        flat = lambda v: v.transpose(1, 0, 2, 3).reshape(2, -1, v.shape[-1])
        g["h"] = flat(past).transpose(0, 2, 1) @ flat(dz[1:])
        seen = np.stack([x.T, x[:, ::-1].T]).reshape(2, -1)
        g["x"] = np.stack([(np.arange(CHARACTERS)[:, None] == seen[d]).astype(dz.dtype) @ flat(dz)[d] for d in range(2)])
        g["b"] = g["x"].sum(1, keepdims=True)
        return loss, g

    def train(self, x: np.ndarray, y: np.ndarray, rounds: int, batch: int = 40, rate: float = 0.03) -> float:
        """Adam over shuffled batches; the rate falls to a tenth.  Returns the last losses' mean."""
        r = np.random.default_rng(7)
        m, v = ({k: np.zeros_like(w) for k, w in self.p.items()} for _ in range(2))
        losses = []
        for n in range(1, rounds + 1):
            pick = r.integers(0, len(x), batch)
            loss, g = self.gradients(x[pick], y[pick])
            losses.append(loss)
            size = np.sqrt(sum(float((w * w).sum()) for w in g.values()))
            now = rate * (1 - 0.9 * n / rounds)
            for k, w in g.items():
                w = w * min(1.0, 5 / (size + 1e-6))
                m[k] = 0.9 * m[k] + 0.1 * w
                v[k] = 0.99 * v[k] + 0.01 * w * w
                self.p[k] -= (now * (m[k] / (1 - 0.9**n)) / (np.sqrt(v[k] / (1 - 0.99**n)) + 1e-8)).astype(np.float32)
        return float(np.mean(losses[-10:]))


def labelled_texts(n: int, seed: int) -> tuple[list[str], list[list[tuple[int, int, int]]]]:
    """Invented prose of WINDOW characters with labelled spans (start, kind, end), seeded."""
    r = np.random.default_rng(seed)
    parts = "an er in the on re tion ing ent ha es st ver ge ch de la en ou le que ció ado tz ß é".split()
    num = lambda k: "".join(map(str, r.integers(0, 10, k)))
    pick = lambda *a: a[r.integers(len(a))]
    word = lambda: "".join(pick(*parts) for _ in range(r.integers(1, 5)))

    def card() -> str:
        d = pick("4", "5", "37", "6") + num(int(r.integers(12, 15)))
        d += next(c for c in "0123456789" if luhn(d + c))
        sep = pick("", "", " ", "-")
        return sep.join(d[i : i + 4] for i in range(0, len(d), 4))

    def phone() -> str:
        a, b, c = num(3), num(3), num(4)
        return pick(f"+{num(1)} ({a}) {b}-{c}", f"+{num(2)} {a} {b} {c}", f"({a}) {b}-{c}", f"{a}-{b}-{c}", f"+{num(11)}", f"00{num(2)} {a} {b}{c}")

    def email() -> str:
        user = pick(word(), f"{word()}.{num(2)}", f"{word()}_{word()}", f"{word()}+{num(1)}")
        return f"{user}@{word()}{pick('', num(1))}.{pick('example.com', 'org', 'net', 'co.uk')}"

    def ip() -> str:
        return ".".join(str(x) for x in r.integers(0, 256, 4))

    def other() -> str:
        return pick(f"{num(4)}-{num(2)}-{num(2)}", f"{num(2)}/{num(2)}/{num(4)}", num(int(r.integers(1, 6))), f"${num(3)},{num(3)}.{num(2)}", f"v{num(1)}.{num(1)}.{num(2)}", f"#{num(6)}", f"{num(2)}:{num(2)}", f"{num(2)}%", f"{num(3)}.{num(2)}", f"{word()}{num(3)}", f"@{word()}")

    texts, spans = [], []
    for _ in range(n):
        text, own = "", []
        while len(text) < WINDOW:
            roll = r.random()
            if roll < 0.16:
                kind = int(r.integers(4))
                s = (email, ip, card, phone)[kind]()
                if len(text) + len(s) <= WINDOW:
                    own.append((len(text), kind, len(text) + len(s)))
                text += s
            elif roll < 0.26:
                text += other()
            else:
                w = word()
                text += w.capitalize() if roll < 0.35 else w
            text += pick(" ", " ", " ", " ", " ", ", ", ". ", ".\n")
        texts.append(text[:WINDOW])
        spans.append([s for s in own if s[2] <= WINDOW])
        # What is cut by the window's end stays unlabelled, so it is blanked.
        if own and own[-1][2] > WINDOW:
            texts[-1] = text[: own[-1][0]].ljust(WINDOW)
    return texts, spans


def labels_of(length: int, spans: list[tuple[int, int, int]]) -> np.ndarray:
    y = np.zeros(length, np.int64)
    for s, k, e in spans:
        y[s:e] = 2 + 2 * k
        y[s] = 1 + 2 * k
    return y


@lru_cache(1)
def trained_tagger(samples: int = 1500, rounds: int = 220) -> Tagger:
    """The tagger, trained once per process; it depends on nothing but the seeds."""
    texts, spans = labelled_texts(samples, 1)
    tagger = Tagger()
    tagger.train(np.stack([characters(t) for t in texts]), np.stack([labels_of(WINDOW, s) for s in spans]), rounds)
    return tagger


_LEAST = (lambda s: "@" in s and "." in s, lambda s: _IP.fullmatch(s) is not None, lambda s: 12 <= len(_digits(s)) <= 19 and luhn(_digits(s)), lambda s: 9 <= len(_digits(s)) <= 15)


def tag_texts(tagger: Tagger, texts: list[str]) -> list[list[tuple[int, int, int]]]:
    """Model spans of whole texts.  At most DECODE windows are held at a time; a text itself takes a few bytes a character."""
    coded = [characters(t) for t in texts]
    labels: dict[int, np.ndarray] = {}
    waiting: list[tuple[int, int]] = []

    def settle() -> None:
        windows = np.zeros((len(waiting), WINDOW), np.int16)
        for w, (t, s) in zip(windows, waiting, strict=True):
            w[: min(WINDOW, len(coded[t]) - s)] = coded[t][s : s + WINDOW]
        edge = (WINDOW - STRIDE) // 2
        for (t, s), path in zip(waiting, tagger.decode(windows), strict=True):
            a = 0 if s == 0 else edge
            b = WINDOW if s + WINDOW >= len(coded[t]) else WINDOW - edge
            labels.setdefault(t, np.zeros(len(coded[t]), np.int8))[s + a : s + b] = path[a:b][: max(0, len(coded[t]) - s - a)]
        waiting.clear()

    for t, x in enumerate(coded):
        hint = np.concatenate([[0], np.cumsum(((x >= 49) & (x <= 58)) | (x == 65), dtype=np.int32)])  # digits and @
        starts = np.arange(0, max(len(x) - WINDOW + STRIDE, 1), STRIDE)
        ends = np.minimum(starts + WINDOW, len(x))
        for s in starts[hint[ends] > hint[starts]].tolist():
            waiting.append((t, s))
            if len(waiting) == DECODE:
                settle()
    if waiting:
        settle()
    out: list[list[tuple[int, int, int]]] = [[] for _ in texts]
    for t, y in labels.items():
        kind = np.where(y > 0, (y - 1) // 2, -1)
        begin = (y > 0) & ((y % 2 == 1) | (np.concatenate([[-1], kind[:-1]]) != kind))
        # A span ends where another begins or its kind does.
        cut = begin | (np.concatenate([[-1], kind[:-1]]) != kind)
        cuts = np.append(np.flatnonzero(cut), len(y))
        for s in np.flatnonzero(begin).tolist():
            e = int(cuts[np.searchsorted(cuts, s, "right")])
            if e - s <= LONGEST and _LEAST[kind[s]](texts[t][s:e]):
                out[t].append((s, int(kind[s]), e))
    return out


def find(tagger: Tagger, texts: list[str]) -> list[tuple[list[tuple[int, int, int]], list[tuple[int, int, int]]]]:
    """Base spans and all spans (model spans that touch no base span are added) of each text."""
    out: list[tuple[list, list]] = [([], []) for _ in texts]
    some = [i for i, t in enumerate(texts) if _HINT.search(t)]
    for i, model in zip(some, tag_texts(tagger, [texts[i] for i in some]), strict=True):
        base = base_spans(texts[i])
        taken = sorted((s, e) for s, _, e in base)
        starts = [s for s, _ in taken]
        reach = np.maximum.accumulate([e for _, e in taken]) if taken else np.zeros(0, np.int64)
        free = [m for m in model if not ((j := int(np.searchsorted(starts, m[2]))) and reach[j - 1] > m[0])]
        out[i] = (base, sorted(base + free))
    return out


def join_spans(spans: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[k]}:{s}:{e}" for s, k, e in spans)


def mask(text: str, spans: list[tuple[int, int, int]]) -> str:
    """The text with every span replaced by its kind in brackets; overlapping spans become one."""
    out, past = [], 0
    for s, k, e in spans:
        if s >= past:
            out += [text[past:s], f"[{KINDS[k].upper()}]"]
        past = max(past, e)
    return "".join([*out, text[past:]])


OUT = "doc_id long, n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, spans string, found array<struct<kind:string,start:long,end:long>>"


def find_pii(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Counts of the base kinds, a digest of the base spans, all spans as text and as structs."""
    shared = docs.sparkSession.sparkContext.broadcast(trained_tagger())  # a few thousand weights

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        struct = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())]))
        for batch in batches:
            for i in range(0, batch.num_rows, 512):
                piece = batch.slice(i, 512)
                got = find(shared.value, [t or "" for t in piece.column("text").to_pylist()])
                counts = [pa.array([sum(s[1] == k for s in base) for base, _ in got], pa.int64()) for k in range(len(KINDS))]
                sha = pa.array([hashlib.sha256(join_spans(base).encode()).hexdigest() for base, _ in got], pa.string())
                found = pa.array([[{"kind": KINDS[k], "start": s, "end": e} for s, k, e in spans] for _, spans in got], struct)
                yield pa.record_batch([piece.column("id"), *counts, sha, pa.array([join_spans(x) for _, x in got], pa.string()), found], names=["doc_id", *(f"n_{k}" for k in KINDS), "base_sha256", "spans", "found"])

    return bounded(docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))).mapInArrow(tidy(work), OUT)


def redact(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """The same rows and columns with all personal data in the texts masked; null stays null."""
    shared = docs.sparkSession.sparkContext.broadcast(trained_tagger())
    schema = docs.schema

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = batch.schema.get_field_index(text_col)
            for i in range(0, batch.num_rows, 512):
                piece = batch.slice(i, 512)
                texts = piece.column(at).to_pylist()
                got = find(shared.value, [t or "" for t in texts])
                clean = [None if t is None else mask(t, spans) for t, (_, spans) in zip(texts, got, strict=True)]
                yield pa.record_batch([pa.array(clean, c.type) if j == at else c for j, c in enumerate(piece.columns)], schema=piece.schema)

    return bounded(docs).mapInArrow(tidy(work), schema)
