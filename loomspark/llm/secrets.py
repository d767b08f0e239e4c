"""Secret scan: Aho-Corasick keyword prefilter, anchored expressions near its hits, checksum validation.

One automaton pass over a text finds every keyword.  An expression is tried only at the hits of its own
keyword, anchored there.  Hex runs have no keyword; a single class scan finds the long runs.  Beyond the three
base kinds, kinds with a structure that can be verified are reported only when it holds:

* github, npm: a prefix, 30 base-62 characters and their CRC-32 as 6 more;
* jwt: three base64url parts of which the first is a JSON object with "alg";
* key: a PEM private key whose DER length matches its payload.

Offsets are code points, end exclusive.  Cases: a null text is empty; null or repeated ids pass through, a repeated row is
judged again; two kinds that start together are listed in the order of KINDS; an empty table gives an empty result; extra
columns are ignored.  A text of any length is read whole, in a time that grows with its length: no expression is tried twice over
the same run of characters and none backtracks.
"""

from __future__ import annotations

import base64
import binascii
import hashlib
import json
import re
import zlib
from collections.abc import Iterator
from functools import lru_cache

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomspark.llm.text import bounded

KINDS = ("assign", "access", "hex", "github", "npm", "jwt", "key")
BASE = 3
_ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.ASCII | re.IGNORECASE)
_ACCESS = re.compile(r"AKIA[A-Z0-9]+")
_HEX = re.compile(r"[0-9a-f]{24,}")
_CHECKED = re.compile(r"(?:gh[pousr]|npm)_([0-9A-Za-z]{30})([0-9A-Za-z]{6})(?![0-9A-Za-z])")
_JWT = re.compile(r"(?<![\w-])(eyJ[\w-]++)\.[\w-]++\.[\w-]++", re.ASCII)  # one try for a run of these characters
_PEM = re.compile(r"-----BEGIN (?:[A-Z]+ )?PRIVATE KEY-----(\s[A-Za-z0-9+/=\s]++)-----END (?:[A-Z]+ )?PRIVATE KEY-----")
_BASE62 = "0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz"


@lru_cache
def _automaton() -> ahocorasick.Automaton:
    words = {w: "assign" for w in ("password", "passwd", "secret", "token", "apikey", "api_key")}
    words |= {"akia": "access", "eyj": "jwt", "-----begin ": "key", "npm_": "npm"} | {f"gh{c}_": "github" for c in "pousr"}
    found = ahocorasick.Automaton()
    for w, kind in words.items():
        found.add_word(w, (kind, len(w)))
    found.make_automaton()
    return found


def crc62(body: str) -> str:
    """The six base-62 characters that close a checked token."""
    n, out = zlib.crc32(body.encode()), ""
    for _ in range(6):
        n, digit = divmod(n, 62)
        out = _BASE62[digit] + out
    return out


def _is_jwt(head: str) -> bool:
    try:
        value = json.loads(base64.urlsafe_b64decode(head + "=" * (-len(head) % 4)))
    except (ValueError, RecursionError):
        return False
    return isinstance(value, dict) and "alg" in value


def _is_der(body: str) -> bool:
    try:
        raw = base64.b64decode("".join(body.split()), validate=True)
    except binascii.Error:
        return False
    if len(raw) < 2 or raw[0] != 0x30:
        return False
    wide = raw[1] - 128 if raw[1] > 128 else 0
    size = int.from_bytes(raw[2 : 2 + wide], "big") if wide else raw[1]
    return len(raw) == 2 + wide + size


def scan(text: str) -> list[tuple[int, int, int]]:
    """(start, kind number, end) of every secret, by start, then kind."""
    out: list[tuple[int, int, int]] = [(m.start(), 2, m.end()) for m in _HEX.finditer(text)]
    past = dict.fromkeys(KINDS, 0)  # a kind's matches don't overlap
    lower = text.lower() if text.isascii() else text.encode("utf-8", "surrogatepass").lower().decode("utf-8", "surrogatepass")
    hits = [(end + 1 - n, kind) for end, (kind, n) in _automaton().iter(lower)]
    for at, kind in sorted(hits):
        if at < past[kind]:
            continue
        if kind == "assign":
            if m := _ASSIGN.match(text, at):
                past[kind] = m.end()
                if len(m[2]) >= 6:
                    out.append((at, 0, m.end()))
        elif kind == "access":
            if m := _ACCESS.match(text, at):
                past[kind] = m.end()
                if len(m[0]) >= 20:
                    out.append((at, 1, m.end()))
        elif kind in ("github", "npm"):
            if (m := _CHECKED.match(text, at)) and crc62(m[1]) == m[2]:
                past[kind] = m.end()
                out.append((at, KINDS.index(kind), m.end()))
        elif kind == "jwt":
            if (m := _JWT.match(text, at)) and _is_jwt(m[1]):
                past[kind] = m.end()
                out.append((at, 5, m.end()))
        elif (m := _PEM.match(text, at)) and _is_der(m[1]):
            past[kind] = m.end()
            out.append((at, 6, m.end()))
    return sorted(out)


def join_spans(spans: list[tuple[int, int, int]], kinds: tuple[str, ...]) -> str:
    return ",".join(f"{kinds[k]}:{s}:{e}" for s, k, e in spans)


OUT = "doc_id long, n_assign long, n_access long, n_hex long, base_sha256 string, spans string, found array<struct<kind:string,start:long,end:long>>"


def scan_secrets(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Finds secrets in whole texts: counts of the base kinds, a digest of the base spans, all spans as text and as structs."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        struct = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())]))
        for batch in batches:
            rows = []
            for text in batch.column("text"):
                spans = scan(text.as_py() or "")
                base = [s for s in spans if s[1] < BASE]
                rows.append(([sum(s[1] == k for s in base) for k in range(BASE)], hashlib.sha256(join_spans(base, KINDS).encode()).hexdigest(), join_spans(spans, KINDS), [{"kind": KINDS[k], "start": s, "end": e} for s, k, e in spans]))
            counts = [pa.array([r[0][k] for r in rows], pa.int64()) for k in range(BASE)]
            yield pa.record_batch([batch.column("id"), *counts, pa.array([r[1] for r in rows], pa.string()), pa.array([r[2] for r in rows], pa.string()), pa.array([r[3] for r in rows], struct)], names=["doc_id", "n_assign", "n_access", "n_hex", "base_sha256", "spans", "found"])

    return bounded(docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))).mapInArrow(work, OUT)
