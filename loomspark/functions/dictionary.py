"""All names of a text's own dictionary in one pass over the text.

Each text has names of its own, so no pattern of the plan could hold them: an Aho-Corasick automaton is built per row from an
array of names, and one pass gives the places of all of them.  The time of a row grows with its text, its names and what is found, not with
texts times names.  The functions are columns (Arrow batches), so what stands beside the text in its row never goes to Python.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterable

import ahocorasick
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

HITS = "array<struct<name:string,starts:array<int>,next:array<string>,windows:array<string>>>"
MARKED = HITS[:-2] + ",marks:array<int>>>"
_BLANK = frozenset(" \t\n\x0b\f\r")


def automaton(names: Iterable[str]) -> ahocorasick.Automaton | None:
    """Of the distinct names that aren't empty; None without any."""
    found = ahocorasick.Automaton()
    for n in names:
        if n:
            found.add_word(n, n)
    if not len(found):
        return None
    found.make_automaton()
    return found


def places(found: ahocorasick.Automaton | None, text: str | None, apart: bool = True) -> dict[str, list[int]]:
    """Where each name starts; apart: without places that overlap the name's place before."""
    out: dict[str, list[int]] = {}
    if found is None or not text:
        return out
    for end, name in found.iter(text):
        start = end - len(name) + 1
        known = out.setdefault(name, [])
        if not (apart and known and start < known[-1] + len(name)):
            known.append(start)
    return out


def is_mark(c: str) -> bool:
    return c in _BLANK or unicodedata.category(c)[0] == "P"


def marks_near(name: str, windows: Iterable[str], behind: list[tuple[str, re.Pattern]]) -> list[int]:
    """For each word how often it stands in the windows behind 1 to 4 characters that are in the name or hold it."""
    counts = [0] * len(behind)
    for w in windows:
        for i, (word, pattern) in enumerate(behind):
            if word in w:
                counts[i] += sum(m in name or name in m for m in pattern.findall(w))
    return counts


def behind_words(words: tuple[str, ...]) -> list[tuple[str, str]]:
    """Each word with the pattern of 1 to 4 characters before it."""
    return [(w, f"([^\n\r\x85\u2028\u2029]{{1,4}}){re.escape(w)}") for w in words]


def name_statistics(texts: list[str | None], names: list[str], width: int, near: int, words: tuple[str, ...], spoken: tuple[str, ...], high: int) -> list[tuple]:
    """Of the texts of one id and its distinct names: (name, n, neighbours, diversity, templates, hits, co_diversity, high_conf_co, merged), a row for each name and text.

    n: non-overlapping places in that text; the rest is of all texts.  neighbours: the distinct characters among the `width` after a place, sorted,
    diversity their number.  templates, hits: how many of the words, and how often, stand near a place as in marks_near().  These three are
    None for a name without a place.  co_diversity: names that share a line, by its number, with it; high_conf_co: on how many lines, each
    counted for every text that has the other name `high` times.  Both are None without such a name.  merged: at most two places, three characters
    or more, and a beginning one or two shorter that has `high` places and more than ten times as many, if half of the neighbours are `spoken`.

    Partners are told by one bit for each name, so a line takes the time of its names times the names' bits; no pair is made.
    """
    names = sorted(names)
    place = {n: i for i, n in enumerate(names)}
    found, tests = automaton(names), [(w, re.compile(p)) for w, p in behind_words(words)]
    counts = [[0] * len(texts) for _ in names]
    follow: list[set[str]] = [set() for _ in names]
    marks = [[0] * len(words) for _ in names]
    lines: dict[int, set[int]] = {}
    for k, t in enumerate(texts):
        if not t or found is None:
            continue
        starts: dict[str, list[int]] = {}
        line, end_of_line = 0, t.find("\n")
        for end, name in found.iter(t):
            while 0 <= end_of_line < end:
                line, end_of_line = line + 1, t.find("\n", end_of_line + 1)
            if "\n" not in name:
                lines.setdefault(line, set()).add(place[name])
            start = end - len(name) + 1
            known = starts.setdefault(name, [])
            if not (known and start < known[-1] + len(name)):
                known.append(start)
        for name, at in starts.items():
            i = place[name]
            counts[i][k] = len(at)
            follow[i].update(c for s in at for c in t[s + len(name) : s + len(name) + width] if not is_mark(c))
            if tests:
                marks[i] = [a + b for a, b in zip(marks[i], marks_near(name, (t[max(0, s - near) : s + near] for s in at), tests), strict=True)]
    often = [sum(n >= high for n in each) for each in counts]
    partners, weight = [0] * len(names), [0] * len(names)
    for here in lines.values():
        bits, total = sum(1 << i for i in here), sum(often[i] for i in here)
        for i in here:
            partners[i] |= bits
            weight[i] += total - often[i]
    out = []
    for i, name in enumerate(names):
        occurs, others = any(counts[i]), (partners[i] & ~(1 << i)).bit_count()
        shorter = [n for p in (name[:-1], name[:-2]) if p in place for n in counts[place[p]] if n >= high] if len(name) >= 3 else []
        talk = follow[i] and len(follow[i].intersection(spoken)) / len(follow[i]) >= 0.5
        merged = bool(talk) and any(n <= 2 and n < 0.1 * m for n in counts[i] for m in shorter)
        told = (len(follow[i]), sum(m > 0 for m in marks[i]), sum(marks[i])) if occurs else (None, None, None)
        out += [(name, n, sorted(follow[i]), *told, *((others, weight[i]) if others else (None, None)), merged) for n in counts[i]]
    return out


def name_hits(text: Column, names: Column, width: int = 0, before: int = 0, after: int = 0, found_only: bool = False, near: int = 0, words: tuple[str, ...] = ()) -> Column:
    """Every distinct name of the array (found_only: that the text has) with its non-overlapping places in the text, in order.

    next: with width, the distinct characters among the `width` after any place that are neither punctuation nor blank, sorted.
    windows: with before or after, for every place the text from `before` characters before the name to `after` behind its end.
    marks: with words, for each how often it stands within `near` characters of any place's start, behind 1 to 4 characters that are in the name or hold it.
    A null text has no places; null and empty names are left out.
    """
    behind = behind_words(words)

    @F.pandas_udf(MARKED if words else HITS)
    def hits(texts: pd.Series, arrays: pd.Series) -> pd.Series:
        tests = [(w, re.compile(p)) for w, p in behind]

        def one(t: str | None, ns: Iterable[str] | None) -> list[dict]:
            wanted = sorted({n for n in (() if ns is None else ns) if n})
            where = places(automaton(wanted), t)
            rows = []
            for n in sorted(where) if found_only else wanted:
                starts = where.get(n, [])
                follow = {c for s in starts for c in t[s + len(n) : s + len(n) + width] if not is_mark(c)} if width and starts else ()
                cut = [t[max(0, s - before) : s + len(n) + after] for s in starts] if before or after else []
                marks = {"marks": marks_near(n, (t[max(0, s - near) : s + near] for s in starts), tests)} if tests else {}
                rows.append({"name": n, "starts": starts, "next": sorted(follow), "windows": cut} | marks)
            return rows

        return pd.Series([one(t, ns) for t, ns in zip(texts, arrays, strict=True)], dtype=object)

    return hits(text, names)


def names_in(texts: Column, names: Column, lone: str = "") -> Column:
    """For each text of an array the names that it contains, sorted.

    lone: a class of characters; a name of one character must have a place whose neighbours are none of them.
    """

    @F.pandas_udf("array<array<string>>")
    def found(arrays: pd.Series, dictionaries: pd.Series) -> pd.Series:
        alone = re.compile(f"(?<!{lone})(?s:.)(?!{lone})") if lone else None

        def one(ts: Iterable[str | None] | None, ns: Iterable[str] | None) -> list[list[str]]:
            search = automaton(() if ns is None else ns)
            rows = []
            for t in () if ts is None else ts:
                where = places(search, t, apart=False)
                rows.append(sorted(n for n, starts in where.items() if alone is None or len(n) > 1 or t == n or any(alone.match(t, s) for s in starts)))
            return rows

        return pd.Series([one(ts, ns) for ts, ns in zip(arrays, dictionaries, strict=True)], dtype=object)

    return found(texts, names)
