"""Text functions on columns: stripping, matches with offsets, windows and counts."""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

SPAN = "array<struct<start:int,end:int,text:string>>"
CJK = "[一-龥]"
#: Items of one stretch of scan().
SCAN = 256


def quote_pattern(words: list[str] | tuple[str, ...], longest_first: bool = True) -> str:
    """An alternation of literal words; longer words first, as alternation takes the first that fits."""
    ordered = sorted(words, key=len, reverse=True) if longest_first else words
    return "|".join(re.sub(r"([\\^$.|?*+()\[\]{}-])", r"\\\1", w) for w in ordered)


def quote_class(characters: str) -> str:
    """The inside of a character class of these characters."""
    return re.sub(r"([\\\]\[^&-])", r"\\\1", characters) or "\x00"


def one_of(c: Column, words: tuple[str, ...] | list[str]) -> Column:
    """Whether a text is one of these words: as isin, but one literal, however many words there are."""
    return c.rlike(f"\\A(?:{quote_pattern(words)})\\z") if words else c.isNull() & False


#: White space of any kind.
BLANKS = "".join(map(chr, (*range(0x09, 0x0E), 0x20, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000)))


def strip(c: Column) -> Column:
    """Without leading and trailing white space of any kind."""
    return F.trim(c, F.lit(BLANKS))


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body(value) with the value computed once, as lambda bodies would compute it for every element."""
    return F.transform(F.array(value), body)[0]


def scan(items: Column, first: Column, step: Callable[[Column, Column], Column | tuple[Column, Column]], kind: str) -> Column:
    """A fold that emits: step(state, item) gives the next state and an array<kind> to emit, or the next state alone, which is emitted then.

    Appending to one array would copy it at every step.  So stretches of SCAN items are folded into arrays of their own, which are
    joined at the end, and a text's length counts about once.
    """
    none = F.array().cast(f"array<{kind}>")

    def stretch(acc: Column, part: Column) -> Column:
        def one(inner: Column, x: Column) -> Column:
            got = step(inner["state"], x)
            if isinstance(got, tuple):
                return F.struct(got[0].alias("state"), F.concat(inner["out"], got[1]).alias("out"))
            return let(got, lambda state: F.struct(state.alias("state"), F.array_append(inner["out"], state).alias("out")))

        folded = F.aggregate(part, F.struct(acc["state"].alias("state"), none.alias("out")), one)
        return let(folded, lambda f: F.struct(f["state"].alias("state"), F.array_append(acc["out"], f["out"]).alias("out")))

    def whole(all_items: Column) -> Column:
        parts = F.transform(F.sequence(F.lit(1), F.size(all_items), F.lit(SCAN)), lambda at: F.slice(all_items, at, F.lit(SCAN)))
        start = F.struct(first.alias("state"), F.array().cast(f"array<array<{kind}>>").alias("out"))
        return F.when(F.size(all_items) > 0, F.flatten(F.aggregate(parts, start, stretch, lambda acc: acc["out"]))).otherwise(none)

    return let(items, whole)


def running(sizes: Column) -> Column:
    """Running sums of an array<int>."""
    return scan(sizes, F.lit(0), lambda at, n: at + n, "int")


def contains_any(c: Column, words: list[str] | tuple[str, ...]) -> Column:
    return c.rlike(quote_pattern(words))


def occurrences(text: Column, part: Column) -> Column:
    """Non-overlapping occurrences of a literal."""
    return F.when(F.length(part) > 0, ((F.length(text) - F.length(F.replace(text, part, F.lit("")))) / F.length(part)).cast("long")).otherwise(F.lit(0).cast("long"))


def matches(text: Column, pattern: str) -> Column:
    """All matches of a pattern with 0-based offsets: what lies between them gives their places."""
    gaps, hits = F.split(text, pattern, -1), F.regexp_extract_all(text, F.lit(pattern), F.lit(0))

    def place(x: Column) -> Column:
        ends = running(F.zip_with(x["gaps"], x["hits"], lambda g, h: F.length(g) + F.coalesce(F.length(h), F.lit(0))))
        return F.zip_with(x["hits"], F.slice(ends, F.lit(1), F.size(x["hits"])), lambda h, e: F.struct((e - F.length(h)).alias("start"), e.alias("end"), h.alias("text")))

    none = F.array().cast(SPAN)
    return F.when(text.isNull(), none).otherwise(let(F.struct(gaps.alias("gaps"), hits.alias("hits")), lambda x: F.when(F.size(x["hits"]) == 0, none).otherwise(place(x))))


def positions(text: Column, part: Column) -> Column:
    """0-based offsets of the non-overlapping occurrences of a literal."""
    gaps = F.split(text, F.concat(F.lit("\\Q"), part, F.lit("\\E")), -1)
    ends = let(gaps, lambda g: running(F.transform(F.slice(g, F.lit(1), F.size(g) - 1), lambda x: F.length(x) + F.length(part))))
    return F.when(text.isNull() | part.isNull() | (F.length(part) == 0), F.array().cast("array<int>")).otherwise(F.transform(ends, lambda e: e - F.length(part)))


def keep_earliest(spans: Column) -> Column:
    """Drops every span that overlaps an earlier kept one; the input must be sorted."""
    def step(end: Column, x: Column) -> tuple[Column, Column]:
        free = x["start"] >= end
        return F.when(free, x["end"]).otherwise(end), F.when(free, F.array(x)).otherwise(F.array().cast(SPAN))

    return scan(spans, F.lit(0), step, SPAN[6:-1])


def apart(known: Column, new: Column) -> Column:
    """The known spans and those of the new ones that overlap none of them; each side is sorted and free of overlaps, as is the result.

    One scan in order looks at the known span before a new one, one in reverse at the known one after it.
    """
    kind = "struct<start:int,end:int,text:string,new:boolean>"
    tagged = lambda spans, is_new: F.transform(spans, lambda x: F.struct(x["start"].alias("start"), x["end"].alias("end"), x["text"].alias("text"), F.lit(is_new).alias("new")))
    none = F.array().cast(f"array<{kind}>")

    def forward(end: Column, x: Column) -> tuple[Column, Column]:
        return F.when(x["new"], end).otherwise(x["end"]), F.when(x["new"] & (x["start"] < end), none).otherwise(F.array(x))

    def backward(start: Column, x: Column) -> tuple[Column, Column]:
        return F.when(x["new"], start).otherwise(x["start"]), F.when(x["new"] & (x["end"] > start), none).otherwise(F.array(x))

    both = F.sort_array(F.concat(tagged(known, False), tagged(new, True)))
    kept = F.reverse(scan(F.reverse(scan(both, F.lit(0), forward, kind)), F.lit(2**31 - 1), backward, kind))
    return F.transform(kept, lambda x: F.struct(x["start"].alias("start"), x["end"].alias("end"), x["text"].alias("text")))


def before(text: Column, start: Column, n: int) -> Column:
    """The n characters before an offset."""
    s = F.greatest(start - n, F.lit(0))
    return F.substring(text, (s + 1).cast("int"), (start - s).cast("int"))


def after(text: Column, end: Column, n: int) -> Column:
    """The n characters from an offset."""
    return F.substring(text, (end + 1).cast("int"), F.lit(n))


def last_index(text: Column, part: Column) -> Column:
    """0-based offset of the last occurrence of a literal, or -1."""
    at = F.locate_reverse(text, part) if hasattr(F, "locate_reverse") else F.instr(F.reverse(text), F.reverse(part))
    return F.when(at > 0, F.length(text) - at - F.length(part) + 1).otherwise(F.lit(-1))


def ngrams(text: Column, n: int) -> Column:
    """All n-character strings of a text."""
    return F.when(F.length(text) >= n, F.transform(F.sequence(F.lit(1), F.length(text) - n + 1), lambda i: F.substring(text, i, F.lit(n)))).otherwise(F.array().cast("array<string>"))


def clamp(c: Column, low: float = 0.0, high: float = 1.0) -> Column:
    return F.greatest(F.lit(low), F.least(F.lit(high), c))
