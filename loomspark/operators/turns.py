"""Who speaks a turn: signals that need a chapter's order, in one ordered fold with typed state.

The state of a chapter: who was mentioned (the last 20 different names), who spoke (the last 10, by first time), each speaker's activity (a
weight that decays with every turn that someone is found for), and the last speaker.  A turn adds its mentions, gathers candidates from its options, its hint,
pronouns, mentions, forms of address and trigger words, takes the surest one, looks it up in the library and counts it.

The group of a fold is one chapter's turns; its project's people come to it once, as a row of their own, so they aren't repeated for each turn.
"""

from __future__ import annotations

import re
from collections.abc import Iterable
from dataclasses import dataclass, field
from math import exp

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

DECAY, RECENT, MENTIONS, NEAR = 0.05, 10, 20, 20
#: What an option loses if its name is one of the last five new speakers, the latest first, and what is left at least.
FADES, FLOOR = (0.25, 0.15, 0.08, 0.08, 0.08), 0.20


@dataclass(frozen=True)
class TurnWords:
    """Words of one language.  Fixed values: those of the first one."""

    pronouns: dict[str, str] = field(default_factory=lambda: {"他": "male", "她": "female", "它": "neutral", "他们": "male_plural", "她们": "female_plural", "它们": "neutral_plural", "其": "neutral", "此人": "neutral"})
    unknown: tuple[str, ...] = ("UNKNOWN", "未知", "unknown")
    titles: tuple[str, ...] = tuple("大人 陛下 殿下 阁下 公子 小姐 夫人 老爷 少爷 姑娘 前辈 晚辈 师傅 师父 长老 掌门 教主 帮主 城主 族长 家主".split())
    actions: tuple[str, ...] = tuple("点头 摇头 皱眉 转身 站起 坐下 抬手 挥手 冷笑 微笑 苦笑 大笑 叹气 拍案 拂袖 推门 推开门 走进 走入 走出 看向 盯着 扫了".split())
    addresses: tuple[str, ...] = tuple("兄台 兄 弟 妹 姐 叔 伯 婶 姨 姑 舅 哥 贤弟 贤兄 仁兄".split())
    verbs: str = "道说问喊叫呼唤喝"
    sentence_ends: str = "。！？\n"
    before_objects: str = "对向给把"
    object_verbs: str = "看打问叫喊"
    aspect: str = "了"
    possessive: str = "的"
    pauses: tuple[str, ...] = ("，", ",")
    introductions: str = r"我(?:是|叫)([一-龥]{2,4}?)(?:[，。！？\s]|$)"


@dataclass(frozen=True)
class Person:
    id: int
    name: str
    aliases: frozenset[str]
    gender: str | None


@dataclass
class State:
    """What a chapter's turns have told so far."""

    people: list[Person]
    words: TurnWords
    mentions: list[str] = field(default_factory=list)
    recent: list[str] = field(default_factory=list)
    activity: dict[int, tuple[float, int]] = field(default_factory=dict)
    counter: int = 0
    last: str | None = None

    def __post_init__(self) -> None:
        self.by_name: dict[str, Person] = {}
        self.by_alias: dict[str, Person] = {}
        for p in self.people:
            self.by_name.setdefault(p.name, p)
            for a in sorted(p.aliases):
                self.by_alias.setdefault(a, p)
        self.called = {a: [p for p in self.people if a in p.aliases or p.name.endswith(a)] for a in self.words.addresses}
        self.titled = {t: next((p for p in self.people if t in p.name or t in p.aliases), None) for t in self.words.titles}

    def mention(self, names: Iterable[str]) -> None:
        for n in names:
            if n not in self.mentions:
                self.mentions.append(n)
        self.mentions = self.mentions[-MENTIONS:]

    def raw(self, p: Person) -> float:
        return self.activity.get(p.id, (0.0, 0))[0]

    def weight(self, p: Person) -> float:
        w, at = self.activity.get(p.id, (0.0, self.counter))
        return w * exp(-DECAY * (self.counter - at))

    def spoke(self, p: Person) -> None:
        self.counter += 1
        self.activity[p.id] = (self.weight(p) + 1.0, self.counter)
        if p.name not in self.recent:
            self.recent = [*self.recent, p.name][-RECENT:]
        self.last = p.name

    def faded(self, name: str, sure: float) -> float:
        """Whoever has just spoken is less likely to go on."""
        latest = self.recent[-len(FADES) :][::-1]
        return max(sure - FADES[latest.index(name)], FLOOR) if name in latest else sure

    def position_bonus(self, name: str, before: str) -> float:
        """0.15 for a subject (before a speech verb, or first in a sentence), -0.10 for an object."""
        w, n = self.words, re.escape(name)
        if not before:
            return 0.0
        if re.search(f"{n}[^{w.verbs}]{{0,10}}[{w.verbs}]", before) or any(s.strip().startswith(name) for s in re.split(f"[{w.sentence_ends}]", before)):
            return 0.15
        if re.search(f"[{w.before_objects}]{n}", before) or (w.object_verbs and re.search(f"[{w.object_verbs}]{w.aspect}{n}", before)):
            return -0.10
        return 0.0

    def by_pronoun(self, gender: str, before: str) -> tuple[str, float, str] | None:
        """Recent speakers and mentions of the gender; else the last speaker, an older mention, the most active one of it."""
        found: dict[str, float] = {}
        for i, n in enumerate(reversed(self.recent)):
            p = self.by_name.get(n)
            if p and p.gender == gender:
                found.setdefault(n, 1.0 - i / len(self.recent) + min(self.raw(p) * 0.05, 0.2) + self.position_bonus(n, before))
        near = self.mentions[-10:]
        for i, n in enumerate(reversed(near)):
            p = self.by_name.get(n)
            if p and p.gender == gender and n not in found:
                found[n] = 1.0 - i / len(near) + min(self.raw(p) * 0.03, 0.1) - 0.1 + self.position_bonus(n, before)
        if found:
            name = max(found, key=found.get)
            return name, min(0.85 + found[name] * 0.1, 0.95), "pronoun_local_window"
        same = lambda n: (p := self.by_name.get(n)) is not None and p.gender == gender
        if self.last is not None and same(self.last):
            return self.last, 0.8, "pronoun_last_speaker"
        older = next((n for n in reversed(self.mentions) if same(n)), None)
        if older is not None:
            return older, 0.7, "pronoun_mention"
        of_gender = [p for p in self.people if p.gender == gender]
        return (max(of_gender, key=self.weight).name, 0.4, "pronoun_activity") if of_gender else None

    def by_address(self, text: str) -> tuple[str, float, str] | None:
        """Someone other than the person that a form of address in the text means."""
        addressed = next((ps[0] for a, ps in self.called.items() if a in text and ps), None)
        found = [(0.6 + self.weight(p) * 0.05, self.weight(p), p) for p in self.people if p is not addressed] if addressed else []
        known = [self.by_name.get(n) for n in reversed(self.mentions[-5:])]
        found += [(0.5 + self.weight(p) * 0.03, self.weight(p), p) for p in known if p and p is not addressed]
        last = self.by_name.get(self.last) if self.last is not None else None
        if last and last is not addressed:
            found.append((0.4, self.weight(last), last))
        if not found:
            return None
        sure, _, p = max(found, key=lambda x: (x[0], x[1]))
        return p.name, min(sure, 0.6), "address"

    def by_trigger(self, text: str) -> tuple[str, float, str] | None:
        """A title in the text; the last speaker's name near an action; a form of address after which one other recent speaker is left."""
        titled = next((p for t, p in self.titled.items() if p and t in text), None)
        if titled:
            return titled.name, 0.8, "title"
        if self.last is not None and self.last in self.by_name:
            at = text.find(self.last)
            if at >= 0 and any(a in text[max(0, at - NEAR) : at + len(self.last) + NEAR] for a in self.words.actions):
                return self.last, 0.65, "action"
        for a, ps in self.called.items():
            if a in text:
                for p in ps:
                    others = {n for n in self.recent[-3:] if n != p.name and n in self.by_name}
                    if len(others) == 1:
                        return others.pop(), 0.7, "address_turn"
        return None

    def candidates(self, text: str, before: str, hint: str | None, options: list[tuple[str, float]], mentioned: list[str]) -> list[tuple[str, float, str]]:
        """All candidates, one for each name, the surest first."""
        out: dict[str, tuple[str, float, str]] = {}
        add = lambda c: c is not None and out.setdefault(c[0], c)
        for n, sure in sorted(((n, self.faded(n, sure)) for n, sure in options), key=lambda o: -o[1]):
            add((n, sure, "option"))
        introduced = re.search(self.words.introductions, text)
        if introduced and introduced[1] in self.by_name:
            add((introduced[1], 0.9, "introduction"))
        if hint is not None and hint not in out:
            gender = self.words.pronouns.get(hint)
            add(self.by_pronoun(gender, before) if gender else (hint, 1.0, "hint") if hint in self.by_name else None)
        for n in mentioned:
            if len(n) >= 2:
                add((n, 0.75, "mention"))
        if text:
            add(self.by_address(text))
            add(self.by_trigger(text))
        return sorted(out.values(), key=lambda c: -c[1])

    def turn(self, text: str | None, before: str | None, hint: str | None, options: list[tuple[str, float]], mentioned: list[str]) -> tuple[str | None, float, str]:
        """The speaker of the next turn, the confidence and the signal; a candidate that the library doesn't know is nobody."""
        self.mention(mentioned)
        found = self.candidates(text or "", before or "", hint, options, mentioned)
        top = next((c for c in found if c[0] not in self.words.pronouns and c[0] not in self.words.unknown), None)
        p = top and (self.by_name.get(top[0]) or self.by_alias.get(top[0]))
        if not p:
            return None, 0.0, "none"
        self.spoke(p)
        return p.name, float(top[1]), top[2]


def resolve_turns(turns: DataFrame, people: DataFrame, keys: list[str], order: str, words: TurnWords, by: list[str] | None = None) -> DataFrame:
    """(keys, order, speaker, confidence, how) for turns (keys, order, text, before, hint, options, mentioned).

    people: (by, id, name, aliases, gender), where by are those of the keys that name a project (none: one library for all).  Ties go to
    the signal gathered first, then to the smaller id.  Null texts, hints and lists are empty; a chapter without people has no speakers; turns whose
    order is null come first.
    """
    by = by or []
    library = people.groupBy(*by).agg(F.sort_array(F.collect_list(F.struct("id", "name", "aliases", "gender"))).alias("_people"))
    groups = turns.select(*keys).distinct()
    heads = groups.join(library, by) if by else groups.crossJoin(F.broadcast(library))  # a library of one row
    rows = turns.select(*keys, order, "text", "before", "hint", "options", "mentioned").withColumn("_people", F.lit(None).cast(library.schema["_people"].dataType))
    rows = rows.unionByName(heads, allowMissingColumns=True)
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in turns.select(*keys, order).schema) + ", speaker string, confidence double, how string"

    def fold(pdf: pd.DataFrame) -> pd.DataFrame:
        is_head = pdf["_people"].notna()
        known = [Person(p["id"], p["name"], frozenset(() if p["aliases"] is None else p["aliases"]), p["gender"]) for ps in pdf.loc[is_head, "_people"] for p in ps]
        state = State(known, words)
        chapter = pdf[~is_head].sort_values(order, kind="stable", na_position="first")
        none = lambda x: () if x is None else x
        out = [state.turn(t, b, h, [(o["name"], o["confidence"]) for o in none(os)], list(none(ms))) for t, b, h, os, ms in zip(*(chapter[c] for c in ("text", "before", "hint", "options", "mentioned")), strict=True)]
        found = pd.DataFrame(out, columns=["speaker", "confidence", "how"], index=chapter.index)
        return pd.concat([chapter[[*keys, order]], found], axis=1)

    return rows.groupBy(*keys).applyInPandas(fold, schema)
