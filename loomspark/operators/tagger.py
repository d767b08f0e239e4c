"""The rule tagger of single sentences: keywords, sentence patterns, laughter, negation within seven places, degree.

Everything is a column of the sentence, and a plan doesn't grow with its words: tag() goes by Arrow batches, and for labels() a list of
words is one literal that is split once.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from loomspark.functions.text import let

NEUTRAL = "neutral"
LEVELS = ("neutral", "mild", "moderate", "strong")
TAG = "emotion string, confidence double, intensity string, downgraded boolean"


@dataclass(frozen=True)
class TaggerRules:
    """Words and patterns of one language.  Fixed values: those of the first one."""

    keywords: tuple[tuple[str, tuple[str, ...]], ...] = (
        ("joy", tuple("笑 开心 高兴 喜悦 欢快 欢喜 愉快 哈哈 呵呵 嘻嘻 大笑 微笑 欢笑 太好了 太棒了 好极了 戏谑 急切 笑容 干笑".split())),
        ("anger", tuple("怒 愤怒 生气 大怒 发火 咆哮 怒吼 可恶 混蛋 放肆 岂有此理 气死 没好气 怒火 教训 阴沉 羞怒 挑衅 倔强 决绝 不服 懊恼".split())),
        ("sadness", tuple("哭 悲伤 难过 伤心 流泪 泪水 痛哭 唉 呜 呜呜 惨 可怜 心疼 叹息 无奈 苦涩 呐呐 呐 惋惜 轻轻 颤抖 怯懦 歉然 落寞".split())),
        ("surprise", tuple("惊讶 震惊 吃惊 意外 竟然 居然 什么 不会吧 怎么可能 天哪 哇 简直 不敢相信 惊 好奇 惊叹 一惊".split())),
        ("fear", tuple("害怕 恐惧 惊吓 惊恐 吓 慌 紧张 危险 糟糕 不妙 恐怖 可怕 急声 急 退一步 不安 吓了".split())),
    )
    patterns: tuple[tuple[str, str, float], ...] = (
        ("surprise", "难道.*[？?]", 0.7), ("surprise", "怎么(?:可能|会).*[！!]", 0.8), ("surprise", "(?:竟然|居然|出乎意料).*[？?!]", 0.7),
        ("anger", "凭什么.*[！!]", 0.9), ("anger", "滚.*[！!]", 0.9), ("anger", "闭嘴.*[！!]", 0.9),
        ("sadness", "……$", 0.5), ("sadness", "唉.*[！!]", 0.7), ("joy", "太好了.*[！!]", 0.8), ("fear", "太可怕了.*[！!]", 0.8), ("fear", "快.*逃.*[！!]", 0.8),
    )
    laughter: tuple[tuple[str, str], ...] = (("冷笑", "anger"), ("苦笑", "sadness"))
    negations: tuple[str, ...] = tuple("不 没 未 别 并非 并不 未曾 未能 从不 从未 无 非 莫 毋 勿".split())
    mild: tuple[str, ...] = tuple("有点 略微 微微 稍稍 稍微 略有 稍显".split())
    strong: tuple[str, ...] = tuple("非常 极其 极度 十分 格外 分外 异常 太 极为 无比".split())
    marks: str = "[\"“”]"
    guide: str = "([一-龥]{0,5}?(?:道|说|问|喊|叫|骂|笑|叹|答|应|怒|喝|哼|嚷)[：:，。！!]?)"
    guide_reach: int = 10
    scope: int = 7


def _words(words: tuple[str, ...]) -> Column:
    return F.split(F.lit("\x1f".join(words)), "\x1f") if words else F.array().cast("array<string>")


def _held(text: Column, words: tuple[str, ...]) -> Column:
    return F.filter(_words(words), lambda w: F.contains(text, w))


def keyword_counts(text: Column, rules: TaggerRules) -> list[tuple[str, Column]]:
    """How many of each emotion's keywords a text holds."""
    return [(e, F.size(_held(text, ws))) for e, ws in rules.keywords]


def tag(text: Column, rules: TaggerRules) -> Column:
    """(emotion, confidence, intensity, downgraded): keywords of the guide phrase or of the text before sentence patterns, agreement adds up.

    A null or empty text is neutral at 1.0.  Ties go to the emotion listed first.  A row's steps run in Python over Arrow batches: as
    array functions of a column they were interpreted word by word.
    """
    emotions = [e for e, _ in rules.keywords]
    keywords = dict(rules.keywords)

    def best(counts: list[float], names: list[str]) -> tuple[str, float]:
        most = max(counts, default=0)
        return (names[counts.index(most)], most) if most > 0 else (NEUTRAL, 0)

    def held(t: str) -> tuple[str, float]:
        return best([sum(w in t for w in ws) for _, ws in rules.keywords], emotions)

    @F.pandas_udf(TAG)
    def of_texts(texts: pd.Series) -> pd.DataFrame:
        marks, guide, patterns = re.compile(rules.marks), re.compile(rules.guide), [(re.compile(p), s) for _, p, s in rules.patterns]
        kinds = [e for e, _, _ in rules.patterns]

        def one(t: str | None) -> tuple[str, float, str, bool]:
            if not t:
                return NEUTRAL, 1.0, "moderate", False
            laugh = next((e for w, e in rules.laughter if w in t), None)
            if laugh is None:
                key, n = held(t)
                if (mark := marks.search(t)) and (phrase := guide.search(t[max(0, mark.start() - rules.guide_reach) : mark.start()])):
                    guided = held(phrase[1] or "")
                    key, n = (key, n) if n > guided[1] else guided
            else:
                key, n = laugh, 1
            kind, points = best([s if p.search(t) else 0.0 for p, s in patterns], kinds)
            if n > 0:
                emotion, score = key, n * 0.3 + (points * 0.5 if points > 0 and kind == key else 0.0)
            else:
                emotion, score = kind, points
            down = False
            if emotion != NEUTRAL:
                windows = [t[at : at + rules.scope] for at in (t.find(w) for w in rules.negations) if at >= 0]
                down = any(k in w for w in windows for k in keywords.get(emotion, ()))
            level = 1 if any(w in t for w in rules.mild) else 3 if any(w in t for w in rules.strong) else 2
            return emotion, min(score / 3.0, 1.0), LEVELS[level - down], down

        return pd.DataFrame([one(t) for t in texts], columns=["emotion", "confidence", "intensity", "downgraded"])

    return of_texts(text)


def labels(text: Column, rules: TaggerRules) -> Column:
    """All emotions with keywords in the text, each with 0.2 a keyword up to 1.0; neutral at 1.0 if there is none (array of emotion, score)."""
    one = lambda e, n: F.when(n > 0, F.struct(F.lit(e).alias("emotion"), F.least(n * 0.2, F.lit(1.0)).alias("score")))
    found = F.array_compact(F.array(*(one(e, n) for e, n in keyword_counts(F.coalesce(text, F.lit("")), rules))))
    return let(found, lambda x: F.when(F.size(x) > 0, x).otherwise(F.array(F.struct(F.lit(NEUTRAL).alias("emotion"), F.lit(1.0).alias("score")))))
