"""Rules over tokens and texts that find or correct named entities.

Entities are rows (ids, text, type, confidence, start, end) with true character offsets.  Token rules work inside a
row on arrays of tokens; nothing is shuffled but the final combination.
"""

from __future__ import annotations

from collections.abc import Iterable
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomspark.functions.text import matches, one_of, quote_class, quote_pattern
from loomspark.operators.entities import near_spans

TYPES = {"NR": "PER", "PERSON": "PER", "NS": "LOC", "LOCATION": "LOC", "GPE": "LOC", "NT": "ORG", "ORGANIZATION": "ORG"}


@dataclass(frozen=True)
class NameRules:
    """Word lists of one language."""

    surnames: tuple[str, ...]
    prefixes: tuple[str, ...] = ("老", "小", "大")
    professions: tuple[str, ...] = ("医生", "老师", "警察", "司机", "律师")
    org_suffixes: tuple[str, ...] = ("公司", "集团", "学院", "大学", "门派")
    org_blacklist: tuple[str, ...] = ("这个", "那个", "一个")
    titles: tuple[str, ...] = ("先生", "小姐", "长老", "师兄", "师姐", "掌门")
    positions: tuple[str, ...] = ("经理", "主任", "局长", "校长")
    verbs: tuple[str, ...] = ("说", "道", "问", "是")
    place_prefixes: tuple[str, ...] = ("纽", "伦", "巴", "圣")
    place_suffixes: tuple[str, ...] = ("堡", "顿", "约", "敦", "黎")
    black: tuple[str, ...] = ()
    places: tuple[str, ...] = ()
    # Words that join or follow the parts of a foreign name.
    foreign_titles: tuple[str, ...] = tuple("骑士 法师 牧师 圣骑士 游侠 德鲁伊 术士 战士 盗贼 猎人 主教 团长 副团长 队长 副官 指挥官 国王 女王 王子 公主 公爵 伯爵 侯爵 陛下 阁下 大人 爵士 殿下 信使 哨兵 斥候 物资官 书记员".split())
    name_joints: tuple[str, ...] = ("·", "-", ".", "/")
    name_links: tuple[str, ...] = ("和", "与", "及")
    # What a name of surname and given name can't have, begin or be.
    letter: str = "[一-龥]"
    not_in_names: str = "的了着过在有是不没他她它这那哪其和与或但而因为从向对心神身手脚眼口头走跑飞跳站坐躺看听想说问答喊叫笑哭拿放抓握推拉打杀来去回进出上下前后见觉感望盯扫瞥做干搞弄变成让给依顺随凭任"
    not_given: str = "的了着过在有是不没他她"
    verb_endings: str = "回点沉迈走转站坐抬挥看听想感觉望盯扫接递拿放抓握推拉"
    no_persons: tuple[str, ...] = tuple("回头 点点头 心中 冷笑 微笑 迈步 转身 站起 坐下 抬手 挥手 风险 石林 火鸦 玉瓶 丹药 符箓 灵光 机缘 大道 长生 工匠 命运 明白 知道 好的 规矩 道理 我们 你们 他们 大家 所有 一个 两个 三个 这个 那个 冰冷 危险 火苔 那存 乌黑 索性 幽石 张遁 石阴 方向 同时 立刻 火鸦涧 幽石林 石林立 张遁地符 孙项明依 月笙如歌 仙传 简介".split())


def normal_type(kind: Column) -> Column:
    """One of PER, LOC and ORG for the names that taggers use; others stay."""
    return F.coalesce(*(F.when(F.upper(kind) == k, F.lit(v)) for k, v in TYPES.items()), kind)


def is_western(text: Column, tokens: Column, tags: Column, surnames: tuple[str, ...]) -> Column:
    """Whether names are written the western way: a dot between parts, or two name tokens in a row that start with no surname."""
    foreign = F.transform(F.arrays_zip(tokens.alias("t"), tags.alias("g")), lambda x: (x["g"] == "NR") & ~F.substring(x["t"], 1, 1).isin(*surnames))
    return F.contains(text, F.lit("·")) | F.exists(F.zip_with(foreign, F.slice(foreign, 2, F.greatest(F.size(foreign) - 1, F.lit(1))), lambda a, b: a & F.coalesce(b, F.lit(False))), lambda x: x)


def dotted_names(docs: DataFrame, id_cols: list[str], text_col: str = "text", titles: tuple[str, ...] = ("先生", "小姐", "爵士", "伯爵")) -> DataFrame:
    """Foreign names of dotted parts, with a title if one follows."""
    pattern = f"[一-龥]{{1,6}}(?:[·‧][一-龥]{{1,6}}?)+(?:{quote_pattern(titles)}|(?=[，。！？\\s]|$))"
    rows = docs.select(*id_cols, F.explode(matches(F.col(text_col), pattern)).alias("m"))
    return rows.select(*id_cols, F.col("m.text").alias("text"), F.lit("PER").alias("type"), F.lit(0.9).alias("confidence"), F.col("m.start").alias("start"), F.col("m.end").alias("end"))


def foreign_names(tokens: Column, tags: Column, rules: NameRules) -> Column:
    """Foreign names of several parts in an array of tokens with their tags: array of (text, start, end), token numbers, end exclusive.

    A state machine over the tokens, one step a token with one token of lookahead.  A token tagged NR that is no surname opens a name; more of
    them and titles add a part; a joint is kept if an NR follows it, a blank if one that is no surname does, and a link word is passed over then.
    Whatever else comes ends the name, which counts if it has two parts or a part holds a joint itself.
    """
    surnames, titles, joints, links = (frozenset(w) for w in (rules.surnames, rules.foreign_titles, rules.name_joints, rules.name_links))

    def one(ts: Iterable[str | None] | None, gs: Iterable[str | None] | None) -> list[dict]:
        if ts is None:
            return []
        ts = [t or "" for t in ts] + ["", ""]  # ends what is open
        gs = [] if gs is None else list(gs)
        names = [g in ("NR", "nr") for g in gs[: len(ts) - 2]] + [False] * (len(ts) - min(len(gs), len(ts) - 2))
        found, start, parts, text, joint = [], None, 0, "", False
        for i in range(len(ts) - 1):
            t, name, following = ts[i], names[i], names[i + 1]
            part, joined, passed = name and t not in surnames, False, False
            if not name:
                if t in joints:
                    joined = following
                elif t == " ":
                    joined = following and ts[i + 1] not in surnames
                    passed = t not in titles and t in links and joined
                elif t in titles:
                    part = True
                elif t in links:
                    passed = following and ts[i + 1] not in surnames
            if start is not None and (part or joined or passed):
                parts += part
                text += "" if passed else t
                joint = joint or part and any(c in t for c in ".·-")
                continue
            if start is not None and (parts > 1 or joint):
                found.append({"text": text, "start": start, "end": i})
            start = None
            if name and part:
                start, parts, text, joint = i, 1, t, any(c in t for c in ".·-")
        return found

    @F.pandas_udf("array<struct<text:string,start:int,end:int>>")
    def of_rows(tokens: pd.Series, tags: pd.Series) -> pd.Series:
        return pd.Series([one(ts, gs) for ts, gs in zip(tokens, tags, strict=True)], dtype=object)

    return of_rows(tokens, tags)


def surname_mentions(docs: DataFrame, id_cols: list[str], rules: NameRules, text_col: str = "text") -> DataFrame:
    """Names that begin with a surname (ids, name, start): up to three letters after one of one letter, two after a longer one, as long as they are letters of names.

    A name ends before the first letter that names don't have.  It has two to four letters then, is no listed word, has no particle
    behind its first letter, and a name of two letters doesn't end in a verb's.  Names from surnames of one letter are found left to
    right without overlap, as are those from each longer surname.
    """
    short, longer = [x for x in rules.surnames if len(x) == 1], sorted({x for x in rules.surnames if len(x) > 1})
    patterns = ([f"[{quote_class(''.join(sorted(short)))}]{rules.letter}{{1,3}}"] if short else []) + [f"{quote_pattern((x,))}{rules.letter}{{1,2}}" for x in longer]
    found = F.concat(*(matches(F.col(text_col), p) for p in patterns)) if patterns else F.array().cast("array<struct<start:int,end:int,text:string>>")
    rows = docs.select(*id_cols, F.explode(found).alias("m")).select(*id_cols, F.regexp_extract("m.text", f"^(?s:.)[^{quote_class(rules.not_in_names)}]*", 0).alias("name"), F.col("m.start").alias("start"))
    fits = F.length("name").between(2, 4) & ~one_of(F.col("name"), rules.no_persons) & ~F.expr("substring(name, 2)").rlike(f"[{quote_class(rules.not_given)}]")
    verb = (F.length("name") == 2) & F.expr("substring(name, 2, 1)").rlike(f"[{quote_class(rules.verb_endings)}]")
    anchored = one_of(F.substring("name", 1, 2), longer) | one_of(F.substring("name", 1, 1), short)
    return rows.where(fits & ~verb & anchored).distinct()


def surname_roles(docs: DataFrame, quotes: DataFrame, id_cols: list[str], rules: NameRules, reach: int = 200, least: int = 2) -> DataFrame:
    """Names from surnames that start within `reach` of a quote at `least` places or more: (ids, name, n_positions, first_position, positions).

    Quotes and names meet by stretches of the text, so a long text is many small groups.
    """
    near = near_spans(surname_mentions(docs, id_cols, rules).withColumn("end", F.col("start")), quotes, id_cols, reach, reach)
    grouped = near.groupBy(*id_cols, "name").agg(F.sort_array(F.collect_set("start")).alias("positions"))
    return grouped.where(F.size("positions") >= least).select(*id_cols, "name", F.size("positions").alias("n_positions"), F.col("positions")[0].alias("first_position"), "positions")


def token_entities(tokens: Column, rules: NameRules) -> Column:
    """Entities of a token array: titled names, professions, organisations (array of text, type, confidence)."""
    entity = lambda t, kind, sure: F.struct(t.alias("text"), F.lit(kind).alias("type"), F.lit(sure).alias("confidence"))
    after = F.transform(tokens, lambda _, i: F.coalesce(F.try_element_at(tokens, i + 2), F.lit("")))
    later = F.transform(tokens, lambda _, i: F.coalesce(F.try_element_at(tokens, i + 3), F.lit("")))
    trios = F.arrays_zip(tokens.alias("a"), after.alias("b"), later.alias("c"))
    lone = entity(F.lit(None).cast("string"), "", 0.0)

    def rule(x: Column) -> Column:
        pair = F.concat(x["a"], x["b"])
        free = ~x["c"].isin(*rules.verbs)
        org = x["b"].rlike(f"(?:{quote_pattern(rules.org_suffixes)})$") & ~x["a"].isin(*rules.org_blacklist)
        return (
            F.when(x["a"].isin(*rules.surnames) & x["b"].isin(*rules.titles), entity(pair, "PER", 0.95))
            .when(x["a"].isin(*rules.surnames) & x["b"].isin(*rules.positions) & free, entity(pair, "PER", 0.9))
            .when(x["a"].isin(*rules.prefixes) & x["b"].isin(*rules.surnames), entity(pair, "PER", 0.9))
            .when(org, entity(pair, "ORG", 0.85))
            .when(x["a"].isin(*rules.professions), entity(x["a"], "PER", 0.85))
            .otherwise(lone)
        )

    return F.filter(F.transform(trios, rule), lambda e: e["text"].isNotNull())


def western_places(text: Column, rules: NameRules) -> Column:
    """Place names of three characters or more built from a known beginning and end."""
    return F.array_distinct(F.regexp_extract_all(text, F.lit(f"(?:{quote_pattern(rules.place_prefixes)})[一-龥]{{1,3}}(?:{quote_pattern(rules.place_suffixes)})"), F.lit(0)))


def combine(model: DataFrame, ruled: DataFrame, id_cols: list[str]) -> DataFrame:
    """Rule entities, and the model entities that overlap none of them; of equal texts the surest stays."""
    cols = [*id_cols, "text", "type", "confidence", "start", "end"]
    r = ruled.select(*id_cols, F.col("start").alias("_s"), F.col("end").alias("_e"))
    cond = (F.col("start") < F.col("_e")) & (F.col("_s") < F.col("end"))
    for k in id_cols:
        cond = cond & (model[k] == r[k])
    every = ruled.select(cols).unionByName(model.join(r, cond, "left_anti").select(cols))
    best = every.groupBy(*id_cols, "text").agg(F.max_by(F.struct("type", "confidence", "start", "end"), F.struct("confidence", -F.col("start"))).alias("b"))
    return best.select(*id_cols, "text", "b.*")


def screened(entities: DataFrame, rules: NameRules) -> DataFrame:
    """Without blacklisted texts; known places become locations at 0.8 or more."""
    out = entities.where(~F.col("text").isin(*rules.black)) if rules.black else entities
    if not rules.places:
        return out
    place = F.col("text").isin(*rules.places)
    return out.withColumn("confidence", F.when(place, F.greatest("confidence", F.lit(0.8))).otherwise(F.col("confidence"))).withColumn("type", F.when(place, "LOC").otherwise(F.col("type")))


def expanded(name: Column, text: Column) -> Column:
    """A one-character name with the character after its first occurrence, if that is of its script."""
    nxt = F.substring(text, F.position(name, text) + 1, F.lit(1))
    return F.when((F.length(name) == 1) & nxt.rlike("^[一-龥]$"), F.concat(name, nxt)).otherwise(name)


def trimmed_to_library(entities: DataFrame, names: DataFrame, by: list[str]) -> DataFrame:
    """Entities whose first two, else three, characters are a library name become that name."""
    two, three = (names.select(*by, F.col("name").alias(f"_{n}")).where(F.length("name") == n).distinct().withColumn(f"_k{n}", F.col(f"_{n}")) for n in (2, 3))
    out = entities.withColumn("_k2", F.substring("text", 1, 2)).withColumn("_k3", F.substring("text", 1, 3)).join(two, [*by, "_k2"], "left").join(three, [*by, "_k3"], "left")
    return out.withColumn("text", F.when(F.length("text") > 2, F.coalesce("_2", "_3", "text")).otherwise(F.col("text"))).select(entities.columns)
