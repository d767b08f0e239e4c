"""Entities of a tagged sentence: what a tagger found, completed and corrected by rules over its tokens.

All work is inside a row, on the arrays of one sentence: nothing is shuffled.  Entities are structs of text, type, confidence and token
numbers (end exclusive).  Tokens, tags and a tagger's own entities are inputs; a sentence without them has only what the rules find.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomspark.functions.text import let, matches, one_of, quote_class, quote_pattern, running, scan
from loomspark.operators.name_rules import NameRules, foreign_names

KIND = "struct<text:string,type:string,confidence:double,start:int,end:int>"


@dataclass(frozen=True)
class TagRules:
    """Word lists of the rules over tokens; names holds surnames and what joins foreign names."""

    names: NameRules
    foreign: bool = True  # whether names of several foreign parts are merged
    # Forms of address, organisations, places, and what taggers take for names.
    prefixes: tuple[str, ...] = ("老", "小", "大")
    professions: tuple[str, ...] = tuple("博士 教授 医生 护士 律师 记者 经理 总裁 总监 部长 局长 队长".split())
    titles: tuple[str, ...] = tuple("管家 老爷 夫人 少爷 小姐 公子 姑娘 掌柜 老板 掌门 长老 堂主 舵主 将军 大人 王爷 皇上 皇后 贵妃 师父 师叔 师兄 师弟 师姐 师妹 博士 教授 医生 护士 律师 记者 经理 总裁 总监 部长 局长 队长 导师 学长 执事".split())
    positions: tuple[str, ...] = tuple("总 哥 姐 叔 伯 姨 婶 爷 公 婆".split())
    org_suffixes: tuple[str, ...] = tuple("会 帮 社 团 协会 联盟 组织 集团 公司 企业 商会 公会 教派 宗门".split())
    org_least: int = 2  # letters before the suffix
    no_org_prefixes: tuple[str, ...] = tuple("我们 你们 他们 大家 所有 炎魔 恶魔 怪物 敌人 人类 精灵 矮人 魔法 黑暗 光明 圣光 火焰 冰霜 立即 马上 立刻 准备 开始 继续 一个 这个 那个 这些 那些 黑暗法师 光明法师 黑袍人 白袍人".split())
    no_orgs: tuple[str, ...] = tuple("我们会 你们会 他们会 大家会 炎魔会 恶魔会 立即组织 马上组织 黑暗法师 光明法师".split())
    no_persons: tuple[str, ...] = tuple("众人 人们 大家 百姓 民众 骑士们 士兵们 工匠们 魔法师 骑士团 军队 炎魔 恶魔 怪物 魔王 巨龙 魔兽 黑袍人 白袍人 陌生人 路人 黑暗 光明 圣光 希望 正义 剑 盾 法杖 武器 药水".split())
    cities: tuple[str, ...] = tuple("王都 都城 首都 皇城 京城 城池".split())
    place_prefixes: tuple[str, ...] = tuple("灰石 白银 黄金 黑铁 暗影 风暴 冰霜 火焰 雷霆 月光 日光 星辰 翡翠 水晶 血色 铁壁 龙骨 鹰巢 灰 银 金 黑 红 蓝 绿 白 铁 钢 铜 石 岩 木".split())
    place_suffixes: tuple[str, ...] = tuple("城 镇 村 山 河 湖 海 岛 谷 峰 岭 原 川 泽 林 森 漠 殿 宫 哨站 要塞 堡垒 营地 关 隘 渡 津 桥 崖 渊 潭 泉 溪 涧 洞 窟 峡 坪".split())
    org_marks: str = "族宗门派帮教会阁殿府宫堡寨岛城国界域"
    no_names: tuple[str, ...] = tuple("天道 大道 世界 空间 时间 天地 万物 虚空 宇宙 星辰 天命 命运 轮回 因果 境界 修炼 灵力 灵气 真气 斗气 魂力 元力 法力 神识 意识 灵魂 魂魄 肉身 血脉 功法 武技 剑意 剑道 阵法 丹药 灵药 法宝 神器 兵器 飞舟 马车 山洞 树林 草原 沙漠 河流 瀑布".split())
    links: str = "之的与和而但"
    longest: int = 7
    heading: str = r"^(?:第[一二三四五六七八九十百千万零\d]+[章节回卷]|卷[一二三四五六七八九十百千万零\d]+|第[一二三四五六七八九十\d]+|\d+[章节回卷])"
    western_mark: str = "·"


NAME_TAGS, PLACE_TAGS = ("NR", "nr"), ("NS", "LOC", "GPE")
VERB_TAGS = tuple("V VE VC VV VW VD VL VH VO VP VB".split())


def entity(text: Column, kind: str | Column, sure: float | Column, start: Column, end: Column) -> Column:
    lit = lambda x: x if isinstance(x, Column) else F.lit(x)
    return F.struct(text.alias("text"), lit(kind).alias("type"), lit(sure).cast("double").alias("confidence"), start.cast("int").alias("start"), end.cast("int").alias("end"))


def _none() -> Column:
    return F.array().cast(f"array<{KIND}>")


def _apart(new: Column, known: Column, lead: int = 0) -> Column:
    """Those of the new entities of which no token, but for the first `lead`, is in a known one."""
    return F.filter(new, lambda x: ~F.exists(known, lambda k: (k["start"] < x["end"]) & (x["start"] + lead < k["end"])))


def _in_turn(found: Column) -> Column:
    """Left to right, each entity that begins behind the one kept before."""
    def step(end: Column, x: Column) -> tuple[Column, Column]:
        free = x["start"] >= end
        return F.when(free, x["end"]).otherwise(end), F.when(free, F.array(x)).otherwise(_none())

    return scan(found, F.lit(0), step, KIND)


def _first_of_text(found: Column) -> Column:
    """Of entities with one text the first."""
    texts = F.transform(found, lambda e: e["text"])
    return F.filter(found, lambda e, i: F.array_position(texts, e["text"]) == i + 1)


def with_base(ruled: Column, base: Column, rules: TagRules) -> Column:
    """The rules' entities, then the tagger's that touch none of them, of new texts; headings left out."""
    texts = F.transform(ruled, lambda e: e["text"])
    more = F.filter(_first_of_text(_apart(base, ruled)), lambda e: ~F.array_contains(texts, e["text"]))
    return F.filter(F.concat(ruled, more), lambda e: ~e["text"].rlike(rules.heading))


def western(tokens: Column, tags: Column, text: Column, rules: TagRules) -> Column:
    """Whether names are written the western way: the mark between parts, or two names in a row that are no surnames."""
    foreign = F.zip_with(tokens, tags, lambda t, g: F.coalesce(one_of(g, NAME_TAGS) & ~one_of(t, rules.names.surnames), F.lit(False)))
    twice = F.exists(F.transform(foreign, lambda x, i: x & F.coalesce(F.try_element_at(foreign, i + 2), F.lit(False))), lambda x: x)
    return F.contains(F.coalesce(text, F.lit("")), F.lit(rules.western_mark)) | twice


def _pairs(tokens: Column, tags: Column, rule: Callable[[Column, Column, Column], Column]) -> Column:
    """The entities that rule(token and tag, the next token and tag, number) gives, where it isn't null."""
    blank = F.lit("")
    at = lambda i: F.struct(F.coalesce(F.try_element_at(tokens, i), blank).alias("t"), F.coalesce(F.try_element_at(tags, i), blank).alias("g"))
    rows = F.transform(tokens, lambda _, i: F.struct(at(i + 1).alias("a"), at(i + 2).alias("b"), i.alias("i")))
    return F.filter(F.transform(rows, lambda x: rule(x["a"], x["b"], x["i"])), lambda e: e.isNotNull())


def rule_entities(tokens: Column, tags: Column, rules: TagRules) -> Column:
    """Foreign names, forms of address, professions, organisations and surnames with titles; each rule leaves the tokens of those before alone."""
    single = [s for s in rules.names.surnames if len(s) == 1] or ["\x00"]
    foreign = F.transform(foreign_names(tokens, tags, rules.names), lambda e: entity(e["text"], "PER", 1.0, e["start"], e["end"])) if rules.foreign else _none()
    both = lambda a, b: F.concat(a["t"], b["t"])
    address = _pairs(tokens, tags, lambda a, b, i: F.when(one_of(a["t"], rules.prefixes) & one_of(b["t"], single) & one_of(b["g"], NAME_TAGS), entity(both(a, b), "PER", 0.9, i, i + 2)))
    job = _pairs(tokens, tags, lambda a, b, i: F.when(one_of(a["t"], rules.professions), entity(a["t"], "PER", 0.85, i, i + 1)))
    org = _pairs(tokens, tags, lambda a, b, i: F.when(one_of(b["t"], rules.org_suffixes) & (F.length(a["t"]) >= rules.org_least) & ~one_of(a["t"], rules.no_org_prefixes), entity(both(a, b), "ORG", 0.85, i, i + 2)))
    sure = lambda b: F.when(one_of(b["t"], rules.titles), 0.95).when(one_of(b["t"], rules.positions), 0.9)
    titled = _pairs(tokens, tags, lambda a, b, i: F.when(one_of(a["g"], NAME_TAGS) & one_of(a["t"], single) & ~one_of(F.upper(b["g"]), VERB_TAGS) & sure(b).isNotNull(), entity(both(a, b), "PER", sure(b), i, i + 2)))

    def add(known: Column, new: Column, lead: int = 0) -> Column:
        return let(known, lambda k: F.concat(k, _in_turn(_apart(new, k, lead))))

    out = foreign
    for new, lead in ((address, 0), (job, 0), (org, 0), (titled, 1)):
        out = add(out, new, lead)
    return out


def screened(found: Column, rules: TagRules) -> Column:
    """Without listed words; cities that were taken for persons are places, at 0.8 or more."""
    def one(e: Column) -> Column:
        city = (e["type"] == "PER") & one_of(e["text"], rules.cities)
        gone = ((e["type"] == "PER") & one_of(e["text"], rules.no_persons)) | ((e["type"] == "ORG") & one_of(e["text"], (*rules.no_orgs, *rules.no_org_prefixes)))
        return F.when(city, entity(e["text"], "LOC", F.greatest(e["confidence"], F.lit(0.8)), e["start"], e["end"])).when(~gone, e)

    return F.filter(F.transform(found, one), lambda e: e.isNotNull())


def no_false_persons(found: Column, rules: TagRules) -> Column:
    """A lone letter that is no surname counts 0.3; persons with an organisation's mark are organisations; listed words, numbers, short ASCII and long phrases go."""
    def one(e: Column) -> Column:
        t, size = e["text"], F.length(e["text"])
        lone = F.when(one_of(t, rules.names.surnames), e).otherwise(entity(t, e["type"], 0.3, e["start"], e["end"]))
        org = (e["type"] == "PER") & t.rlike(f"[{quote_class(rules.org_marks)}]")
        gone = one_of(t, rules.no_names) | ((size > rules.longest) & t.rlike(f"[{quote_class(rules.links)}]")) | t.rlike("^[0-9]+$") | t.rlike("^[A-Za-z]{1,2}$")
        return F.when(size == 1, lone).when((size > 1) & org, entity(t, "ORG", e["confidence"], e["start"], e["end"])).when((size > 1) & ~gone, e)

    return F.filter(F.transform(found, one), lambda e: e.isNotNull())


def lone_surnames_expanded(found: Column, text: Column, rules: TagRules) -> Column:
    """A person of one letter, a surname, takes the letter after its first place in the text if that is of names, at 0.85."""
    def one(e: Column) -> Column:
        after = F.substring(text, F.position(e["text"], text) + 1, F.lit(1))
        grows = (F.length(e["text"]) == 1) & (e["type"] == "PER") & one_of(e["text"], rules.names.surnames) & (F.position(e["text"], text) > 0) & after.rlike(f"^{rules.names.letter}$")
        return F.when(grows, entity(F.concat(e["text"], after), "PER", 0.85, e["start"], e["end"])).otherwise(e)

    return F.transform(found, one)


def places(tokens: Column, tags: Column, rules: TagRules) -> Column:
    """Tokens tagged as places (0.9), then places of three letters or more that a prefix and a suffix make, across tokens too (0.85)."""
    tagged = _pairs(tokens, tags, lambda a, b, i: F.when(one_of(a["g"], PLACE_TAGS), entity(a["t"], "LOC", 0.9, i, i + 1)))
    ends = running(F.transform(tokens, lambda t: F.length(t)))
    found = matches(F.array_join(tokens, ""), f"(?:{quote_pattern(rules.place_prefixes)})(?:{quote_pattern(rules.place_suffixes)})")

    def placed(x: Column) -> Column:
        made = F.transform(F.filter(x["found"], lambda m: m["end"] - m["start"] >= 3), lambda m: entity(m["text"], "LOC", 0.85, F.size(F.filter(x["ends"], lambda e: e <= m["start"])), F.size(F.filter(x["ends"], lambda e: e < m["end"])) + 1))
        return F.concat(x["tagged"], _in_turn(_apart(made, x["tagged"])))

    return let(F.struct(tagged.alias("tagged"), ends.alias("ends"), found.alias("found")), placed)


def enhanced(tokens: Column, tags: Column, base: Column, text: Column, rules: TagRules) -> Column:
    """All entities of a sentence from its tokens, their tags, the tagger's entities and its text.

    A sentence of western names keeps the tagger's entities, screened, and adds places; any other goes through all the rules.  No tokens: no entities.
    """
    base = F.coalesce(base, _none())
    ruled = let(rule_entities(tokens, tags, rules), lambda r: lone_surnames_expanded(no_false_persons(screened(with_base(r, base, rules), rules), rules), F.coalesce(text, F.lit("")), rules))
    own = F.when(western(tokens, tags, text, rules), screened(base, rules)).otherwise(ruled)
    out = let(F.struct(own.alias("own"), places(tokens, tags, rules).alias("places"), western(tokens, tags, text, rules).alias("western")), lambda x: F.when((F.size(x["places"]) == 0) & ~x["western"], x["own"]).otherwise(_followed(x["places"], x["own"], rules)))
    return F.when(tokens.isNull() | tags.isNull(), _none()).otherwise(out)


def _followed(first: Column, more: Column, rules: TagRules) -> Column:
    """The first entities, then the others, one of each text, whatever tokens they share with the first; headings left out."""
    return F.filter(F.concat(first, _first_of_text(more)), lambda e: ~e["text"].rlike(rules.heading))


def tagged_names(sentences: DataFrame, id_cols: list[str], rules: TagRules, text_col: str = "text") -> DataFrame:
    """(ids, name, type, confidence) of the entities of tagged sentences (ids, text, tokens, tags, and base where a tagger gives entities)."""
    base = F.col("base") if "base" in sentences.columns else F.lit(None).cast(f"array<{KIND}>")
    rows = sentences.select(*id_cols, F.explode(enhanced(F.col("tokens"), F.col("tags"), base, F.col(text_col), rules)).alias("e"))
    return rows.select(*id_cols, F.col("e.text").alias("name"), "e.type", "e.confidence")
