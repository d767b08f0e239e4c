"""Rule packs: all that depends on a language, held as data.

Operators take a pack.  Rules over tokens, turns and single sentences take word lists of their own (NameRules, TagRules, TurnWords, TaggerRules), whose
defaults, marked as fixed values, are those of the first language.
"""

from __future__ import annotations

from dataclasses import dataclass, field


@dataclass(frozen=True)
class Term:
    """One additive score term: a text matching `pattern` (and flags) adds `weight` to `emotion`."""

    emotion: str
    weight: float
    pattern: str = ""
    flags: tuple[str, ...] = ()  # names of features; "!name" is their absence; name>=k compares a count


@dataclass(frozen=True)
class EmotionRules:
    dirty: str
    adverb: str
    verb: str
    particle: str
    imperative: tuple[str, ...]
    rhetorical: tuple[str, ...]
    exclamatory: tuple[str, ...]
    negation: str
    terms: tuple[Term, ...]  # before negation
    denials: tuple[tuple[str, str], ...]  # emotion, pattern: its score falls to 0.3
    late: tuple[Term, ...]  # after negation, not halved
    full_stop: str
    guide: str  # guide phrase before the first quote
    guide_terms: tuple[tuple[str, str, float], ...]  # in order: pattern, emotion, weight; the first that fits counts
    fear_signals: str


@dataclass(frozen=True)
class Pack:
    name: str
    terminators: str
    quotes: tuple[tuple[str, str], ...]  # protect sentence ends
    dialogue_quotes: tuple[tuple[str, str], ...]
    chapter_patterns: tuple[str, ...]
    volume_patterns: tuple[str, ...]
    prologue: str
    whole: str
    chunk_title: tuple[str, str]
    speech_verbs: tuple[str, ...]
    hint_patterns: tuple[str, ...]
    name_pattern: str
    pronouns: tuple[str, ...]
    role_words: tuple[str, ...]
    boundary_suffixes: tuple[str, ...]
    dialogue_words: tuple[str, ...]
    name_suffixes: tuple[str, ...]
    book_words: tuple[str, ...]
    place_suffixes: tuple[str, ...]
    male_titles: tuple[str, ...]
    female_titles: tuple[str, ...]
    male_hints: tuple[str, ...]
    female_hints: tuple[str, ...]
    crowd_words: tuple[str, ...]
    sounds: tuple[tuple[str, tuple[str, ...]], ...]  # type, words; in order
    emotions: EmotionRules | None = None
    extra: dict = field(default_factory=dict)


# Patterns and word lists that must be these for right results.
_NUM = "一二三四五六七八九十百千万零"
_SPEECH = tuple("道 说 问 喊 叫 答 应 喝 嚷 骂 斥 吼 笑道 叹道 怒道 喝道 哼道 嚷道 骂道 泣道 冷冷道 淡淡道 沉声道 低声道 高声道 厉声道 轻声道 冷笑道 怪笑道 柔声道 安慰道 苦笑道 涩声道 颤声道 怒声道 说道 问道 答道 回答道 回应道 接道 续道 摇头道 点头道 叹息道 讽刺道 打趣道 赞叹道".split())
_NAME = r"[一-龥‧·]{1,20}"
_END = r"[：:，,。\s]"
_HINTS = (
    rf"({_NAME})\s*对[一-龥‧·]{{1,6}}\s*(?:道|说|问){_END}",
    rf"({_NAME})\s*(?:回答说|喃喃道|催促道|大叫道|大喊道|大声喊道|回答道|回应道|询问道|自言自语|低声道|高声道|沉声道|冷冷道|淡淡道|厉声道|轻声道|轻声说|轻声地说|急切地喊道|小心翼翼地说|小心翼翼道){_END}",
    rf"({_NAME})\s*(?:问道|答道|笑道|叹道|怒道|喝道|哼道|嚷道|骂道|说道|叫道){_END}",
    rf"({_NAME})\s*(?:道|说|问|叫|答|应|笑|叹){_END}",
)
_EMOTION_ZH = EmotionRules(
    dirty="滚|滚蛋|混蛋|王八蛋|废物|垃圾|傻逼|蠢货|该死|操|他妈|妈的|(?<![一-龥])草(?![一-龥])|卧槽|靠|(?<![一-龥])日(?![一-龥])|贱人|畜生|狗东西|杂种|蠢材|放肆|大胆|岂有此理|找死|活腻",
    adverb="极其|非常|特别|十分|格外|分外|狠狠|猛地|突然|猛然|骤然|顿时|不禁|不由|忍不住|情不自禁|愤怒地|激动地|颤抖地|嘶吼地|咆哮地|冷冷|淡淡|微微|轻轻|咬牙切齿|怒火中烧|气急败坏",
    verb="怒吼|咆哮|嘶吼|怒骂|痛哭|抽泣|哽咽|流泪|落泪|大笑|狂笑|冷笑|嘲笑|讥笑|颤抖|发抖|哆嗦|战栗|瞪眼|怒视|盯着|注视|抓紧|握紧|捏紧|拍打",
    particle="[啊呀哇呢吧哦唉哼呵哈]",
    imperative=("^(给我|马上|立刻|立即|赶紧|快点|快|去|来)", "(准备战斗|集合|防御|进攻|撤退|出手|停下|闭嘴|滚开|让开|冲锋|净化|杀|受死|去死|吃招)", "(不要|别|不准|禁止|严禁)"),
    rhetorical=("难道.*[？?]", "怎么.*[？?]", "岂.*[？?]", "谁.*[？?]", "难道不是", "怎么可能", "怎么会有", "[你他她我]又.*[？?]"),
    exclamatory=("^(太好了|太棒了|好极了|妙啊|完美|厉害)", "(哈哈|呵呵|嘻嘻)", "^[哇啊哦唉哼嘿][！!]{1,3}"),
    negation="(?:不|没|别|莫|勿|并非|从不|毫无|没有).{0,4}[生气愤怒害怕恐惧悲伤哭恨讨厌喜欢笑高兴开心激动紧张担心]",
    terms=(
        Term("anger", 0.5, flags=("dirty",)),
        Term("anger", 0.3, flags=("dense", "imperative")),
        Term("anger", 0.15, flags=("imperative", "exclaims>=1", "!no_anger")),
        Term("anger", 0.2, flags=("verb",)),
        Term("anger", 0.2, flags=("short", "exclaims>=2")),
        Term("anger", 0.4, "河东|河西|放肆|狂妄|大胆|岂敢"),
        Term("anger", 0.5, "死无葬身之地|自寻死路|找死|活腻|不得好死|碎尸万段|千刀万剐"),
        Term("anger", 0.4, "背叛|叛徒|逆贼|谋反|造反"),
        Term("anger", 0.4, "恨|仇恨|仇人|仇家|血债|血海深仇"),
        Term("fear", 0.4, "颤抖|发抖|哆嗦", ("verb",)),
        Term("fear", 0.2, flags=("ellipses>=2",)),
        Term("fear", 0.2, flags=("short", "questions>=1")),
        Term("fear", 0.3, "害怕|恐惧|别伤害"),
        Term("sadness", 0.3, "不要|别", ("doubt", "parting")),
        Term("fear", 0.3, "不要|别", ("doubt", "!parting")),
        Term("fear", 0.4, "不要过来|别过来"),
        Term("fear", 0.4, "恐怖"),
        Term("fear", 0.5, "饶命|求饶|饶了我|放过|不要杀|别杀|救命|求求"),
        Term("fear", 0.4, "危险|快跑|逃命|躲开|小心"),
        Term("sadness", 0.3, "^(?:唉|呜)"),
        Term("sadness", 0.2, flags=("ellipses>=1",)),
        Term("sadness", 0.2, "不禁|不由", ("adverb",)),
        Term("sadness", 0.2, "难过|离开|对不起"),
        Term("sadness", 0.5, "最后一面|见不到|回不去|再也见|永别|死别|生离"),
        Term("sadness", 0.4, "遗憾|后悔|来不及|没能|本该|早知道"),
        Term("sadness", 0.4, "哭|泪|泣"),
        Term("sadness", 0.5, "我的儿|我的孩|我的女|我的妻|我的夫|儿啊|孩儿|女儿啊"),
        Term("sadness", 0.3, "走吧|放手|成全|趁我|别管我"),
        Term("surprise", 0.3, flags=("rhetorical",)),
        Term("surprise", 0.2, flags=("questions>=2",)),
        Term("surprise", 0.4, "居然|竟然|天哪"),
        Term("surprise", 0.2, flags=("exclaims>=2", "!dirty")),
        Term("surprise", 0.1, "这.*[！!]", ("exclaims>=1",)),
        Term("surprise", 0.4, "太(可怕|厉害|惊人|恐怖|强大)了"),
        Term("surprise", 0.4, "还活着|没死|不敢相信"),
        Term("surprise", 0.3, "竟然|居然"),
        Term("surprise", 0.4, "难道|怎会|怎可能|怎么可能"),
        Term("surprise", 0.3, "真的[…?？]"),
        Term("joy", 0.4, flags=("exclamatory",)),
        Term("joy", 0.2, flags=("dense", "!dirty", "!imperative")),
        Term("joy", 0.3, "哈哈|呵呵|嘻嘻|大笑|微笑"),
        Term("joy", 0.1, flags=("repeats",)),
        Term("joy", 0.3, "完美|赢了|太好了|太棒了"),
        Term("joy", 0.4, "^哼.*(?:本事|就这|这点)|^哼(?:本事|就这|这点)"),
        Term("joy", 0.2, "笑", ("!cold_laugh",)),
        Term("joy", 0.5, "冠军|胜利|赢了|成功|终于|梦寐以求|喜事|好消息"),
        Term("joy", 0.4, "恭喜|祝贺|庆祝|万岁|干杯"),
        Term("joy", 0.4, "幸福|满足|开心|高兴|快乐|美好"),
    ),
    denials=(("anger", "不生气|不愤怒|不恨"), ("fear", "不害怕|不怕|不恐惧"), ("sadness", "不难过|不悲伤|不伤心"), ("joy", "不高兴|不开心|不快乐"), ("surprise", "不惊讶|不惊奇")),
    late=(
        Term("fear", 0.4, "恐慌|惊慌|惊恐|惊惶|慌张|慌乱"),
        Term("fear", 0.3, "心跳|心慌|心悸|呼吸困难|喘不过气|屏住呼吸"),
        Term("fear", 0.3, "冷汗|腿软|脚软|毛骨悚然|脊背发凉|后背发凉"),
        Term("fear", 0.3, "尖叫|惊呼|惨叫|失声"),
        Term("fear", 0.3, "鬼|幽灵|妖怪|魔物|邪灵|怨灵|黑影"),
        Term("fear", 0.5, "杀了你|弄死你|干掉|灭口|灭门|屠城"),
        Term("fear", 0.3, "绝望|无助|无路可退|走投无路|没有办法|束手无策"),
        Term("fear", 0.2, "后退|退后|躲避|闪避|蜷缩|缩在|藏在"),
    ),
    full_stop="。",
    guide="[一-龥]{0,5}?(?:道|说|问|喊|叫|骂|笑|叹|答|应|怒|喝|哼|嚷)[：:，。！!]?",
    guide_terms=(("冷笑", "anger", 0.5), ("苦笑", "sadness", 0.5), ("[怒骂吼]", "anger", 0.4), ("[哭叹泣]", "sadness", 0.4), ("笑.*[微轻]|[微轻].*笑", "neutral", 0.2), ("笑", "joy", 0.3), ("[喊叫嚷]", "surprise", 0.3), ("问", "surprise", 0.2)),
    fear_signals="快跑|逃|别过来|救命|危险|求饶|饶命|别杀|别伤害",
)
ZH = Pack(
    name="zh",
    terminators="。！？；",
    quotes=(('"', '"'), ("“", "”"), ("「", "」"), ("『", "』"), ("〈", "〉"), ("《", "》")),
    dialogue_quotes=(("「", "」"), ("『", "』"), ('"', '"'), ("'", "'")),
    chapter_patterns=(rf"^第[{_NUM}\d]+[章节回卷].*$", r"^[第][0-9]+[章节回卷].*$", r"(?i)^Chapter\s*\d+.*$", r"^[一二三四五六七八九十\d]+[、.．].*$", r"^\d+[.\s].*$", rf"^【第[{_NUM}\d]+[章节回卷]】.*$", rf"^#{{1,6}}\s*第[{_NUM}\d]+[章节回卷].*$"),
    volume_patterns=(rf"^卷[{_NUM}\d]+.*$", rf"^【卷[{_NUM}\d]+】.*$", r"(?i)^Volume\s*\d+.*$"),
    prologue="序卷",
    whole="全文",
    chunk_title=("第", "段（自动分割）"),
    speech_verbs=_SPEECH,
    hint_patterns=_HINTS,
    name_pattern=r"[一-龥]{2,4}",
    pronouns=tuple("他 她 它 他们 她们 我 你 我们 你们".split()),
    role_words=tuple(
        (
            "将军 丞相 元帅 统领 校尉 大臣 尚书 宰相 太傅 总管 掌门 舵主 堂主 族长 团长 队长 骑士 剑客 法师 护卫 士兵 斥候 杀手 刺客 "
            "盗贼 佣兵 猎人 冒险者 剑修 修士 管家 丫鬟 侍女 侍卫 铁匠 商人 牧师 主教 青年 少年 少女 老者 老人 男子 女子 男人 女人 "
            "道士 和尚 僧人 长老 弟子 前辈 药老 中年人 老妇 大汉 掌柜 店小二"
        ).split()
    ),
    boundary_suffixes=tuple("说道 问道 喊道 笑道 淡淡道 沉声道 冷声道 轻声道 低声道 道 来到 走出 看着 点了点头 摇头 皱眉 转身 站起 坐下 师兄 师姐 前辈 大人 长老 老师".split()),
    dialogue_words=tuple("道说问喊叫喝笑叹答应吼骂泣怒冷斥责嘲讽讥"),
    name_suffixes=tuple("尊 皇 帝 主 者 王 侯 公 伯 将 尊者 道人 圣人 之主 大帝 天尊 真人 先生 女士 公子 少爷 姑娘 小姐 前辈 后辈 长老 宗主 峰主 岛主".split()),
    book_words=tuple("写着 写道 记载 刻着 刻有 书上 碑文 信中 纸条 日记 笔记 名言 格言 警句 谚语 俗语 标题 扉页 序言 跋 题词 吟诵 念道 默念 背诵 朗读 古籍 古卷 玉简 典籍 经书 匾额 对联 牌匾 石碑 石刻".split()),
    place_suffixes=tuple("阁楼殿宫府院庄堡城关峰山谷崖洞渊潭湖海江宗门派帮教会盟寨村镇剑刀枪棍杖弓箭盾甲袍丹药符阵诀功法术技图卷册谱录鉴碑印镜珠"),
    male_titles=("先生", "公子", "少爷", "师兄", "师弟", "爷"),
    female_titles=("小姐", "姑娘", "夫人", "女士", "师姐", "师妹"),
    male_hints=("他", "男"),
    female_hints=("她", "女"),
    crowd_words=("众人", "人群", "大家", "所有人", "众弟子"),
    sounds=(("impact", ("砰", "轰", "轰隆", "轰隆隆", "咚", "咚咚", "啪", "啪啪")), ("metal", ("叮", "叮当", "铛", "锵", "咣当")), ("nature", ("哗", "哗啦", "哗啦啦", "呼", "呼呼", "沙沙", "滴答")), ("voice", ("哈哈", "呵呵", "嘻嘻", "呜呜", "嗷"))),
    emotions=_EMOTION_ZH,
)

# The pack for the generated tables: small and in ASCII.
_EMOTION_LATIN = EmotionRules(
    dirty="damn|cursed|fool",
    adverb="very|quite|suddenly",
    verb="shout|cry|laugh|tremble",
    particle="(?:ah|oh|hm)[.!?]?$",
    imperative=("(?i)^(go|come|stop|run)",),
    rhetorical=("(?i)how .*[?]", "(?i)why .*[?]"),
    exclamatory=("(?i)^(ha|wow|oh)",),
    negation="(?i)(?:not|never|no) .{0,4}(?:sad|glad|angry)",
    terms=(
        Term("anger", 0.5, flags=("dirty",)),
        Term("anger", 0.4, "erra|ander"),
        Term("fear", 0.4, "(?i)shre|thwh"),
        Term("fear", 0.2, flags=("short", "questions>=1")),
        Term("sadness", 0.4, "(?i)ou th|leaeed"),
        Term("sadness", 0.2, flags=("ellipses>=1",)),
        Term("surprise", 0.4, "(?iu)stion|heit"),
        Term("surprise", 0.2, flags=("exclaims>=2", "!dirty")),
        Term("joy", 0.3, "(?iu)ble|ción"),
        Term("joy", 0.2, flags=("dense", "!dirty")),
    ),
    denials=(("joy", "(?i)not .*ble"), ("anger", "(?i)no erra")),
    late=(Term("fear", 0.3, "(?i)ghost|tztz"),),
    full_stop=".",
    guide="[a-z]{2,10} (?:said|asked)",
    guide_terms=(("asked", "surprise", 0.2), ("said", "joy", 0.1)),
    fear_signals="(?i)run|help",
)
LATIN = Pack(
    name="latin",
    terminators=".!?;",
    quotes=(('"', '"'), ("“", "”")),
    dialogue_quotes=(('"', '"'), ("“", "”")),
    chapter_patterns=(r"(?i)^Chapter\s*\d+.*$", r"^[A-Z][a-z]+\.$"),
    volume_patterns=(r"(?i)^Volume\s*\d+.*$",),
    prologue="Prologue",
    whole="Whole text",
    chunk_title=("Part ", ""),
    speech_verbs=("said", "asked", "cried", "replied"),
    hint_patterns=(r"([A-Z][a-z]+) (?:said|asked|cried|replied)[,:.]",),
    name_pattern="[A-Z][a-zà-ÿ]+",
    pronouns=("he", "she", "they", "it", "I", "you", "we"),
    role_words=("man", "woman", "child"),
    boundary_suffixes=(" the", " and", " in", " of", " was"),
    dialogue_words=("said", "the", "in"),
    name_suffixes=("er", "tion", "n", "t"),
    book_words=("wrote", "written"),
    place_suffixes=("ton", "burg"),
    male_titles=("Mr",),
    female_titles=("Mrs", "Ms"),
    male_hints=(" he ",),
    female_hints=(" she ",),
    crowd_words=("everyone",),
    sounds=(("soft", ("th", "the", "sh")), ("hard", ("re", "rere", "er"))),
    emotions=_EMOTION_LATIN,
)
PACKS = {p.name: p for p in (ZH, LATIN)}
