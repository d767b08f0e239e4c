"""HTML extraction: the maximum-scoring run of a page's words and tags.

A page is a sequence of words, which score positive, and tags, which score negative; one linear scan (Kadane) finds the contiguous region with the
largest sum, and that region's blocks are the text.  An element that is boilerplate by its name, class or role (menus, headers, footers, sidebars, notices,
adverts, forms, reader comments, scripts, styles) is one tag with a weight of its own: none of its words is scored or written, and a region
goes on behind it if what follows is worth more.  So a notice in mid-article leaves a text on both sides of it whole.

Weights are learned from labelled pages: those with one <article> or <main> say by it which words and tags are text.  An averaged structured perceptron
compares the region found with the labelled one and moves the weights of what only one of them has; words stay above LEAST, tags below -LEAST.
It takes at most `sample` such pages of at most MOST_TOKENS words and tags, the first by hash of about SPARE * sample pages; of each the counts between places
where a region can begin or end go to the driver.  Extraction itself reads every page whole.

A page's work is in its own row, linear in its length: no shuffle.

Cases: a null or empty page, and one without words outside boilerplate, has an empty text; repeated pages and null ids pass through;
of regions that tie the first, and of those the shortest is taken; what is left open at the end of a page (a comment, a script, a style) reaches to its end,
an element that is never closed ends with its tag, but a footer and what began last in the page's end; a `<` that opens no tag is text; pages of any length are read whole; without labelled
pages the weights are START's; an empty table gives an empty result; columns beyond id, url and html are ignored.
"""

from __future__ import annotations

import html as html_lib
import re
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomspark.llm.text import bounded, slices, tidy

SAMPLE, MOST_TOKENS, ROUNDS, SPARE = 400, 20_000, 4, 8
LEAST = 0.05
#: Weights before learning: a word, a word of a link, a tag, a tag of running text, an element cut out, the bounds of an article.
START = {"word": 1.0, "link word": 0.3, "tag": -1.0, "text tag": -0.2, "cut": -0.5, "bound": -40.0}

# Elements by what HTML says of them, and names that pages give to what is no article.
BLOCKS = frozenset("address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form frameset h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav ol optgroup option p pre section summary table tbody td tfoot th thead title tr ul".split())
INLINE = frozenset("a abbr b bdi bdo big br cite code data dfn em font i img ins kbd mark q rp rt ruby s samp small span strike strong sub sup time tt u var wbr".split())
TEXT_TAGS = INLINE | frozenset("p h1 h2 h3 h4 h5 h6 blockquote pre figure figcaption".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title xmp iframe noembed noframes noscript template svg math object canvas audio video select".split())
NOT_TEXT = frozenset("nav header footer aside form button fieldset dialog menu head label input datalist map".split()) | RAW
ROLES = frozenset("navigation banner contentinfo complementary search form alert alertdialog dialog menu menubar toolbar".split())
NAMES = frozenset("ad ads adv advert adverts advertisement advertisements adsense adslot banner breadcrumb breadcrumbs byline-share comment comments commentlist consent cookie cookies copyright discussion disqus footer gdpr header masthead menu modal nav navbar navigation newsletter notice notices pager pagination paywall popup promo promotion promoted recommended related replies respond search share sharing sidebar signup skip social sponsor sponsored subscribe subscription teaser toolbar topbar trending widget widgets".split())
LANDMARKS = frozenset(("article", "main"))
LAST = frozenset(("footer",))

_TOKEN = re.compile(r"<!--|<[!?][^>]*>|</?[A-Za-z](?:[^\"'<>]++|\"[^\"]*+\"|'[^']*+')*+>|</?[A-Za-z][^<>]*+>")
_NAME = re.compile(r"</?([A-Za-z][^\s/>]*)")
_ATTRIBUTE = re.compile(r"\s(class|id|role|style|hidden|aria-hidden)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?", re.I)
_WORD = re.compile(r"\S+")


class Tag:
    __slots__ = ("closes", "end", "match", "name", "source", "start")

    def __init__(self, name: str, closes: bool, start: int, end: int, source: str):
        self.name, self.closes, self.start, self.end, self.source = name, closes, start, end, source
        self.match: int | None = None  # place in the list of tags of the one that closes this


def tags_of(page: str) -> list[Tag]:
    """The tags of a page in order, without those in comments and raw elements; each opening tag knows the one that closes it."""
    out: list[Tag] = []
    at = 0
    never: set[str] = set()  # raw elements that nothing closes from here on
    while m := _TOKEN.search(page, at):
        at = m.end()
        if m[0] == "<!--":
            end = page.find("-->", m.start() + 2)
            at = len(page) if end < 0 else end + 3
            out.append(Tag("!", True, m.start(), at, ""))
            continue
        if m[0][1] in "!?":
            out.append(Tag("!", True, m.start(), at, ""))
            continue
        name, closes = _NAME.match(m[0])[1].lower(), m[0][1] == "/"
        out.append(Tag(name, closes, m.start(), at, m[0]))
        if name in RAW and not closes and not m[0].endswith("/>") and name not in never:
            end = re.compile(rf"</{name}\s*>", re.I).search(page, at)
            if end:
                at = end.start()
            else:
                never.add(name)
                if name in ("script", "style"):
                    out[-1].end = at = len(page)
    open_: dict[str, list[int]] = {}
    for i, t in enumerate(out):
        if t.closes:
            if open_.get(t.name):
                out[open_[t.name].pop()].match = i
        elif t.name not in VOID:
            open_.setdefault(t.name, []).append(i)
    return out


def is_boilerplate(tag: Tag) -> bool:
    """Whether an opening tag's name, class, id, role or style says that its element is no text."""
    if tag.name in NOT_TEXT:
        return True
    if " " not in tag.source and "\n" not in tag.source and "\t" not in tag.source or tag.name in LANDMARKS or tag.name in ("body", "html"):
        return False
    for key, *values in _ATTRIBUTE.findall(tag.source):
        value, key = "".join(values).lower(), key.lower()
        if key in ("class", "id") and any(w in NAMES or NAMES & set(re.split(r"[-_]+", w)) for w in value.split()):
            return True
        if key == "role" and value in ROLES or key == "hidden" or key == "aria-hidden" and value == "true" or key == "style" and re.search(r"display\s*:\s*none", value):
            return True
    return False


def tokens_of(page: str) -> list[tuple[str, int, int]]:
    """(class, start, end) of a page's words and tags: word, link word, the name of a tag, cut; what lies between tags is one entry if its words are of one class."""
    tags = tags_of(page)
    holds = [0]  # landmarks before each tag
    for t in tags:
        holds.append(holds[-1] + (t.name in LANDMARKS and not t.closes))
    out: list[tuple[str, int, int]] = []
    at, links, i = 0, 0, 0
    while i <= len(tags):
        start = tags[i].start if i < len(tags) else len(page)
        if start > at and not page[at:start].isspace():
            out.append(("link word" if links else "word", at, start))
        if i == len(tags):
            break
        t = tags[i]
        at = max(at, t.end)
        if t.closes or not is_boilerplate(t):
            if t.name == "a":
                links = 0 if t.closes or t.match is None else 1
            if t.name != "!":
                out.append((t.name, t.start, t.end))
            i += 1
            continue
        j = t.match
        if j is None:  # never closed
            if t.name in LAST and holds[-1] == holds[i]:
                at, i = len(page), len(tags)
            else:
                i += 1
        elif holds[j] > holds[i] and t.name not in RAW:
            i += 1  # an article lies in it
        else:
            at, i = tags[j].end, j + 1
        out.append(("cut", t.start, at))
    return out


def weight_of(kind: str, weights: dict[str, float]) -> float:
    if kind in weights:
        return weights[kind]
    return weights["bound"] if kind in LANDMARKS else weights["text tag"] if kind in TEXT_TAGS else weights["tag"]


def best_region(scores: list[float]) -> tuple[int, int]:
    """(first, end) of the contiguous run with the largest positive sum, the first and shortest of equals; (0, 0) if there is none."""
    best, found, total, first = 0.0, (0, 0), 0.0, 0
    for i, s in enumerate(scores):
        if total <= 0:
            total, first = 0.0, i
        total += s
        if total > best + 1e-9:
            best, found = total, (first, i + 1)
    return found


def region_of(counted: list[tuple[str, int]], weights: dict[str, float]) -> tuple[int, int]:
    """The best region of (class, number of words or 1)."""
    return best_region([weight_of(kind, weights) * n for kind, n in counted])


def counted_words(page: str, tokens: list[tuple[str, int, int]]) -> list[tuple[str, int]]:
    return [(kind, sum(1 for _ in _WORD.finditer(page, s, e)) if kind in ("word", "link word") else 1) for kind, s, e in tokens]


def main_text(page: str | None, weights: dict[str, float]) -> str:
    """The text of the best region: a line for each block, character references decoded, white space as one space."""
    if not page:
        return ""
    tokens = tokens_of(page)
    a, b = region_of(counted_words(page, tokens), weights)
    blocks: list[list[str]] = [[]]
    for kind, s, e in tokens[a:b]:
        if kind in ("word", "link word"):
            blocks[-1].append(page[s:e])
        elif kind == "br":
            blocks[-1].append(" ")
        elif kind not in INLINE and blocks[-1] and kind != "cut":
            blocks.append([])
        elif kind == "cut" and blocks[-1] and block_like(page, s):
            blocks.append([])
    lines = (" ".join(html_lib.unescape("".join(x)).split()) for x in blocks)
    return "\n".join(x for x in lines if x)


def block_like(page: str, at: int) -> bool:
    """Whether the element that begins here stands between blocks rather than in one."""
    name = _NAME.match(page, at)
    return bool(name) and name[1].lower() in BLOCKS


def labelled(page: str) -> tuple[list[tuple[str, int]], int, int] | None:
    """Counted words and tags of a page with just one article (or else just one main element), and which of them are in it; None for other pages."""
    tokens = tokens_of(page)
    if len(tokens) > MOST_TOKENS:
        return None
    for name in ("article", "main"):
        places = [i for i, t in enumerate(tokens) if t[0] == name]
        if len(places) == 2 and page[tokens[places[1]][1] + 1] == "/":
            return counted_words(page, tokens), places[0] + 1, places[1]
    return None


def perceptron(pages: list[tuple[list[tuple[str, int]], int, int]], rounds: int = ROUNDS) -> dict[str, float]:
    """Averaged weights; a step moves each class by how much oftener, per word or tag of the page, it is in the labelled region than in the one found."""
    kinds = {k for tokens, _, _ in pages for k, _ in tokens} | {"word", "link word", "cut"}
    base = {k: weight_of(k, START) for k in kinds}
    now, total, steps = dict(base), Counter(base), 1
    for _ in range(rounds):
        for tokens, a, b in pages:
            x, y = region_of(tokens, now)
            if (x, y) != (a, b):
                size = sum(n for _, n in tokens) or 1
                move: Counter = Counter()
                for sign, s, e in ((1, a, b), (-1, x, y)):
                    for k, n in tokens[s:e]:
                        move[k] += sign * n / size
                for k, d in move.items():
                    w = now[k] + d
                    now[k] = max(w, LEAST) if k in ("word", "link word") else min(w, -LEAST)
            for k, w in now.items():
                total[k] += w
            steps += 1
    return START | {k: w / steps for k, w in total.items()}


def learn(pages: DataFrame, html_col: str = "html", sample: int = SAMPLE) -> dict[str, float]:
    """Weights from at most `sample` labelled pages, the first by hash.

    Only hashes below a bound, so that about SPARE * sample pages are left whatever the table holds, go on to be read and ordered.
    """
    bound = int(-(2**63) + min(1.0, SPARE * sample / max(1, pages.count())) * 2**64) - 1
    some = pages.select(F.col(html_col).cast("string").alias("html")).withColumn("h", F.xxhash64("html")).where(F.col("h") <= F.lit(bound).cast("long"))
    some = some.where(F.col("html").rlike("(?i)<(article|main)[\\s>]") & (F.length("html") <= 16 * MOST_TOKENS)).orderBy("h", "html").limit(sample)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [x for x in map(labelled, batch.column("html").to_pylist()) if x]
            yield pa.record_batch([pa.array([[k for k, _ in x[0]] for x in found], pa.list_(pa.string())), pa.array([[n for _, n in x[0]] for x in found], pa.list_(pa.int64())), pa.array([x[1] for x in found], pa.int64()), pa.array([x[2] for x in found], pa.int64())], names=["kinds", "counts", "first", "until"])

    rows = bounded(some.select("html")).mapInArrow(tidy(work), "kinds array<string>, counts array<long>, first long, until long").toArrow().to_pylist()
    rows = sorted(rows, key=lambda r: (r["kinds"], r["counts"]))
    return perceptron([(list(zip(r["kinds"], r["counts"], strict=True)), r["first"], r["until"]) for r in rows])


def extract_text(pages: DataFrame, weights: dict[str, float], id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """page_id, url, text and n_chars of every whole page."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for piece in slices(batch, "html"):
                texts = [main_text(p, weights) for p in piece.column("html").to_pylist()]
                yield pa.record_batch([piece.column("id"), piece.column("url"), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], names=["page_id", "url", "text", "n_chars"])

    plain = pages.select(F.col(id_col).cast("long").alias("id"), F.col(url_col).cast("string").alias("url"), F.col(html_col).cast("string").alias("html"))
    return bounded(plain).mapInArrow(tidy(work), "page_id long, url string, text string, n_chars long")
