"""Text to volumes, chapters, paragraphs, sentences and fragments.

Everything here works inside a row with higher-order functions and then explodes: no shuffle, one pass.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomspark.functions.dictionary import names_in
from loomspark.functions.text import BLANKS, SPAN, after, before, let, matches, ngrams, quote_pattern, running, scan, strip
from loomspark.packs import Pack

CHUNK, OVERLAP, LEAST_CHAPTER = 5000, 200, 10


def line_spans(text: Column) -> Column:
    """Lines with offsets; a line's end excludes its newline."""
    ends = lambda lines: running(F.transform(lines, lambda x: F.length(x) + 1))
    place = lambda x, e: F.struct((e - 1 - F.length(x)).alias("start"), (e - 1).alias("end"), x.alias("text"))
    return let(F.split(text, "\n", -1), lambda lines: F.zip_with(lines, ends(lines), place))


def any_of(c: Column, patterns: tuple[str, ...]) -> Column:
    out = F.lit(False)
    for p in patterns:
        out = out | c.rlike(p)
    return out


def headings(text: Column, patterns: tuple[str, ...], unless: tuple[str, ...] = ()) -> Column:
    """Lines that match a heading pattern; one with an earlier heading's title within 100 characters is dropped."""
    found = F.filter(line_spans(text), lambda x: any_of(x["text"], patterns) & ~any_of(x["text"], unless))
    none = F.array().cast(SPAN)

    def step(near: Column, x: Column) -> tuple[Column, Column]:
        close = F.filter(near, lambda k: x["start"] - k["start"] < 100)
        again = F.exists(close, lambda k: k["text"] == x["text"])
        return F.when(again, close).otherwise(F.array_append(close, x)), F.when(again, none).otherwise(F.array(x))

    return scan(found, none, step, SPAN[6:-1])


def is_volume_title(c: Column, pack: Pack) -> Column:
    return any_of(c, pack.volume_patterns)


def split_chapters(docs: DataFrame, pack: Pack, id_col: str = "doc_id", text_col: str = "text", least: int = LEAST_CHAPTER, chunk: int = CHUNK, overlap: int = OVERLAP) -> DataFrame:
    """(id, volume_index, volume_title, chapter_index, title, start, end, content).

    Headings before the first volume form a prologue volume, which shifts the later volumes by one; chapter
    indexes restart in every volume and skip chapters shorter than `least`.  A text without
    headings is one chapter, or overlapping chunks that end with the text.
    """
    text = F.col(text_col)
    base = docs.where(text.isNotNull()).select(F.col(id_col), text.alias("_t"), headings(text, pack.chapter_patterns, pack.volume_patterns).alias("_h"), headings(text, pack.volume_patterns).alias("_v"))
    stop = F.length("_t")

    def chapter(h: Column, i: Column) -> Column:
        line_end = F.position(F.lit("\n"), F.col("_t"), h["start"] + 1)
        following = F.filter("_v", lambda v: v["start"] > h["start"])
        ends = F.least(F.coalesce(F.try_element_at("_h", i + 2)["start"], stop), F.coalesce(F.try_element_at(following, F.lit(1))["start"], stop))
        own = F.filter("_v", lambda v: v["start"] <= h["start"])

        def bodied(x: Column) -> Column:
            body = F.when(x["nl"] == 0, F.lit("")).when(x["nl"] - 1 < h["start"] + F.length(h["text"]) + 5, F.substring(F.col("_t"), h["end"] + 2, x["end"] - h["end"] - 1)).otherwise(F.substring(F.col("_t"), h["start"] + 1, x["end"] - h["start"]))
            return F.struct(F.size(x["own"]).alias("volume"), F.coalesce(F.try_element_at(x["own"], F.lit(-1))["text"], F.lit(pack.prologue)).alias("volume_title"), strip(h["text"]).alias("title"), h["start"].alias("start"), x["end"].alias("end"), strip(body).alias("content"))

        return let(F.struct(line_end.alias("nl"), ends.alias("end"), own.alias("own")), bodied)

    def in_volumes(found: Column) -> Column:
        """Chapters in order: an index counts the chapters since the volume's first, as a volume's chapters stand together."""
        volumes = F.transform(found, lambda c: c["volume"])

        def placed(x: Column) -> Column:
            one = lambda c, i: F.struct(F.when(F.size("_v") > 0, c["volume"] - x["shift"]).otherwise(0).alias("volume_index"), F.when(F.size("_v") > 0, c["volume_title"]).otherwise(pack.whole).alias("volume_title"), (i + 1 - F.array_position(x["volumes"], c["volume"])).cast("int").alias("chapter_index"), c["title"].alias("title"), c["start"].alias("start"), c["end"].alias("end"), c["content"].alias("content"))
            return F.transform(found, one)

        shift = lambda vs: F.when(F.array_contains(vs, 0), F.lit(0)).otherwise(F.lit(1))
        return let(let(volumes, lambda vs: F.struct(vs.alias("volumes"), shift(vs).alias("shift"))), placed)

    found = F.filter(F.transform("_h", chapter), lambda c: F.length(c["content"]) >= least)
    with_volumes = let(found, in_volumes)
    starts = F.when(stop <= chunk, F.array(F.lit(0))).otherwise(F.sequence(F.lit(0), F.greatest(stop - overlap - 1, F.lit(0)), F.lit(chunk - overlap)))
    name = lambda i: F.when(stop <= chunk, F.lit(pack.whole)).otherwise(F.concat(F.lit(pack.chunk_title[0]), (i + 1).cast("string"), F.lit(pack.chunk_title[1])))
    chunks = F.transform(starts, lambda s, i: F.struct(F.lit(0).alias("volume_index"), F.lit(pack.whole).alias("volume_title"), i.alias("chapter_index"), name(i).alias("title"), s.alias("start"), F.least(s + chunk, stop).alias("end"), F.substring(F.col("_t"), s + 1, F.lit(chunk)).alias("content")))
    return base.select(id_col, F.explode(F.when(F.size("_h") == 0, chunks).otherwise(with_volumes)).alias("c")).select(id_col, "c.*")


def structure_info(chapters: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """Chapters and characters of every volume."""
    return chapters.groupBy(id_col, "volume_index", "volume_title").agg(F.count(F.lit(1)).alias("n_chapters"), F.sum(F.length("content")).alias("n_chars"), F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("chapter_index", "title"))), lambda x: x["title"]), "|").alias("titles"))


def _smart_pieces(text: Column, pack: Pack) -> Column:
    """What a text is cut into: lines, cut after terminators that lie in no quoted span, and the newlines.

    The pattern never backtracks: runs of plain characters, whole quoted spans, or a quote that never closes.
    """
    opens = "".join(dict.fromkeys(o for o, _ in pack.quotes))
    quoted = "|".join(f"{o}[^{c}]*+{c}" for o, c in pack.quotes)
    body = f"(?:[^{pack.terminators}{opens}]++|{quoted}|[{opens}])"
    pattern = f"{body}*+[{pack.terminators}]|{body}++"
    return F.flatten(F.transform(F.split(text, "\n"), lambda line: F.array_append(F.regexp_extract_all(line, F.lit(pattern), F.lit(0)), F.lit("\n"))))


def _plain_pieces(text: Column, pack: Pack) -> Column:
    return F.split(text, f"(?<=[{pack.terminators}\n])")


def _stripped(pieces: Column) -> Column:
    return F.filter(F.transform(pieces, strip), lambda s: F.length(s) > 0)


def smart_sentences(text: Column, pack: Pack) -> Column:
    """Sentences cut after terminators that lie in no quoted span, and at newlines; white space stripped, terminators kept."""
    return _stripped(_smart_pieces(text, pack))


def plain_sentences(text: Column, pack: Pack) -> Column:
    """Sentences cut after every terminator and newline, quoted or not."""
    return _stripped(_plain_pieces(text, pack))


def sentence_spans(text: Column, pack: Pack, smart: bool = True) -> Column:
    """The sentences with offsets: the pieces' lengths add up to the text's, so no sentence is looked for."""

    def place(piece: Column, end: Column) -> Column:
        sentence = strip(piece)
        start = end - F.length(F.ltrim(piece, F.lit(BLANKS)))
        return F.struct(start.alias("start"), (start + F.length(sentence)).alias("end"), sentence.alias("text"))

    pieces = (_smart_pieces if smart else _plain_pieces)(text, pack)
    placed = let(pieces, lambda p: F.zip_with(p, running(F.transform(p, F.length)), place))
    return F.filter(placed, lambda x: x["end"] > x["start"])


def sentences(docs: DataFrame, pack: Pack, id_cols: list[str], text_col: str = "text", smart: bool = True, around: int = 0) -> DataFrame:
    """One row per sentence with its index and offsets; with around, also its window: as many characters before and after it too.

    Windows are cut where the text still is, so no shuffle carries it.
    """
    rows = docs.select(*id_cols, F.col(text_col).alias("_t"), F.posexplode(sentence_spans(F.col(text_col), pack, smart)).alias("sentence_index", "x"))
    window = [F.concat(before(F.col("_t"), F.col("x.start"), around), F.col("x.text"), after(F.col("_t"), F.col("x.end"), around)).alias("window")] if around else []
    return rows.select(*id_cols, "sentence_index", F.col("x.start").alias("start"), F.col("x.end").alias("end"), F.col("x.text").alias("sentence"), *window)


def paragraphs(docs: DataFrame, id_cols: list[str], text_col: str = "text", least: int = 10) -> DataFrame:
    """Blocks between blank lines, of `least` characters or more."""
    parts = F.transform(F.split(F.col(text_col), "\n{2,}"), strip)
    rows = docs.select(*id_cols, F.posexplode(parts).alias("paragraph_index", "paragraph"))
    return rows.where(F.length("paragraph") >= least)


def fragments(sentence: Column, pack: Pack) -> Column:
    """Alternating narration and dialogue parts; a sentence that is a single part is narration as a whole."""
    quoted = "|".join(f"{o}[^{c}]+?{c}" for o, c in pack.dialogue_quotes + (("“", "”"),))
    hits, gaps = F.regexp_extract_all(sentence, F.lit(quoted), F.lit(0)), F.split(sentence, quoted, -1)
    part = lambda kind, t: F.struct(F.lit(kind).alias("type"), t.alias("text"))
    mixed = F.flatten(F.transform(F.arrays_zip(gaps.alias("g"), hits.alias("h")), lambda x: F.array(part("narration", strip(x["g"])), part("dialogue", x["h"]))))
    parts = F.filter(mixed, lambda p: F.length(p["text"]) > 0)
    return F.when(F.size(parts) <= 1, F.array(part("narration", sentence))).otherwise(parts)


def narration(text: Column) -> Column:
    """The text without quoted parts (directed quotes only)."""
    return strip(F.regexp_replace(text, "[「『“‘].*?[」』”’]", ""))


def entity_in(sentence: Column, name: Column) -> Column:
    """Whether a name is in a sentence; a single character must have no neighbour of its script."""
    alone = F.regexp_like(sentence, F.concat(F.lit("(?<![一-龥])\\Q"), name, F.lit("\\E(?![一-龥])")))
    return F.coalesce((sentence == name) | F.when(F.length(name) == 1, alone).otherwise(F.contains(sentence, name)), F.lit(False))


def with_entities(sentences_: DataFrame, names: DataFrame, id_cols: list[str], sentence_col: str = "sentence", together: int = 1000) -> DataFrame:
    """Adds entities: the text's names that a sentence has, as in entity_in(), sorted.

    Up to `together` sentences of a text (by sentence_index; dealt by hash where there is none) meet its names as one row, so the names
    of a text make one automaton for each such stretch and a sentence costs its own length.
    """
    per_text = names.where(F.length("name") > 0).groupBy(*id_cols).agg(F.collect_set("name").alias("_names"))
    stretch = F.floor(F.col("sentence_index") / together) if "sentence_index" in sentences_.columns else F.pmod(F.xxhash64(sentence_col), F.lit(64))
    rows = sentences_.withColumn("_stretch", stretch).groupBy(*id_cols, "_stretch").agg(F.collect_list(F.struct(*sentences_.columns)).alias("_rows"))
    found = names_in(F.transform("_rows", lambda r: r[sentence_col]), F.coalesce("_names", F.array().cast("array<string>")), "[一-龥]")
    each = rows.join(per_text, id_cols, "left").select("_rows", found.alias("_found"))
    return each.select(F.explode(F.arrays_zip("_rows", "_found")).alias("x")).select("x._rows.*", F.col("x._found").alias("entities"))


def strided(df: DataFrame, order: list[str], by: list[str], step: int) -> DataFrame:
    """Every step-th row of each group."""
    from pyspark.sql import Window

    n = F.row_number().over(Window.partitionBy(*by).orderBy(*order)) - 1
    return df.withColumn("_n", n).where(F.col("_n") % step == 0).drop("_n")


def dialogue_samples(docs: DataFrame, pack: Pack, id_col: str = "doc_id", text_col: str = "text", least: int = 5, most: int = 100, around: int = 20) -> DataFrame:
    """Quotes of least to most characters with their surroundings and two simple flags."""
    quoted = "|".join(f"{o}[^{c}]{{{least},{most}}}{c}" for o, c in pack.dialogue_quotes[:3])
    rows = docs.select(id_col, F.col(text_col).alias("_t"), F.explode(matches(F.col(text_col), quoted)).alias("m"))
    rows = rows.select(id_col, F.col("m.start").alias("start"), F.expr("substring(m.text, 2, length(m.text) - 2)").alias("quote"), before(F.col("_t"), F.col("m.start"), around).alias("before"), after(F.col("_t"), F.col("m.end"), around).alias("after"))
    return rows.withColumn("has_guide_word", F.col("before").rlike(quote_pattern(pack.speech_verbs))).withColumn("is_question", F.col("quote").rlike("[?？]"))


def keyword_grams(docs: DataFrame, id_cols: list[str], text_col: str, runs: str = "[一-龥]+", sizes: tuple[int, ...] = (2, 3)) -> DataFrame:
    """n-grams inside runs of a script, one row each."""
    pieces = F.regexp_extract_all(F.col(text_col), F.lit(runs), F.lit(0))
    grams = F.flatten(F.transform(pieces, lambda p: F.concat(*(ngrams(p, n) for n in sizes))))
    return docs.select(*id_cols, F.explode(grams).alias("gram"))
