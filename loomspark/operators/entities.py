"""Names in texts: extraction, rules, statistics, validation."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import reduce

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, BooleanType, LongType, StringType, StructField, StructType

from loomspark.functions.dictionary import name_hits, name_statistics
from loomspark.functions.text import matches, quote_pattern
from loomspark.packs import Pack
from loomspark.sources.tables import bounded

MIN_OCCURRENCES, HIGH_OCCURRENCES, DIVERSITY = 3, 5, 2


def mentions(docs: DataFrame, pack: Pack, id_cols: list[str], text_col: str = "text", pattern: str | None = None) -> DataFrame:
    """One row per match of the pack's name pattern, with its offsets."""
    rows = docs.select(*id_cols, F.explode(matches(F.col(text_col), pattern or pack.name_pattern)).alias("m"))
    return rows.select(*id_cols, F.col("m.text").alias("name"), F.col("m.start").alias("start"), F.col("m.end").alias("end"))


def near_spans(names: DataFrame, spans: DataFrame, id_cols: list[str], before_chars: int = 200, after_chars: int = 200, bucket: int = 1000) -> DataFrame:
    """Mentions with a span within reach: an interval semi-join.

    Both sides are keyed by stretches of the text as well as its id, so a long text is many small groups.
    """
    reach = before_chars + after_chars
    n = names.withColumn("_b", F.explode(F.sequence(F.floor((F.col("start") - before_chars) / bucket), F.floor((F.col("end") + after_chars) / bucket))))
    s = spans.select(*id_cols, F.col("start").alias("_s"), F.col("end").alias("_e"), F.explode(F.sequence(F.floor(F.col("start") / bucket), F.floor(F.col("end") / bucket))).alias("_b"))
    assert reach >= 0
    hit = (F.col("_s") <= F.col("end") + after_chars) & (F.col("_e") >= F.col("start") - before_chars)
    return n.join(s, [*id_cols, "_b"]).where(hit).select(*names.columns).distinct()


def role_names(docs: DataFrame, quotes: DataFrame, pack: Pack, id_cols: list[str], least: int = 2, top: int = 30) -> DataFrame:
    """Model-free roles: names near quotes at `least` places or more, the most frequent `top` of each text."""
    near = near_spans(mentions(docs, pack, id_cols), quotes, id_cols)
    counted = near.groupBy(*id_cols, "name").agg(F.count_distinct("start").alias("n_positions"), F.min("start").alias("first_position")).where(F.col("n_positions") >= least)
    rank = F.row_number().over(Window.partitionBy(*id_cols).orderBy(F.desc("n_positions"), "first_position", "name"))
    return counted.withColumn("rank", rank).where(F.col("rank") <= top)


def descriptive_roles(text: Column, pack: Pack) -> Column:
    """Role words with an optional modifier of the form ...的, unique in order."""
    return F.array_distinct(F.regexp_extract_all(text, F.lit(f"(?:[一-龥]{{1,4}}的)?(?:{quote_pattern(pack.role_words)})"), F.lit(0)))


def _scanned(docs: DataFrame, names: DataFrame, id_cols: list[str], text_col: str, **wanted: int | tuple[str, ...]) -> DataFrame:
    """(ids, name, starts, next, windows; marks with words) of each of a text's distinct names: a text meets all of its names in one row and is read once."""
    per_text = names.groupBy(*id_cols).agg(F.collect_set("name").alias("_names"))
    texts = bounded(docs).select(*id_cols, F.col(text_col).alias("_t"))
    tasks = max(docs.sparkSession.sparkContext.defaultParallelism, 2 * docs.rdd.getNumPartitions())  # a fixed number: small texts are much work, so tasks aren't to be merged by bytes
    rows = texts.repartition(tasks, *id_cols).join(per_text, id_cols)
    return rows.select(*id_cols, F.explode(name_hits(F.col("_t"), F.col("_names"), **wanted)).alias("h")).select(*id_cols, "h.*")


def occurrence_counts(docs: DataFrame, names: DataFrame, id_cols: list[str], text_col: str = "text") -> DataFrame:
    """Non-overlapping occurrences of each of a text's distinct names, in one pass over the text."""
    return _scanned(docs, names, id_cols, text_col).select(*id_cols, "name", F.size("starts").cast("long").alias("n"))


def right_neighbours(docs: DataFrame, names: DataFrame, id_cols: list[str], text_col: str = "text", width: int = 2) -> DataFrame:
    """Distinct non-punctuation characters among the `width` after every occurrence of a name, for names that occur; one pass over the text."""
    found = _scanned(docs, names, id_cols, text_col, width=width).where(F.size("starts") > 0)
    every = found.groupBy(*id_cols, "name").agg(F.array_sort(F.array_distinct(F.flatten(F.collect_list("next")))).alias("neighbours"))  # rows may share an id
    return every.select(*id_cols, "name", F.size("neighbours").cast("long").alias("diversity"), "neighbours")


def cooccurrence(pairs: DataFrame, group: list[str], name: str = "name", keys: tuple[str, ...] = (), of: DataFrame | None = None, tasks: int | None = None) -> DataFrame:
    """Unordered pairs of names in the same group (a paragraph), counted both ways for each of the keys: (*keys, name, other, n).

    A group's distinct names are gathered once and paired in place, so the texts are read once; a paragraph bounds them.
    Each pair is made and counted in one direction, then given in both.  Pairs are many times the names, so with tasks the groups are
    dealt over so many tasks; adaptive execution goes by the bytes of the names and merges them.

    With of (some of the groups' columns, and name) only pairs of such a name with others are made, in this direction; one deal by those columns
    serves the groups and the names asked for.  Rows without a group (a null in its columns) have no pairs.
    """
    at = group if of is None else [c for c in of.columns if c != "name"]
    placed = pairs.dropna(subset=group)
    names = (placed.repartition(tasks, *at) if tasks else placed).groupBy(*group).agg(F.collect_set(F.col(name)).alias("_names")).where(F.size("_names") > 1)
    if of is not None:
        asked = names.join(of.groupBy(*at).agg(F.collect_set("name").alias("_of")), at)
        firsts = asked.select(*keys, F.explode(F.array_intersect("_names", "_of")).alias("name"), "_names")
        return firsts.select(*keys, "name", F.explode(F.array_remove("_names", F.col("name"))).alias("other")).groupBy(*keys, "name", "other").agg(F.count(F.lit(1)).alias("n"))
    firsts = names.select(*keys, F.explode("_names").alias("_a"), "_names")
    counted = firsts.select(*keys, "_a", F.explode(F.filter("_names", lambda b: b > F.col("_a"))).alias("_b")).groupBy(*keys, "_a", "_b").agg(F.count(F.lit(1)).alias("n"))
    both = F.array(F.struct(F.col("_a").alias("name"), F.col("_b").alias("other")), F.struct(F.col("_b").alias("name"), F.col("_a").alias("other")))
    return counted.select(*keys, F.explode(both).alias("p"), "n").select(*keys, "p.name", "p.other", "n")


def cooccurrence_stats(pairs: DataFrame, counts: DataFrame, high: int = HIGH_OCCURRENCES, keys: tuple[str, ...] = ()) -> DataFrame:
    """Partners of each name, and how often it occurs with frequent ones.

    Each pair is one row, as cooccurrence() gives them, so partners are counted without gathering pairs a second time.  Only frequent names meet
    them, behind an exchange of their own: adaptive execution sees how few they are and needn't sort the pairs.
    """
    often = counts.where(F.col("n") >= high).groupBy(*keys, F.col("name").alias("other")).agg(F.count(F.lit(1)).alias("_times")).hint("rebalance")
    met = pairs.join(often, [*keys, "other"], "left")
    return met.groupBy(*keys, "name").agg(F.count(F.lit(1)).alias("co_diversity"), F.coalesce(F.sum(F.col("n") * F.col("_times")), F.lit(0)).alias("high_conf_co"))


def boundary_hits(docs: DataFrame, names: DataFrame, pack: Pack, id_cols: list[str], text_col: str = "text", around: int = 50) -> DataFrame:
    """Templates (1 to 4 characters, then a boundary word) around each occurrence whose match overlaps the name: how many kinds, how many in all."""
    found = _scanned(docs, names, id_cols, text_col, near=around, words=pack.boundary_suffixes).where(F.size("starts") > 0)
    return found.groupBy(*id_cols, "name").agg(*_boundary_sums(pack)).select(*id_cols, "name", *_boundary_counts(pack))


def _boundary_sums(pack: Pack) -> list[Column]:
    return [F.sum(F.col("marks")[i]).alias(f"_k{i}") for i in range(len(pack.boundary_suffixes))] or [F.lit(0).cast("long").alias("_k0")]


def _boundary_counts(pack: Pack) -> list[Column]:
    every = [F.col(f"_k{i}") for i in range(max(1, len(pack.boundary_suffixes)))]
    return [F.size(F.filter(F.array(*every), lambda k: k > 0)).cast("long").alias("templates"), reduce(lambda a, b: a + b, every).alias("hits")]


def prefix_merges(stats: DataFrame, pack: Pack, keys: list[str], known_at: int = 5) -> DataFrame:
    """Rare names that are a frequent name with a word run into it: (name, n, neighbours) -> (name, prefix).

    At most two occurrences, less than a tenth of the prefix's, and half of the neighbours or more are dialogue words.
    """
    rare = stats.where((F.col("n") <= 2) & (F.length("name") >= 3)).withColumn("prefix", F.explode(F.array(F.expr("substring(name, 1, length(name) - 1)"), F.expr("substring(name, 1, length(name) - 2)"))))
    known = stats.where(F.col("n") >= known_at).select(*keys, F.col("name").alias("prefix"), F.col("n").alias("prefix_n"))
    share = F.size(F.array_intersect("neighbours", F.array(*(F.lit(w) for w in pack.dialogue_words)))) / F.size("neighbours")
    return rare.join(known, [*keys, "prefix"]).where((F.col("n") < 0.1 * F.col("prefix_n")) & (F.size("neighbours") > 0) & (share >= 0.5)).select(*keys, "name", "prefix").distinct()


def rescored(confidence: Column, n: Column, diversity: Column, co_diversity: Column, high_co: Column, templates: Column, hits: Column, whitelisted: Column | None = None) -> Column:
    """The confidence ladder of a name."""
    strong = (templates >= 3) & (hits >= 5)
    at_least = lambda x: F.greatest(confidence, F.lit(x))
    ladder = (
        F.when(n < MIN_OCCURRENCES, F.when(strong, at_least(0.5)).otherwise(0.3))
        .when(diversity <= 1, F.when((co_diversity >= 3) & (high_co >= 2), at_least(0.5)).when(strong, at_least(0.5)).otherwise(0.2))
        .when((n >= HIGH_OCCURRENCES) & (diversity >= DIVERSITY), at_least(0.8))
        .when(strong, at_least(0.6))
        .otherwise(confidence)
    )
    return ladder if whitelisted is None else F.when(whitelisted, confidence).otherwise(ladder)


def validate(docs: DataFrame, names: DataFrame, pack: Pack, id_cols: list[str], text_col: str = "text") -> DataFrame:
    """All statistics of the names (ids, name, confidence) of each text and their new confidence; merged names at 0.1.

    Every statistic is one of a text's own names, so texts and names are dealt by their ids once and the rest is done where they meet: no pair of
    names and no count is moved or written.  Rows that share an id follow each other and are judged together.
    """
    tasks = max(docs.sparkSession.sparkContext.defaultParallelism, 2 * docs.rdd.getNumPartitions())  # as in _scanned()
    given = names.select(*id_cols, "name", "confidence").where(F.col("name") != "").repartition(tasks, *id_cols)
    base = given.groupBy(*id_cols, "name").agg(F.max("confidence").alias("confidence")).groupBy(*id_cols).agg(F.collect_list(F.struct("name", "confidence")).alias("_names"))
    texts = bounded(docs).select(*id_cols, F.col(text_col).cast("string").alias("_text")).repartition(tasks, *id_cols)
    rows = texts.join(base, id_cols).sortWithinPartitions(*id_cols).select(*id_cols, "_text", "_names")
    counted = [StructField("n", LongType()), StructField("neighbours", ArrayType(StringType())), *(StructField(c, LongType()) for c in ("diversity", "templates", "hits", "co_diversity", "high_conf_co"))]
    schema = StructType([*rows.select(*id_cols).schema, StructField("name", StringType()), names.select("confidence").schema[0], *counted, StructField("merged", BooleanType())])
    stats = rows.mapInArrow(_judged(pack, len(id_cols), [f.name for f in schema]), schema)
    zero = lambda c: F.coalesce(F.col(c), F.lit(0))
    fresh = rescored(F.col("confidence"), F.col("n"), zero("diversity"), zero("co_diversity"), zero("high_conf_co"), zero("templates"), zero("hits"))
    return stats.withColumn("new_confidence", F.when(F.col("merged"), 0.1).otherwise(fresh)).drop("merged")


def _judged(pack: Pack, n_ids: int, columns: list[str], width: int = 2, around: int = 50, at_once: int = 4096) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """(ids, text, names with confidence), rows of one id after the other, to a row for each name and text (columns); see validate()."""
    rules = {"width": width, "near": around, "words": pack.boundary_suffixes, "spoken": pack.dialogue_words, "high": HIGH_OCCURRENCES}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at: tuple | None = None
        texts: list[str | None] = []
        names: dict[str, object] = {}
        own: list[pa.Array] = []
        ids: list[list[pa.Array]] = []
        made: list[tuple] = []
        types: list[pa.DataType] = []

        def close() -> None:
            rows = name_statistics(texts, list(names), **rules)
            made.extend((n, names[n], *rest) for n, *rest in rows)
            ids.extend([own] * len(rows))

        def flush() -> pa.RecordBatch:
            fixed = [pa.concat_arrays([x[k] for x in ids]) for k in range(n_ids)]
            out = [pa.array(x, t) for x, t in zip(zip(*made, strict=True), types, strict=True)]
            made.clear()
            ids.clear()
            return pa.record_batch([*fixed, *out], names=columns)

        for batch in batches:
            confidence = batch.schema.field(n_ids + 1).type.value_type.field("confidence").type
            types = [pa.string(), confidence, pa.int64(), pa.list_(pa.string()), *[pa.int64()] * 5, pa.bool_()]
            for i in range(batch.num_rows):
                here = tuple(batch.column(k)[i].as_py() for k in range(n_ids))
                if here != at:
                    if at is not None:
                        close()
                        if len(made) >= at_once:
                            yield flush()
                    at, texts, own = here, [], [pa.array([v], batch.column(k).type) for k, v in enumerate(here)]
                    names = {x["name"]: x["confidence"] for x in batch.column(n_ids + 1)[i].as_py()}
                texts.append(batch.column(n_ids)[i].as_py())
        if at is not None:
            close()
        if made:
            yield flush()

    return run


def validate_and_discover(docs: DataFrame, names: DataFrame, pack: Pack, id_cols: list[str], text_col: str = "text", tokens: DataFrame | None = None) -> DataFrame:
    """As validate(), with the names that it leads to: compounds of names of one character (0.65), and with tokens (ids, sentence_index, tokens) words that stand before boundary words (0.6).

    A discovery that is a name already leaves that name as it is; what was counted of others is null.
    """
    known = validate(docs, names, pack, id_cols, text_col)
    found = compound_names(docs, names.where(F.length("name") == 1), pack, id_cols, text_col).select(*id_cols, "name", "n", "confidence")
    if tokens is not None:
        each = tokens.select(*id_cols, "sentence_index", F.posexplode("tokens").alias("_at", "token")).withColumn("_order", F.struct("sentence_index", "_at"))
        found = found.unionByName(boundary_names(each, names, pack, id_cols, "_order").select(*id_cols, "name", "n", "confidence"))
    fresh = found.join(known.select(*id_cols, "name"), [*id_cols, "name"], "left_anti").groupBy(*id_cols, "name").agg(F.max("n").alias("n"), F.max("confidence").alias("confidence"))
    return known.unionByName(fresh.withColumn("new_confidence", F.col("confidence")), allowMissingColumns=True)


def with_tightness(counted: DataFrame, keys: list[str]) -> DataFrame:
    """Adds each row's share of its keys' n: totals are aggregated first, so no key is gathered."""
    return counted.join(counted.groupBy(*keys).agg(F.sum("n").alias("_total")), keys).withColumn("tightness", F.col("n") / F.col("_total")).drop("_total")


def compound_names(docs: DataFrame, heads: DataFrame, pack: Pack, id_cols: list[str], text_col: str = "text", within: int = 60, least: int = 2, tightness: float = 0.1) -> DataFrame:
    """Two-character names from single-character heads: the head with its next character, near a boundary word, often enough and tight."""
    found = _scanned(docs, heads, id_cols, text_col, after=within + 1).select(*id_cols, F.col("name").alias("head"), F.explode("windows").alias("_w"))
    size = F.length("head") + 1
    hits = found.withColumn("name", F.substring("_w", F.lit(1), size)).where(F.col("name").rlike("^[\\p{L}]+$") & (F.length("name") == size))
    near = F.substring(F.col("_w"), size + 1, F.lit(within)).rlike(quote_pattern(pack.boundary_suffixes))
    counted = hits.groupBy(*id_cols, "head", "name").agg(F.count(F.lit(1)).alias("n"), F.count_if(near).alias("near"))
    return with_tightness(counted, [*id_cols, "head"]).where((F.col("near") >= least) & (F.col("tightness") >= tightness)).withColumn("confidence", F.lit(0.65))


def boundary_names(tokens: DataFrame, known: DataFrame, pack: Pack, keys: list[str], order: str, least: int = 2) -> DataFrame:
    """Tokens of 2 to 4 characters right before a boundary word, `least` times or more, that start no known name."""
    words = [w.strip() for w in pack.boundary_suffixes]
    nxt = F.lead("token").over(Window.partitionBy(*keys).orderBy(order))
    found = tokens.withColumn("next", nxt).where(F.col("next").isin(*words) & F.length("token").between(2, 4)).groupBy(*keys, F.col("token").alias("name")).agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= least)
    return found.join(known.select(*keys, F.col("name").alias("_k")).distinct(), keys, "left").where(F.col("_k").isNull() | ~F.startswith(F.col("_k"), F.col("name"))).groupBy(*keys, "name").agg(F.max("n").alias("n")).withColumn("confidence", F.lit(0.6))


def surnames(docs: DataFrame, titles: tuple[str, ...], allowed: tuple[str, ...], text_col: str = "text", least: int = 3) -> DataFrame:
    """Characters right before a title, `least` times or more, that are surnames."""
    hits = docs.select(F.explode(F.regexp_extract_all(text_col, F.lit(f"(.)(?:{quote_pattern(titles)})"), F.lit(1))).alias("surname"))
    return hits.where(F.col("surname").isin(*allowed)).groupBy("surname").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= least)


def name_suffixes(stats: DataFrame, pack: Pack, high: int = HIGH_OCCURRENCES, least: int = 3) -> DataFrame:
    """Last one or two characters of frequent names: significant if frequent and short, or a listed suffix."""
    ends = stats.where((F.col("n") >= high) & (F.length("name") >= 2)).select("name", F.explode(F.array_distinct(F.array(F.expr("right(name, 1)"), F.expr("right(name, 2)")))).alias("suffix"))
    counted = ends.groupBy("suffix").agg(F.count_distinct("name").alias("n_names"))
    return counted.where((F.col("n_names") >= least) & ((F.length("suffix") == 1) | F.col("suffix").isin(*pack.name_suffixes)))


def composite_score(n: Column, diversity: Column, templates: Column, co_diversity: Column) -> Column:
    """A weighted mean of the four signals, each capped."""
    part = lambda c, cap: F.least(c / cap, F.lit(1.0))
    return part(n, 10) * 0.3 + part(diversity, 5) * 0.3 + part(templates, 5) * 0.25 + part(co_diversity, 5) * 0.15


def merge_runs(tokens: DataFrame, keys: list[str], order: str, kind: str = "type", text: str = "token") -> DataFrame:
    """Neighbouring tokens of one type become one entity (gaps and islands)."""
    w = Window.partitionBy(*keys).orderBy(order)
    island = F.sum(F.coalesce((F.lag(kind).over(w) != F.col(kind)).cast("int"), F.lit(1))).over(w)
    rows = tokens.withColumn("_i", island)
    return rows.groupBy(*keys, "_i", kind).agg(F.min(order).alias("first"), F.count(F.lit(1)).alias("n_tokens"), F.concat_ws("", F.transform(F.sort_array(F.collect_list(F.struct(order, text))), lambda x: x[text])).alias("entity")).drop("_i")


def clean_person(name: Column, surnames_: tuple[str, ...], stop: tuple[str, ...]) -> Column:
    """Confidence cap of a person name: 0 for stop words, digits, short ASCII and long phrases; 0.3 for a lone character that is no surname; else 1."""
    return F.when(name.isin(*stop) | name.rlike(r"\d") | name.rlike("^[A-Za-z]{1,2}$") | ((F.length(name) > 7) & name.rlike("[的和与]")), 0.0).when((F.length(name) == 1) & ~name.isin(*surnames_), 0.3).otherwise(1.0)


def title_entities(entities: DataFrame, chapters: DataFrame, id_cols: list[str]) -> DataFrame:
    """Entities that lie in no chapter heading."""
    heads = chapters.select(*id_cols, F.col("start").alias("_s"), (F.col("start") + F.length("title")).alias("_e"))
    inside = (F.col("start") >= F.col("_s")) & (F.col("start") < F.col("_e"))
    same = [entities[k].eqNullSafe(heads[k]) for k in id_cols]
    cond = inside
    for c in same:
        cond = cond & c
    return entities.join(heads, cond, "left_anti")


def valid_name(name: Column, black: tuple[str, ...], verbs: tuple[str, ...], longest: int = 8) -> Column:
    """Length, blacklist, particle and verb-suffix tests."""
    return F.length(name).between(1, longest) & ~name.isin(*black) & ~name.rlike("[的地得着了过]$") & ~name.rlike(f"(?:{quote_pattern(verbs)})$")


def cleaned_hint(name: Column, pack: Pack) -> Column:
    """A speaker hint without one trailing speech verb (longest first), the particle 地 and one modifier."""
    no_verb = F.regexp_replace(name, f"(?:{quote_pattern(pack.speech_verbs)})$", "")
    return F.regexp_replace(F.regexp_replace(no_verb, "地$", ""), "(?:冷冷|淡淡|轻轻|微微|缓缓)$", "")


def srl_agent(agent: Column, titles: tuple[str, ...]) -> Column:
    """An agent phrase as a name: after the last 的 if two characters follow, without place and title suffixes; null if it is none."""
    tail = F.regexp_extract(agent, "的([^的]{2,})$", 1)
    name = F.regexp_replace(F.when(tail != "", tail).otherwise(agent), f"(?:里|中|上|下|旁|边)$|(?:{quote_pattern(titles)})$", "")
    return F.when((F.length(name) >= 2) & ~name.rlike(r"\d"), name)


def speaker_roles(names: DataFrame, speakers: DataFrame, keys: list[str]) -> DataFrame:
    """Keeps entities that may speak: no person, exactly 0.65, three mentions, or a speaker; more scenes raise confidence."""
    rows = names.join(speakers.select(*keys, "name").distinct().withColumn("_speaks", F.lit(True)), [*keys, "name"], "left")
    keep = (F.col("type") != "PER") | (F.round("confidence", 10) == 0.65) | (F.col("n") >= 3) | F.coalesce("_speaks", F.lit(False))
    raised = F.when(F.col("scenes") >= 3, F.greatest("confidence", F.least(F.col("confidence") * 1.5, F.lit(0.8)))).when(F.col("scenes") >= 2, F.greatest("confidence", F.least(F.col("confidence") * 1.5, F.lit(0.65)))).otherwise(F.col("confidence"))
    return rows.where(keep).withColumn("confidence", raised).drop("_speaks")


def chapter_spread(positions_: DataFrame, chapters: DataFrame, id_cols: list[str], bucket: int = 5000) -> DataFrame:
    """Distinct chapters in which each name occurs: positions meet chapter spans by stretches of the text."""
    p = positions_.withColumn("_b", F.floor(F.col("start") / bucket))
    c = chapters.select(*id_cols, F.col("chapter_index"), F.col("start").alias("_s"), F.col("end").alias("_e"))
    c = c.withColumn("_b", F.explode(F.sequence(F.floor(F.col("_s") / bucket), F.floor((F.col("_e") - 1) / bucket))))
    inside = (F.col("start") >= F.col("_s")) & (F.col("start") < F.col("_e"))
    return p.join(c, [*id_cols, "_b"]).where(inside).groupBy(*id_cols, "name").agg(F.count_distinct("_s").alias("n_chapters"))
