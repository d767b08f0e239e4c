"""The character library as a table: point reads, changes, linking and merging.

Tables are immutable; a change is a new DataFrame.  characters: id, project, name, aliases, gender, first_appearance, is_locked.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loomspark.packs import Pack

GENDERS = ("male", "female", "unknown")
ELIGIBLE_AT, PROMOTED_AT = 5, 3
SENTENCE_COLUMNS = ("text", "speaker", "emotion", "sentence_type", "sfx", "voice")


def by_key(df: DataFrame, **keys: object) -> DataFrame:
    """Rows with these values; the filters reach the scan."""
    for k, v in keys.items():
        df = df.where(F.col(k) == v)
    return df


def ordered_read(df: DataFrame, by: dict[str, object], order: str) -> DataFrame:
    return by_key(df, **by).orderBy(order)


def update_rows(df: DataFrame, key: str, value: object, changes: dict[str, object], allowed: tuple[str, ...] = SENTENCE_COLUMNS, mark: str | None = "is_edited") -> DataFrame:
    """Changes allowed columns of the matching rows; others are ignored; marks them as edited."""
    hit = F.col(key) == value
    out = df.withColumns({c: F.when(hit, F.lit(v)).otherwise(F.col(c)) for c, v in changes.items() if c in allowed and c in df.columns})
    return out.withColumn(mark, F.when(hit, F.lit(True)).otherwise(F.coalesce(F.col(mark), F.lit(False)))) if mark and mark in df.columns else out


def insert_ignore(df: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """Adds rows whose key isn't there; of new rows with equal keys one stays."""
    return df.unionByName(new.dropDuplicates(keys).join(df.select(*keys), keys, "left_anti").select(df.columns))


def delete_rows(df: DataFrame, gone: DataFrame, keys: list[str]) -> DataFrame:
    return df.join(gone.select(*keys), keys, "left_anti").select(df.columns)


def next_ids(df: DataFrame, new: DataFrame, id_col: str, order: list[str]) -> DataFrame:
    """New rows with ids that follow the table's largest, in order, without gaps.

    Rows are numbered within the first order column (a project); only its counts go through a single task.
    """
    top = df.agg(F.coalesce(F.max(id_col), F.lit(0)).alias("_top"))
    head = order[0]
    before = F.coalesce(F.sum("_k").over(Window.orderBy(head).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    offsets = new.groupBy(head).agg(F.count(F.lit(1)).alias("_k")).withColumn("_before", before).drop("_k")
    rows = new.withColumn("_n", F.row_number().over(Window.partitionBy(head).orderBy(*order))).join(offsets, new[head].eqNullSafe(offsets[head])).drop(offsets[head])
    return rows.join(F.broadcast(top)).withColumn(id_col, (F.col("_top") + F.col("_before") + F.col("_n")).cast("long")).drop("_top", "_before", "_n")


def with_alias(df: DataFrame, character_id: int, alias: str) -> DataFrame:
    return df.withColumn("aliases", F.when(F.col("id") == character_id, F.array_union("aliases", F.array(F.lit(alias)))).otherwise(F.col("aliases")))


def without_alias(df: DataFrame, character_id: int, alias: str) -> DataFrame:
    return df.withColumn("aliases", F.when(F.col("id") == character_id, F.array_remove("aliases", alias)).otherwise(F.col("aliases")))


def set_gender(df: DataFrame, character_id: int, gender: str) -> DataFrame:
    if gender not in GENDERS:
        raise ValueError(f"gender must be one of {GENDERS}")
    return df.withColumn("gender", F.when(F.col("id") == character_id, F.lit(gender)).otherwise(F.col("gender")))


def update_character(df: DataFrame, character_id: int, name: str | None = None, aliases: list[str] | None = None, gender: str | None = None) -> DataFrame:
    """Changes what is given of one character."""
    if gender is not None:
        df = set_gender(df, character_id, gender)
    changes = {"name": F.lit(name) if name is not None else None, "aliases": F.array(*(F.lit(a) for a in aliases)).cast("array<string>") if aliases is not None else None}
    return df.withColumns({c: F.when(F.col("id") == character_id, v).otherwise(F.col(c)) for c, v in changes.items() if v is not None})


def locked(df: DataFrame, project: object) -> DataFrame:
    return by_key(df, project=project, is_locked=True)


def counted(df: DataFrame) -> DataFrame:
    """Characters of every project."""
    return df.groupBy("project").agg(F.count(F.lit(1)).alias("n_characters"))


def with_ground_truth(characters: DataFrame, truth: DataFrame) -> DataFrame:
    """The library with reference names for an evaluation: truth (project, name, aliases) joins it, and its names and aliases win.

    An alias that the truth gives to one name is taken from all others.
    """
    given = truth.select("project", "name", F.coalesce("aliases", F.array().cast("array<string>")).alias("_more")).groupBy("project", "name").agg(F.array_distinct(F.flatten(F.collect_list("_more"))).alias("_more"))
    taken = given.groupBy("project").agg(F.flatten(F.collect_list("_more")).alias("_taken"))
    old = characters.join(given, ["project", "name"], "left").join(taken, "project", "left")
    aliases = F.array_union(F.array_except("aliases", F.coalesce("_taken", F.array().cast("array<string>"))), F.coalesce("_more", F.array().cast("array<string>")))
    kept = old.withColumn("aliases", F.sort_array(aliases)).select(characters.columns)
    new = given.join(characters.select("project", "name"), ["project", "name"], "left_anti").withColumn("aliases", F.sort_array("_more"))
    return kept.unionByName(new.drop("_more"), allowMissingColumns=True)


def set_lock(df: DataFrame, project: object, character_id: int, locked: bool) -> DataFrame:
    return df.withColumn("is_locked", F.when((F.col("project") == project) & (F.col("id") == character_id), F.lit(locked)).otherwise(F.col("is_locked")))


def all_names(characters: DataFrame, temporary: DataFrame | None = None) -> DataFrame:
    """Distinct (project, name): names, aliases and temporary names."""
    out = characters.select("project", "name").union(characters.select("project", F.explode("aliases")))
    return (out.union(temporary.select("project", "name")) if temporary is not None else out).distinct()


def lookup_names(characters: DataFrame) -> DataFrame:
    """(project, key, priority, id, name): a name comes before an alias, then the lower id."""
    own = characters.select("project", F.col("name").alias("key"), F.lit(1).alias("priority"), "id", "name")
    return own.union(characters.select("project", F.explode("aliases").alias("key"), F.lit(2).alias("priority"), "id", "name"))


def find_by_name(wanted: DataFrame, characters: DataFrame) -> DataFrame:
    """The character of each wanted (project, key), by name, else by alias."""
    best = lookup_names(characters).groupBy("project", "key").agg(F.min(F.struct("priority", "id", "name")).alias("b"))
    return wanted.join(best, ["project", "key"], "left").select(wanted["*"], F.col("b.id").alias("id"), F.col("b.name").alias("standard_name"))


def candidates(characters: DataFrame, top: int = 6) -> DataFrame:
    """For each project: persisted characters first, then the latest first appearance."""
    rank = F.row_number().over(Window.partitionBy("project").orderBy(F.desc("is_persisted"), F.desc("first_appearance"), "id"))
    return characters.withColumn("rank", rank).where(F.col("rank") <= top)


def slice_rows(df: DataFrame, by: list[str], order: str, start: int = 0, end: int = -1) -> DataFrame:
    """Rows start to end of each group in order; end -1 means to its end."""
    n = F.row_number().over(Window.partitionBy(*by).orderBy(order)) - 1
    out = df.withColumn("_n", n).where(F.col("_n") >= start)
    return (out if end == -1 else out.where(F.col("_n") < end)).drop("_n")


def add_columns(df: DataFrame, columns: dict[str, str]) -> DataFrame:
    """Migration: missing columns appear as nulls of their type."""
    return df.withColumns({c: F.lit(None).cast(t) for c, t in columns.items() if c not in df.columns})


def progress_pivot(df: DataFrame, row: str, step: str, status: str, steps: list[str], time: list[str]) -> DataFrame:
    """One column per step with its latest status by time; the steps are given, so no job looks for them."""
    return df.groupBy(row).pivot(step, steps).agg(F.max_by(status, F.struct(*time)))


def speaking_in(characters: DataFrame, sentences: DataFrame, chapter: object, on: str = "name") -> DataFrame:
    """Characters with a sentence in a chapter, each once: a semi-join."""
    return characters.join(sentences.where(F.col("chapter") == chapter).select(F.col("speaker").alias(on)), on, "left_semi")


def core_name(name: Column, kin: str = "(?:先生|小姐|姑娘|公子|师兄|师姐|大人|长老|哥|姐|弟|妹|叔|伯|爷|婆)$") -> Column:
    return F.regexp_replace(name, kin, "")


def link_entities(entities: DataFrame, characters: DataFrame, kin: str | None = None, keep_at: float = 0.5) -> DataFrame:
    """Links (project, text, type, confidence) to the library.

    Exact name or alias at 1.0; else the core name as a name or alias, inside a library name or as its suffix, at 0.6 or
    more; else the entity stays unlinked if its confidence reaches keep_at.  Single-character persons drop out, other types pass.
    Core names meet library names by their first character, so the contains test runs on few pairs.
    """
    person = F.col("type") == "PER"
    rows = entities.where(~person | (F.length("text") > 1))
    exact = lookup_names(characters).groupBy("project", "key").agg(F.min(F.struct("priority", "id", "name")).alias("b"))
    rows = rows.join(exact.withColumnRenamed("key", "text"), ["project", "text"], "left")
    core = core_name(F.col("text"), kin) if kin else core_name(F.col("text"))
    rest = rows.where(person & F.col("b").isNull()).select("project", "text", core.alias("core")).distinct().where(F.length("core") >= 2).withColumn("c", F.substring("core", 1, 1))
    library = characters.select("project", "id", "name", F.explode(F.array_distinct(F.split("name", ""))).alias("c"))
    inside = rest.join(library, ["project", "c"]).where(F.contains("name", "core") | F.endswith(F.col("core"), F.col("name"))).groupBy("project", "text").agg(F.min(F.struct("id", "name")).alias("n"))
    same = rest.withColumnRenamed("core", "key").join(exact, ["project", "key"]).select("project", "text", F.struct("b.id", "b.name").alias("same"))
    rows = rows.join(inside, ["project", "text"], "left").join(same, ["project", "text"], "left").withColumn("n", F.coalesce("same", "n"))
    linked = person & (F.col("b").isNotNull() | F.col("n").isNotNull())
    confidence = F.when(person & F.col("b").isNotNull(), 1.0).when(person & F.col("n").isNotNull(), F.greatest("confidence", F.lit(0.6))).otherwise(F.col("confidence"))
    out = rows.where(~person | linked | (F.col("confidence") >= keep_at))
    return out.select("project", "text", "type", confidence.alias("confidence"), F.when(linked, F.coalesce("b.name", "n.name")).alias("standard_name"), F.coalesce(linked, F.lit(False)).alias("is_linked"))


def merge_characters(characters: DataFrame, sentences: DataFrame, mapping: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Merges secondary into primary characters, mapping (project, secondary, primary) by name.

    Aliases are united with the secondary's name, sentences are reassigned, secondaries go.
    """
    moved = characters.join(mapping.withColumnRenamed("secondary", "name"), ["project", "name"]).groupBy("project", "primary").agg(F.array_distinct(F.flatten(F.collect_list(F.concat(F.array("name"), "aliases")))).alias("_more"))
    kept = characters.join(mapping.select("project", F.col("secondary").alias("name")), ["project", "name"], "left_anti")
    kept = kept.join(moved.withColumnRenamed("primary", "name"), ["project", "name"], "left").withColumn("aliases", F.sort_array(F.array_union("aliases", F.coalesce("_more", F.array().cast("array<string>"))))).select(characters.columns)
    said = sentences.join(mapping.withColumnRenamed("secondary", "speaker"), ["project", "speaker"], "left").withColumn("speaker", F.coalesce("primary", "speaker")).select(sentences.columns)
    return kept, said


def find_or_create(wanted: DataFrame, characters: DataFrame, pack: Pack) -> DataFrame:
    """The library with a new row for every wanted (project, name, context) that no name or alias has."""
    new = wanted.join(all_names(characters), ["project", "name"], "left_anti").groupBy("project", "name").agg(F.concat_ws(" ", F.sort_array(F.collect_list("context"))).alias("context"))
    fresh = next_ids(characters, new, "id", ["project", "name"]).select("id", "project", "name", F.array().cast("array<string>").alias("aliases"), infer_gender(F.col("name"), F.col("context"), pack).alias("gender"), F.lit(None).cast("int").alias("first_appearance"), F.lit(False).alias("is_locked"))
    return characters.select(fresh.columns).unionByName(fresh)


def infer_gender(name: Column, context: Column, pack: Pack) -> Column:
    """Titles first (male, then female), then the majority of hints; a tie is unknown."""
    has = lambda words: F.exists(F.array(*(F.lit(w) for w in words)), lambda w: F.contains(name, w))
    count = lambda words: sum((F.contains(context, F.lit(w)).cast("int") for w in words), F.lit(0))
    male, female = count(pack.male_hints), count(pack.female_hints)
    return F.when(has(pack.male_titles), "male").when(has(pack.female_titles), "female").when(male > female, "male").when(female > male, "female").otherwise("unknown")


def frequencies(mentions: DataFrame, keys: list[str]) -> DataFrame:
    return mentions.groupBy(*keys).agg(F.count(F.lit(1)).alias("frequency"))


def eligible(names: DataFrame, freq: DataFrame, keys: list[str], least: int = ELIGIBLE_AT) -> DataFrame:
    """Adds frequency (0 if unseen) and eligible: never seen, or seen `least` times."""
    out = names.join(freq, keys, "left").withColumn("frequency", F.coalesce("frequency", F.lit(0)))
    return out.withColumn("eligible", (F.col("frequency") == 0) | (F.col("frequency") >= least))


def promotions(mentions: DataFrame, keys: list[str], order: list[str], at: int = PROMOTED_AT) -> DataFrame:
    """The mention with which a temporary character becomes permanent."""
    n = F.row_number().over(Window.partitionBy(*keys).orderBy(*order))
    return mentions.withColumn("n_mentions", n).where(F.col("n_mentions") == at)


def with_narrator(characters: DataFrame, name: str = "narrator") -> DataFrame:
    """The characters of every project with a narrator, whose id is -1."""
    narrator = characters.select("project").distinct().select(*(F.lit(-1).cast("long").alias(c) if c == "id" else F.lit(name).alias(c) if c == "name" else F.col(c) if c == "project" else F.lit(None).cast(characters.schema[c].dataType).alias(c) for c in characters.columns))
    return narrator.unionByName(characters)


def same_count(before: DataFrame, after: DataFrame) -> None:
    """Migration guard: raises if rows were lost or added."""
    a, b = before.count(), after.count()
    if a != b:
        raise ValueError(f"{a} rows became {b}")
