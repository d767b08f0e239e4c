"""Mixing sources to target weights with DataFrame functions only.

Targets: every source gets its weight's share of the wanted words, at most `cap` times its own size; what is over
is shared again by weight among the others (the water level is found from running sums over the sources).

Drawing: a document's hash puts it into one of its source's blocks.  A source is taken whole as often as fits its
target; of the rest, blocks are taken in a hashed order up to the target.  These blocks are exact quotas.
A splitting tree deals them to the output shards: at each node a random half of the node's block draws goes left,
so that the halves' source counts follow the multivariate hypergeometric distribution, down to the shards, whose
draws are disjoint.  The block in which a source reaches its target is split again by the same hash, and the
last part document by document: each that still fits, in the order of TRIES that leaves
least over.  Inside a shard rows get a hashed order.

Everything beyond the documents themselves is bounded: blocks by BLOCKS plus one for each source, the last part
by about 2 * LAST documents of each source.  No source is gathered in one task.

Cases: null text has size 0; null is a source of its own, last in order; rows with equal hashes (repeated rows)
share their fate; a source without words has target 0; an empty table gives an empty result; other columns are
kept, and those this operator adds replace columns of the same name.  A text of any length counts whole; one longer than what
its source has left is not drawn, and in a source of few documents that can leave up to its size unfilled.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loomspark.llm.exchange import kept

BLOCKS = 1 << 17
BLOCK_ROWS = 256
LAST = 512
TRIES = 24
SHARD_WORDS = 8_000_000
MOST_DEPTH = 17  # shards beyond the number of blocks would be empty
FEW_SOURCES = 50_000
ADDED = ("size", "source_size", "target", "taken", "copies")
_WORD = r"[^\x20\x09-\x0D]+"


def word_count(text: str) -> Column:
    return F.coalesce(F.regexp_count(F.col(text), F.lit(_WORD)), F.lit(0)).cast("long")


def source_targets(sizes: DataFrame, weights: tuple[float, ...], factor: float, cap: float) -> DataFrame:
    """(source, source_size, n) -> and weight, target.  One row per source; the windows run over these rows only."""
    ranked = sizes.withColumn("rank", F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1)
    weight = F.element_at(F.array(*(F.lit(float(w)) for w in weights)), (F.pmod(F.col("rank"), F.lit(len(weights))) + 1).cast("int"))
    every = Window.partitionBy()
    rows = ranked.withColumn("weight", weight).withColumn("most", cap * F.col("source_size")).withColumn("wanted", factor * F.sum("source_size").over(every))
    below = Window.orderBy(F.col("most") / F.col("weight"), "rank").rowsBetween(Window.unboundedPreceding, -1)
    rows = rows.withColumn("level", (F.col("wanted") - F.coalesce(F.sum("most").over(below), F.lit(0.0))) / (F.sum("weight").over(every) - F.coalesce(F.sum("weight").over(below), F.lit(0.0))))
    rows = rows.withColumn("full", F.col("level") >= F.col("most") / F.col("weight"))
    open_weight = F.sum(F.when(~F.col("full"), F.col("weight"))).over(every)
    level = (F.col("wanted") - F.sum(F.when(F.col("full"), F.col("most")).otherwise(0.0)).over(every)) / open_weight
    return rows.withColumn("target", F.when(F.col("full"), F.col("most")).otherwise(F.least("most", F.col("weight") * level))).drop("rank", "most", "wanted", "level", "full")


def splitting_tree(draws: DataFrame, depth: int, seed: int) -> DataFrame:
    """Deals the rows (source, block, copy), one per block draw, to 2**depth shards."""
    rows = draws.withColumn("node", F.lit(0))
    for level in range(depth):
        node = Window.partitionBy("node")
        place = F.row_number().over(node.orderBy(F.xxhash64("source", "block", "copy", F.lit(seed + level)), "source", "block", "copy"))
        odd = F.pmod(F.col("node"), F.lit(2))  # odd counts alternate which half is larger
        rows = rows.withColumn("place", place).withColumn("size", F.count(F.lit(1)).over(node))
        rows = rows.withColumn("node", F.col("node") * 2 + (F.col("place") > F.floor((F.col("size") + odd) / 2)).cast("int")).drop("place", "size")
    return rows.withColumnRenamed("node", "shard")


def _reached(order: Column, words: str, rest: str, keys: list[str]) -> tuple[Column, Column]:
    """Words before a row in the hashed order of its group, and whether the group reaches `rest` inside this row."""
    before = F.coalesce(F.sum(words).over(Window.partitionBy(*keys).orderBy(order, *keys).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    return before, (before < F.col(rest)) & (before + F.col(words) > F.col(rest))


def mix_sources(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", weights: tuple[float, ...] = (5, 2, 1), factor: float = 1.5, cap: float = 2.0, depth: int | None = None, seed: int = 17, texts: bool = True) -> DataFrame:
    """Adds size, source_size, target, taken and copies (shard and order of each draw) to every document.

    texts: keep all columns; otherwise only the id and what is added, and the texts are read once.
    depth: of the splitting tree; by default such that a shard has about SHARD_WORDS words, or a 131072th of the mix if that is more.
    """
    clean = docs.drop(*(c for c in ADDED if c in docs.columns and c not in (id_col, text_col, source_col)))
    full = clean.withColumn("_size", word_count(text_col)).withColumn("_source", F.col(source_col)).withColumn("_hash", F.xxhash64(F.col(id_col), F.col(source_col), F.xxhash64(text_col), F.lit(seed)))
    slim = kept(full.select(F.col(id_col), "_size", "_source", "_hash"), "mixing")
    d = slim.select(F.col("_source").alias("source"), F.col("_size").alias("size"), F.col("_hash").alias("hash"))

    sizes = d.groupBy("source").agg(F.sum("size").alias("source_size"), F.count(F.lit(1)).alias("n"))
    rows_of = F.greatest(F.lit(BLOCK_ROWS), F.sum("n").over(Window.partitionBy()) / BLOCKS)
    plan = source_targets(sizes, weights, factor, cap).withColumn("blocks", F.greatest(F.lit(1), F.floor(F.col("n") / rows_of)).cast("long"))
    whole = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0).cast("int")
    plan = plan.withColumn("whole", whole).withColumn("rest", F.col("target") - F.col("whole") * F.col("source_size"))
    plan = kept(plan.select("source", "source_size", "target", "blocks", "whole", "rest"), "mixing")
    few = plan.limit(FEW_SOURCES + 1).count() <= FEW_SOURCES
    small = F.broadcast if few else (lambda x: x)  # rows are bounded by FEW_SOURCES and BLOCKS only then

    if depth is None:
        wanted = plan.agg(F.sum("target")).first()[0] or 0
        depth = min(MOST_DEPTH, max(4, int(wanted / SHARD_WORDS).bit_length()))

    block = F.pmod(F.col("hash"), F.col("blocks"))
    dealt = d.join(small(plan.select("source", "blocks", "whole", "rest").withColumnRenamed("source", "s")), F.col("source").eqNullSafe(F.col("s"))).drop("s").withColumn("block", block)
    by_block = dealt.groupBy("source", "block").agg(F.sum("size").alias("words"), F.count(F.lit(1)).alias("rows"), F.first("whole").alias("whole"), F.first("rest").alias("rest"))
    before, reached = _reached(F.xxhash64("block", F.lit(seed)), "words", "rest", ["source", "block"][:1])
    by_block = by_block.withColumn("before", before).withColumn("last", reached)
    by_block = kept(by_block.withColumn("times", F.col("whole") + (~F.col("last") & (F.col("before") + F.col("words") <= F.col("rest")) & (F.col("words") > 0)).cast("int")), "mixing")

    draws = by_block.where("times > 0").select("source", "block", F.explode(F.sequence(F.lit(1), F.col("times"))).alias("copy"))
    shards = splitting_tree(draws, depth, seed).groupBy("source", "block").agg(F.sort_array(F.collect_list("shard")).alias("shards"))

    # The block in which a source reaches its target: split by the hash's other digits, then document by document.
    parts = F.greatest(F.lit(1), F.floor(F.col("rows") / LAST)).cast("long")
    last = by_block.where("last").select(F.col("source").alias("s"), F.col("block").alias("b"), (F.col("rest") - F.col("before")).alias("left"), parts.alias("parts"))
    part = F.pmod(F.shiftright(F.xxhash64("hash"), 8), F.col("parts"))
    inside = dealt.select("source", "block", "hash", "size").join(small(last), F.col("source").eqNullSafe(F.col("s")) & (F.col("block") == F.col("b"))).withColumn("part", part)
    items = inside.groupBy("source", "block", "parts", "left", "part", "hash").agg(F.sum("size").alias("words"))
    by_part = items.groupBy("source", "block", "parts", "left", "part").agg(F.sum("words").alias("words"), F.sort_array(F.collect_list(F.struct("hash", "words"))).alias("items"))
    before, reached = _reached(F.col("part"), "words", "left", ["source"])
    by_part = by_part.withColumn("before", before).withColumn("last", reached)
    empty = F.array().cast("array<bigint>")

    def fill(n: Column) -> Column:
        """What fits in the n-th order: the largest first, then hashed orders."""
        ordered = F.sort_array(F.transform("items", lambda x: F.struct(F.when(n == 0, -x["words"]).otherwise(F.xxhash64(x["hash"], n)).alias("key"), x["hash"].alias("hash"), x["words"].alias("words"))))
        start = F.struct((F.col("left") - F.col("before")).alias("room"), empty.alias("hashes"))
        return F.aggregate(ordered, start, lambda acc, x: F.when((x["words"] > 0) & (x["words"] <= acc["room"]), F.struct((acc["room"] - x["words"]).alias("room"), F.array_append(acc["hashes"], x["hash"]).alias("hashes"))).otherwise(acc))

    fits = F.array_min(F.transform(F.sequence(F.lit(0), F.lit(TRIES - 1)), fill))["hashes"]
    taken_part = ~F.col("last") & (F.col("before") + F.col("words") <= F.col("left"))
    ends = by_part.groupBy("source", "block", "parts").agg(F.collect_list(F.when(taken_part, F.col("part"))).alias("taken_parts"), F.flatten(F.collect_list(F.when(F.col("last"), fits))).alias("taken_hashes"))
    keys = lambda x, t: x["source"].eqNullSafe(t["source"]) & (x["block"] == t["block"])
    orders = by_block.select("source", "block").alias("o")
    orders = orders.join(shards.alias("t"), keys(by_block, shards), "left").select("o.*", "t.shards").alias("o")
    orders = orders.join(ends.alias("e"), F.col("o.source").eqNullSafe(F.col("e.source")) & (F.col("o.block") == F.col("e.block")), "left")
    orders = kept(orders.select(F.col("o.source").alias("s"), F.col("o.block").alias("b"), "shards", "parts", "taken_parts", "taken_hashes"), "mixing")

    rows = (full if texts else slim).join(small(plan.select(F.col("source").alias("_s"), F.col("source_size").alias("_source_size"), F.col("target").alias("_target"), F.col("blocks").alias("_blocks"))), F.col("_source").eqNullSafe(F.col("_s")))
    rows = rows.withColumn("_block", F.pmod(F.col("_hash"), F.col("_blocks")))
    rows = rows.join(small(orders), F.col("_source").eqNullSafe(F.col("s")) & (F.col("_block") == F.col("b")))
    more = F.array_contains("taken_parts", F.pmod(F.shiftright(F.xxhash64("_hash"), 8), F.col("parts"))) | F.array_contains("taken_hashes", F.col("_hash"))
    own = F.pmod(F.xxhash64("_hash", F.lit(seed)), F.lit(1 << depth)).cast("int")
    all_shards = F.concat(F.coalesce("shards", F.array().cast("array<int>")), F.when(F.coalesce(more, F.lit(False)) & (F.col("_size") > 0), F.array(own)).otherwise(F.array().cast("array<int>")))
    copies = F.transform(all_shards, lambda shard, i: F.struct(shard.alias("shard"), F.xxhash64("_hash", shard, i, F.lit(seed)).alias("order")))
    out = rows.withColumn("_copies", copies).withColumn("_taken", F.col("_size") * F.size("_copies"))
    first = [c for c in clean.columns] if texts else [id_col]
    return out.select(*first, *(F.col(f"_{c}").alias(c) for c in ADDED if c not in first))


def mixed_rows(mixed: DataFrame, columns: list[str]) -> DataFrame:
    """The mix itself: one row for each draw, dealt by shard and in the shard's own order."""
    rows = mixed.select(*columns, F.explode("copies").alias("_at"))
    return rows.repartition("_at.shard").sortWithinPartitions("_at.shard", "_at.order").select(*columns)
