"""Filter interaction audit: what each filter removes in every order of the filters, from one CUBE.

A document's failures are five flags.  Documents are counted by part, flags and labels; a CUBE over the flags and the part then
holds, for every subset of the filters, the documents that fail none of it: the rows of a grouping set whose selected flags are all
false.  A step of an order turns one subset into the next, so what it keeps and removes comes from joining two subsets'
survivors; nothing is counted again for the 120 orders.

A group of copies, or a part, may hold most rows: documents are counted by text digest, part and labels before copies meet, and by
cell before the CUBE.  The only rows that move once per document are those that meet the labels (an id, a digest, four flags).

Cases: a null text is empty and a null part the empty string; a null id is no one's original and never a copy; rows that repeat an id are
counted one by one, and those with the least id of their text all pass E; of a document's labels one that says 1 is enough; a tie with a
threshold is no failure (50 words, 65 % distinct, 5 % capitals); texts of any length count whole; an empty table has no parts and gives no rows;
columns beyond the id, text and part are ignored.
"""

from __future__ import annotations

from itertools import permutations
from math import factorial

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

SPACES = "[\\x20\\x09-\\x0D]+"
CAPITALS = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
MIN_WORDS, DISTINCT_PERCENT, CAPITAL_PERCENT = 50, 65, 5
FILTERS = "ABCDE"
WHOLE = (1 << len(FILTERS)) - 1


def text_failures(text: Column) -> dict[str, Column]:
    """The four conditions that look at a document's own text."""
    words = F.filter(F.split(text, SPACES), lambda w: w != "")
    capitals = F.length(text) - F.length(F.translate(text, CAPITALS, ""))
    return {
        "A": F.size(words) < MIN_WORDS,
        "B": 100 * F.size(F.array_distinct(words)) < DISTINCT_PERCENT * F.size(words),
        "C": 100 * capitals > CAPITAL_PERCENT * F.length(text),
        "D": text.rlike("[#$%&*|]"),
    }


def failure_cells(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", part_col: str = "source") -> DataFrame:
    """(part, A to E, good, toxic, n): documents counted by part, failures and labels."""
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.coalesce(F.col(part_col).cast("string"), F.lit("")).alias("part"), F.unhex(F.sha2(text, 256)).alias("digest"), *(c.alias(k) for k, c in text_failures(text).items()))
    rows = rows.withColumn("salt", F.when(F.col("id").isNull(), F.xxhash64("digest")).otherwise(F.lit(0).cast("long")))  # else all null ids meet in one task
    said = labels.where(F.col(id_col).isNotNull()).groupBy(F.col(id_col).cast("long").alias("id")).agg(F.max(F.col("quality") == 1).alias("good"), F.max(F.col("toxic") == 1).alias("toxic"))
    rows = rows.join(said.withColumn("salt", F.lit(0).cast("long")), ["id", "salt"], "left").fillna(False, ["good", "toxic"])
    cell = ["part", "A", "B", "C", "D", "good", "toxic"]
    by_id = rows.groupBy("id", "salt", "digest", *cell).agg(F.count(F.lit(1)).alias("n"))  # for repeated rows; they lie together since the join
    by_text = by_id.groupBy("digest", *cell).agg(F.sum("n").alias("n"), F.min(F.when(F.col("id").isNotNull(), F.struct("id", "n"))).alias("first"), F.sum(F.when(F.col("id").isNull(), F.col("n")).otherwise(0)).alias("nameless"))
    least = F.min("first.id").over(Window.partitionBy("digest"))  # of a text's few cells, not of its copies
    by_text = by_text.withColumn("least", least).withColumn("fine", F.col("nameless") + F.when(F.col("first.id") == F.col("least"), F.col("first.n")).otherwise(0))
    both = by_text.select(*cell, F.explode(F.array(F.struct(F.lit(False).alias("E"), F.col("fine").alias("n")), F.struct(F.lit(True).alias("E"), (F.col("n") - F.col("fine")).alias("n")))).alias("x"))
    return both.select(*cell, "x.E", "x.n").where("n > 0").groupBy("part", *FILTERS, "good", "toxic").agg(F.sum("n").alias("n"))


def subset_survivors(cells: DataFrame) -> DataFrame:
    """(part, subset, n, good, toxic): for every subset of the filters (a bit each) the documents that fail none of it, where there are any; part null: the whole table."""
    counts = cells.cube("part", *FILTERS).agg(
        F.grouping("part").alias("all_parts"),
        sum(((1 - F.grouping(f).cast("int")) * (1 << i) for i, f in enumerate(FILTERS)), F.lit(0)).alias("subset"),
        F.sum("n").alias("n"), F.sum(F.when(F.col("good"), F.col("n")).otherwise(0)).alias("good"), F.sum(F.when(F.col("toxic"), F.col("n")).otherwise(0)).alias("toxic"),
    )
    passed = ~F.greatest(*(F.coalesce(F.col(f), F.lit(False)) for f in FILTERS))  # a flag that isn't selected is null
    return counts.where(passed).select(F.when(F.col("all_parts") == 0, F.col("part")).alias("part"), "subset", "n", "good", "toxic")


def orders(docs: DataFrame) -> DataFrame:
    """(filter_order, step, f, before): the 600 steps of the 120 orders."""
    rows = []
    for p in permutations(range(len(FILTERS))):
        before = 0
        for step, f in enumerate(p, 1):
            rows.append(f"('{''.join(FILTERS[i] for i in p)}', {step}, {f}, {before})")
            before |= 1 << f
    return docs.sparkSession.sql(f"SELECT * FROM VALUES {', '.join(rows)} AS t(filter_order, step, f, before)")


def filter_audit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", part_col: str = "source") -> DataFrame:
    """One row per part, order and step, zeros included: kept, removed, redundant, unique_fails, good_lost, toxic_lost, shapley."""
    left = subset_survivors(failure_cells(docs, labels, id_col, text_col, part_col)).where("part is not null")
    pairs = [(f, s) for f in range(len(FILTERS)) for s in range(WHOLE + 1) if not s >> f & 1]
    pair = F.explode(F.array(*(F.struct(F.lit(f).alias("f"), F.lit(s).alias("before"), F.lit(s | 1 << f).alias("after"), F.lit(factorial(k := s.bit_count()) * factorial(len(FILTERS) - 1 - k)).alias("weight")) for f, s in pairs)))
    steps = left.where("subset = 0").select("part", pair.alias("x")).select("part", "x.*")  # every part has rows, so it has survivors of the empty subset
    for end in ("before", "after"):
        steps = steps.join(left.select("part", F.col("subset").alias(end), *(F.col(c).alias(f"{c}_{end}") for c in ("n", "good", "toxic"))), ["part", end], "left")
    steps = steps.fillna(0)
    lost = {name: F.col(f"{c}_before") - F.col(f"{c}_after") for name, c in (("removed", "n"), ("good_lost", "good"), ("toxic_lost", "toxic"))}
    steps = steps.select("part", "f", "before", "weight", F.col("n_after").alias("kept"), *(c.alias(k) for k, c in lost.items()))
    filter_of_part = Window.partitionBy("part", "f")  # a row for each subset without f
    fails = F.max(F.when(F.col("before") == 0, F.col("removed"))).over(filter_of_part)
    alone = F.max(F.when(F.col("before") == F.expr(f"{WHOLE} - shiftleft(1, f)"), F.col("removed"))).over(filter_of_part)
    steps = steps.withColumns({"redundant": fails - F.col("removed"), "unique_fails": alone, "shapley": F.sum(F.col("removed") * F.col("weight")).over(filter_of_part)})
    return steps.join(F.broadcast(orders(docs)), ["f", "before"]).select("part", "filter_order", "step", *(F.col(c).cast("long").alias(c) for c in ("kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley")))
