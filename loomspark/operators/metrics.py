"""Evaluation: accuracy, precision and recall, confusion, comparison of runs."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def ratio(a: Column, b: Column) -> Column:
    """a / b, 0 where b is."""
    return F.coalesce(F.try_divide(a.cast("double"), b.cast("double")), F.lit(0.0))


def accuracy(df: DataFrame, by: list[str], gold: str = "gold", predicted: str = "predicted", unknown: str = "unknown") -> DataFrame:
    ok = F.col(gold) == F.col(predicted)
    return df.groupBy(*by).agg(F.count(F.lit(1)).alias("total"), F.count_if(ok).alias("correct"), ratio(F.count_if(ok), F.count(F.lit(1))).alias("accuracy"), ratio(F.count_if(F.col(predicted).isNull() | (F.col(predicted) == unknown)), F.count(F.lit(1))).alias("unknown_rate"))


def rolled_up(df: DataFrame, sets: list[list[str]], gold: str = "gold", predicted: str = "predicted") -> DataFrame:
    """Accuracy over several groupings in one pass (grouping sets)."""
    cols = list(dict.fromkeys(c for s in sets for c in s))
    ok = F.col(gold) == F.col(predicted)
    return df.groupingSets([[F.col(c) for c in s] for s in sets], *[F.col(c) for c in cols]).agg(F.count(F.lit(1)).alias("total"), F.count_if(ok).alias("correct"))


def precision_recall(df: DataFrame, gold: str = "gold", predicted: str = "predicted") -> DataFrame:
    """(class, correct, predicted, actual, precision, recall, f1).  One pass: each row counts for its gold and its predicted class."""
    sides = df.select(F.explode(F.array(F.struct(F.col(gold).alias("class"), F.lit(1).alias("a"), F.lit(0).alias("p"), (F.col(gold) == F.col(predicted)).cast("int").alias("c")), F.struct(F.col(predicted).alias("class"), F.lit(0).alias("a"), F.lit(1).alias("p"), F.lit(0).alias("c")))).alias("x"))
    counted = sides.where(F.col("x.class").isNotNull()).groupBy(F.col("x.class").alias("class")).agg(F.sum("x.c").alias("correct"), F.sum("x.p").alias("predicted"), F.sum("x.a").alias("actual"))
    p, r = ratio(F.col("correct"), F.col("predicted")), ratio(F.col("correct"), F.col("actual"))
    return counted.withColumn("precision", p).withColumn("recall", r).withColumn("f1", ratio(2 * F.col("precision") * F.col("recall"), F.col("precision") + F.col("recall")))


def confusion(df: DataFrame, classes: list, gold: str = "gold", predicted: str = "predicted") -> DataFrame:
    """One row per gold class, one column per predicted class (given, so no job looks for them)."""
    return df.groupBy(gold).pivot(predicted, classes).agg(F.count(F.lit(1))).na.fill(0)


def compare_modes(a: DataFrame, b: DataFrame, names: tuple[str, str], gold: str = "gold", predicted: str = "predicted") -> DataFrame:
    both = a.withColumn("mode", F.lit(names[0])).unionByName(b.withColumn("mode", F.lit(names[1])))
    return accuracy(both, ["mode"], gold, predicted)


def run_diff(before: DataFrame, after: DataFrame, key: str, correct: str = "correct") -> DataFrame:
    """Cases newly broken, newly fixed, added or removed between two runs."""
    x = before.select(key, F.col(correct).alias("was")).join(after.select(key, F.col(correct).alias("now")), key, "full_outer")
    kind = F.when(F.col("was").isNull(), "added").when(F.col("now").isNull(), "removed").when(F.col("was") & ~F.col("now"), "broken").when(~F.col("was") & F.col("now"), "fixed")
    return x.withColumn("change", kind).where(F.col("change").isNotNull())


def run_stats(df: DataFrame, by: list[str], value: str) -> DataFrame:
    return df.groupBy(*by).agg(F.count(value).alias("runs"), F.avg(value).alias("mean"), F.median(value).alias("median"), F.min(value).alias("least"), F.max(value).alias("most"), F.stddev_samp(value).alias("deviation"))


def grid_search(df: DataFrame, grid: dict[str, list[float]], predict: Column, gold: str = "gold", top: int = 20) -> DataFrame:
    """Accuracy of a rule under every combination of parameters, the best first.

    The grid is exploded beside each row inside the task that reads it, and combined before the shuffle: rows shuffled
    are the combinations, not the data.
    """
    params = reduce(lambda acc, k: F.flatten(F.transform(acc, lambda s: F.transform(F.array(*(F.lit(float(v)) for v in grid[k])), lambda v: F.concat(s, F.array(v))))), grid, F.array(F.array().cast("array<double>")))
    rows = df.withColumn("_p", F.explode(params))
    rows = rows.withColumns({k: F.col("_p")[i] for i, k in enumerate(grid)})
    scored = rows.groupBy(*grid).agg(F.count(F.lit(1)).alias("total"), F.count_if(predict == F.col(gold)).alias("correct"))
    return scored.withColumn("accuracy", ratio(F.col("correct"), F.col("total"))).orderBy(F.desc("accuracy"), *grid).limit(top)


def scorecard(df: DataFrame, weights: dict[str, float], penalty: str | None = None, floor: float = -30.0) -> DataFrame:
    """Weighted score of 0..1 parts out of 100, penalties (not below the floor) and a grade."""
    total = sum((F.col(k) * w for k, w in weights.items()), F.lit(0.0)) * 100
    if penalty:
        total = total + F.greatest(F.col(penalty), F.lit(floor))
    total = F.greatest(total, F.lit(0.0))
    return df.withColumn("score", total).withColumn("grade", F.when(total >= 90, "A").when(total >= 80, "B").when(total >= 70, "C").when(total >= 60, "D").otherwise("F"))


def speed_score(chars_per_second: Column) -> Column:
    """Step function of throughput; fixed values."""
    c = chars_per_second
    return F.when(c >= 10000, 1.0).when(c >= 5000, 0.9).when(c >= 1000, 0.8).when(c >= 500, 0.7).when(c >= 100, 0.6).otherwise(0.5)


def error_breakdown(df: DataFrame, by: list[str], gold: str = "gold", predicted: str = "predicted") -> DataFrame:
    """Errors and their share of each group's cases and of all errors."""
    wrong = F.col(predicted).isNull() | (F.col(gold) != F.col(predicted))
    out = df.groupBy(*by).agg(F.count(F.lit(1)).alias("cases"), F.count_if(wrong).alias("errors"))
    return out.withColumn("error_rate", ratio(F.col("errors"), F.col("cases"))).withColumn("share", ratio(F.col("errors"), F.sum("errors").over(Window.partitionBy())))


def agreement(a: DataFrame, b: DataFrame, key: str, label: str) -> DataFrame:
    """Shared cases, equal labels and their rate for two annotations."""
    x = a.select(key, F.col(label).alias("x")).join(b.select(key, F.col(label).alias("y")), key)
    return x.agg(F.count(F.lit(1)).alias("shared"), F.count_if(F.col("x") == F.col("y")).alias("equal"), ratio(F.count_if(F.col("x") == F.col("y")), F.count(F.lit(1))).alias("rate"))


def difficulty(text: Column, tiers: list[tuple[str, str]], default: str = "other") -> Column:
    """The first tier whose pattern a case's text matches."""
    return F.coalesce(*(F.when(text.rlike(p), F.lit(name)) for name, p in tiers), F.lit(default))
