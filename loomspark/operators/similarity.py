"""Vectors: ranking, centroids and leader clustering."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from loomspark.functions.vectors import characters, cosine, jaccard, norm

#: Queries, and items, of one matrix product.
BLOCK, CHUNK = 2048, 512


def rank_by_similarity(queries: DataFrame, items: DataFrame, id_col: str, vector_col: str, top: int | None = None, threshold: float = 0.7, most_queries: int = 10_000) -> DataFrame:
    """(query_id, id, similarity, rank) of the items with at least the threshold (and the top of them) for each query.

    Up to `most_queries` queries go to every block of items, whose similarities are matrix products of a fixed size.
    More are dealt into blocks, as are the items, and each block of the one meets each of the other by equal numbers.
    Only hits are ranked: with top, those that a task's own best leave open.
    """
    q = queries.select(F.col(id_col).alias("query_id"), F.col(vector_col).alias("v"))
    x = items.select(F.col(id_col).alias("id"), F.col(vector_col).alias("v"))
    few = q.limit(most_queries + 1).collect()
    schema = "query_id long, id long, similarity double"

    def unit(vectors: list) -> np.ndarray:
        mat = np.array(vectors, np.float64).reshape(len(vectors), -1)
        return mat / np.maximum(np.sqrt((mat * mat).sum(1, keepdims=True)), 1e-300)

    def hits_of(ids: np.ndarray, mat: np.ndarray, pdf: pd.DataFrame, floor: np.ndarray) -> Iterator[pd.DataFrame]:
        """Hits of CHUNK items and BLOCK queries at a time; floor holds what each query's best so far leave open and is raised in place."""
        every = pdf.id.to_numpy()
        for at in range(0, len(pdf) if len(ids) else 0, CHUNK):
            own = every[at : at + CHUNK]
            x = np.array([np.zeros(mat.shape[1]) if v is None else np.asarray(v, np.float64) for v in pdf.v.iloc[at : at + CHUNK]])
            size = np.sqrt((x * x).sum(1, keepdims=True))
            x = np.divide(x, size, out=np.zeros_like(x), where=size > 0)
            for s in range(0, len(ids), BLOCK):
                sim = x @ mat[s : s + BLOCK].T
                sim[np.isnan(sim) | (own[:, None] == ids[None, s : s + BLOCK])] = -np.inf
                if top is not None and len(own) > top:  # ranks go by six digits, so what is as near as that stays open
                    low = floor[s : s + BLOCK]
                    np.maximum(low, np.partition(sim, len(own) - top, axis=0)[len(own) - top] - 2e-6, out=low)
                i, j = np.nonzero(sim >= floor[s : s + BLOCK])
                if top is not None and len(i):  # of equal ones a query's first are enough
                    level = np.round(sim[i, j], 6)
                    order = np.lexsort((own[i], -level, j))
                    i, j, level = i[order], j[order], level[order]
                    begins = np.r_[True, (j[1:] != j[:-1]) | (level[1:] != level[:-1])]
                    nth = np.arange(len(j)) - np.maximum.accumulate(np.where(begins, np.arange(len(j)), 0))
                    i, j = i[nth < top], j[nth < top]
                if len(i):
                    yield pd.DataFrame({"query_id": ids[s + j], "id": own[i], "similarity": sim[i, j]})

    if len(few) <= most_queries:
        ids, mat = np.array([r.query_id for r in few]), unit([r.v for r in few])

        def score(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            floor = np.full(len(ids), threshold, np.float64)
            for pdf in batches:
                yield from hits_of(ids, mat, pdf, floor)

        hits = x.mapInPandas(score, schema)
    else:

        def meet(some: pd.DataFrame, pdf: pd.DataFrame) -> pd.DataFrame:
            none = pd.DataFrame({"query_id": np.zeros(0, np.int64), "id": np.zeros(0, np.int64), "similarity": np.zeros(0)})
            found = hits_of(some.query_id.to_numpy(), unit(some.v.tolist()), pdf, np.full(len(some), threshold, np.float64)) if len(some) else ()
            return pd.concat([none, *found])

        n_q, n_x = max(1, -(-q.count() // (4 * BLOCK))), max(1, -(-x.count() // (16 * BLOCK)))
        dealt = lambda df, c, own, n, other, m: df.withColumn(own, F.pmod(F.xxhash64(c), F.lit(n))).withColumn(other, F.explode(F.sequence(F.lit(0), F.lit(m - 1)).cast("array<bigint>")))
        q_blocks, x_blocks = dealt(q, "query_id", "_q", n_q, "_x", n_x), dealt(x, "id", "_x", n_x, "_q", n_q)
        hits = q_blocks.groupBy("_q", "_x").cogroup(x_blocks.groupBy("_q", "_x")).applyInPandas(meet, schema)
    hits = hits.where("query_id <> id")
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc(F.round("similarity", 6)), "id"))
    out = hits.withColumn("rank", rank)
    return out if top is None else out.where(F.col("rank") <= top)


def pair_similarity(pairs: DataFrame, a: str, b: str) -> DataFrame:
    return pairs.withColumn("similarity", cosine(F.col(a), F.col(b)))


def centroids(df: DataFrame, keys: list[str], vector_col: str, normalise: bool = True) -> DataFrame:
    """Mean vector of every group, at length 1 if asked.  Dimensions are averaged on their own keys, so no group is gathered."""
    dims = df.select(*keys, F.posexplode(vector_col).alias("dim", "x")).groupBy(*keys, "dim").agg(F.avg("x").alias("x"))
    mean = dims.groupBy(*keys).agg(F.transform(F.sort_array(F.collect_list(F.struct("dim", "x"))), lambda s: s["x"]).alias("centroid"))
    if not normalise:
        return mean
    n = norm(F.col("centroid"))
    return mean.withColumn("centroid", F.when(n > 0, F.transform("centroid", lambda x: x / n)).otherwise(F.col("centroid")))


def character_overlap(pairs: DataFrame, a: str, b: str) -> DataFrame:
    """Adds the Jaccard similarity of two texts' characters."""
    return pairs.withColumn("overlap", jaccard(characters(F.col(a)), characters(F.col(b))))


def _take(r: int, sims: np.ndarray, at: np.ndarray, best: np.ndarray, second: np.ndarray, leader: np.ndarray) -> None:
    """Raises a row's two highest similarities by those of further leaders; of equal ones the first stays."""
    i = int(sims.argmax())
    top = sims[i]
    rest = max(sims[:i].max(initial=-np.inf), sims[i + 1 :].max(initial=-np.inf))
    if top > best[r]:
        best[r], second[r], leader[r] = top, max(best[r], rest), at[i]
    else:
        second[r] = max(second[r], top)


def leader_clusters(entities: DataFrame, by: list[str], similar: float = 0.85, sure: float = 0.95, overlap: float = 0.3, margin: float = 0.02) -> DataFrame:
    """Greedy clusters of (by, name, n, vector): by frequency each joins the best leader or becomes one.

    It joins at `similar` if it is also `sure` or shares `overlap` of its characters, unless two leaders are within the margin.
    The pass depends on order, so each project is one task; its distinct entities bound it.  Entities meet the leaders before them as
    matrix products of a fixed size, so memory follows the vectors and time the entities times the leaders.
    """
    fields = {f.name: f.dataType.simpleString() for f in entities.schema}
    schema = ", ".join([f"{k} {fields[k]}" for k in by] + ["name string", "leader string", "similarity double"])

    def one(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["n", "name"], ascending=[False, True])
        names = pdf["name"].tolist()
        width = max((len(v) for v in pdf["vector"] if v is not None), default=0)
        x = np.array([np.zeros(width) if v is None else np.asarray(v, np.float64) for v in pdf["vector"]]).reshape(len(names), width)
        size = np.linalg.norm(x, axis=1, keepdims=True)
        x /= np.where(size > 0, size, 1)
        leaders: list[int] = []
        out: list[tuple[str, float]] = []
        for at in range(0, len(names), CHUNK):
            own = x[at : at + CHUNK]
            best, second, leader = np.full(len(own), -np.inf), np.full(len(own), -np.inf), np.full(len(own), -1)
            for s in range(0, len(leaders), BLOCK):  # the leaders of earlier chunks, in order
                some = np.array(leaders[s : s + BLOCK])
                sim = own @ x[some].T
                near = sim >= similar - 1e-9
                for r in np.nonzero(near.any(1))[0]:
                    j = np.nonzero(near[r])[0]
                    _take(r, np.round(sim[r, j], 10), some[j], best, second, leader)
            inner = np.round(own @ own.T, 10)
            fresh: list[int] = []
            for r in range(len(own)):
                if fresh:
                    _take(r, inner[r, fresh], np.array(fresh) + at, best, second, leader)
                name, found = names[at + r], None
                if best[r] >= similar:
                    lead = names[leader[r]]
                    close = best[r] >= sure or len(set(name) & set(lead)) / max(1, len(set(name) | set(lead))) >= overlap
                    if close and not (second[r] >= similar and best[r] - second[r] < margin):
                        found = (lead, float(best[r]))
                if found is None:
                    fresh.append(r)
                out.append(found or (name, 1.0))
            leaders += [at + r for r in fresh]
        head = pdf[by].reset_index(drop=True)
        return pd.concat([head, pd.DataFrame({"name": names, "leader": [x[0] for x in out], "similarity": [x[1] for x in out]})], axis=1)

    return entities.groupBy(*by).applyInPandas(one, schema)


def gated(entities: DataFrame, texts: DataFrame, by: list[str], least: int = 3, frequent: int = 3, length: int = 3000) -> DataFrame:
    """Entities of projects that have enough frequent ones and enough text; the others are only linked."""
    many = entities.where(F.col("n") >= frequent).groupBy(*by).agg(F.count_distinct("name").alias("k")).where(F.col("k") >= least)
    long = texts.groupBy(*by).agg(F.sum(F.length("text")).alias("c")).where(F.col("c") >= length)
    return entities.join(many.select(*by), by, "left_semi").join(long.select(*by), by, "left_semi")


def relabel(entities: DataFrame, clusters: DataFrame, by: list[str]) -> DataFrame:
    """Entities under their leader's name, at 0.7 or more where that changes it."""
    out = entities.join(clusters.select(*by, "name", "leader"), [*by, "name"], "left")
    moved = F.col("leader").isNotNull() & (F.col("leader") != F.col("name"))
    return out.withColumn("confidence", F.when(moved, F.greatest("confidence", F.lit(0.7))).otherwise(F.col("confidence"))).withColumn("name", F.coalesce("leader", "name")).select(entities.columns)
