"""Retrieval over stored vectors: scores, top-k, best per group, centroids, merging, and upkeep of the table.

Scores are exact.  A search ranks with a bounded heap per task (take-ordered), so only k rows per
task reach the driver side of the plan; filters run on promoted columns before any score is made.
"""

from __future__ import annotations

from collections.abc import Sequence
from typing import Any

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from millrace.functions.scalars import cut_text
from millrace.operators.sliced import with_position


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def norm(a: Column) -> Column:
    return F.sqrt(F.aggregate(a, F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double")))


def cosine(a: Column, b: Column) -> Column:
    """Cosine similarity; null if a side is null, of another length or all zero."""
    both = norm(a) * norm(b)
    return F.when((F.size(a) == F.size(b)) & (both > 0), dot(a, b) / both)


def literal_vector(vector: Sequence[float]) -> Column:
    return F.array(*(F.lit(float(x)) for x in vector))


def matching(points: DataFrame, conditions: dict[str, Any]) -> DataFrame:
    """Rows equal to all conditions; a condition on a column that the table lacks is ignored."""
    for column, value in conditions.items():
        if column in points.columns and value is not None:
            points = points.where(F.col(column) == value)
    return points


def search(points: DataFrame, query: Sequence[float] | Column, k: int = 5, least: float | None = None, conditions: dict[str, Any] | None = None, key: str = "id", vector: str = "vector") -> DataFrame:
    """The k rows most similar to a query, with ``score``; ties go to the smaller key."""
    wanted = query if isinstance(query, Column) else literal_vector(query)
    scored = matching(points, conditions or {}).withColumn("score", cosine(F.col(vector), wanted)).where("score is not null")
    if least is not None:
        scored = scored.where(F.col("score") >= least)
    return scored.orderBy(F.desc("score"), key).limit(k)


def search_many(points: DataFrame, queries: DataFrame, k: int = 5, key: str = "id", vector: str = "vector", query_key: str = "query_id", query_vector: str = "query_vector", most_queries: int = 10_000) -> DataFrame:
    """query_id, id, score, rank: the k best rows of each query of a stated set.

    The queries, at most ``most_queries`` of them (more is an error), travel to the points in blocks
    of rows, where a matrix product keeps each block's best k; the points never move.
    """
    wanted = queries.select(query_key, query_vector).limit(most_queries + 1).collect()
    if len(wanted) > most_queries:
        raise ValueError(f"more than {most_queries} queries: use the index for these")
    keys = [r[0] for r in wanted if r[1] is not None]
    matrix = np.array([r[1] for r in wanted if r[1] is not None], dtype=np.float64).reshape(len(keys), -1)
    matrix /= np.maximum(np.linalg.norm(matrix, axis=1, keepdims=True), 1e-300)
    kinds = queries.schema[query_key].dataType.simpleString(), points.schema[key].dataType.simpleString()

    def run(batches):
        for batch in batches:
            good = [v is not None and len(v) == matrix.shape[1] for v in batch[vector]]
            part = batch[good]
            if not len(part) or not keys:
                continue
            rows = np.array(part[vector].tolist(), dtype=np.float64)
            lengths = np.linalg.norm(rows, axis=1)
            rows, ids = rows[lengths > 0] / lengths[lengths > 0][:, None], part[key].to_numpy()[lengths > 0]
            scores = matrix @ rows.T
            frames = []
            for at, query in enumerate(keys):
                order = np.lexsort((ids, -scores[at]))[:k]
                frames.append(pd.DataFrame({"query_id": query, "id": ids[order], "score": scores[at][order]}))
            yield pd.concat(frames)

    best = points.select(key, vector).mapInPandas(run, f"query_id {kinds[0]}, id {kinds[1]}, score double")
    ranked = best.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "id")))
    return ranked.where(F.col("rank") <= k)


def best_per_group(scored: DataFrame, group: str, k: int = 10, key: str = "id") -> DataFrame:
    """Each group's row of the highest score, the k best of them; ties go to the smaller key."""
    best = scored.groupBy(group).agg(F.max(F.struct("score", F.struct(*[F.col(c) for c in scored.columns if c not in ("score", group)]).alias("row"))).alias("b"))
    order = best.select(group, F.col("b.score").alias("score"), "b.row.*")
    return order.orderBy(F.desc("score"), key).limit(k)


def reranked(hits: DataFrame, text: str = "text", key: str = "id") -> DataFrame:
    """Hits without blank texts, the first of equal texts, highest score first."""
    rows = hits.where(F.trim(F.col(text)) != "")
    first = Window.partitionBy(text).orderBy(F.desc("score"), key)
    return rows.withColumn("__n", F.row_number().over(first)).where("__n = 1").drop("__n").orderBy(F.desc("score"), key)


def centroids(points: DataFrame, group: str, vector: str = "vector") -> DataFrame:
    """group, centroid: mean of each group's vectors, of length one.  Null vectors are left out."""
    parts = points.where(F.col(vector).isNotNull()).select(group, F.posexplode(vector).alias("at", "x"))
    means = parts.groupBy(group, "at").agg(F.avg("x").alias("m"))
    whole = means.groupBy(group).agg(F.array_sort(F.collect_list(F.struct("at", "m"))).alias("c")).select(group, F.transform("c", lambda x: x["m"]).alias("c"))
    return whole.select(group, F.when(norm(F.col("c")) > 0, F.transform("c", lambda x: x / norm(F.col("c")))).otherwise(F.col("c")).alias("centroid"))


def by_centrality(points: DataFrame, centres: DataFrame, group: str, key: str = "id", vector: str = "vector") -> DataFrame:
    """Points with their cosine to their group's centroid and rank by it; without a cosine they come last.

    Groups may be of any size: ranks are taken in slices of the cosine.
    """
    joined = points.join(centres, group).withColumn("centrality", cosine(F.col(vector), F.col("centroid")))
    slice_of = F.coalesce(F.floor((1 - F.col("centrality")) * 4096), F.lit(1 << 20))
    return with_position(joined, [group], slice_of, [F.desc_nulls_last("centrality"), F.col(key)], "rank").withColumn("rank", F.col("rank").cast("int"))


def distinct_greedy(candidates: DataFrame, group: str, order: str, vector: str = "vector", most_alike: float = 0.9) -> DataFrame:
    """Candidates kept one by one while none kept before is as similar as ``most_alike``; per group in order.

    What is kept depends on all that was kept before, so a group, the candidates of one text, is one
    task.  Vectors that are null, not finite, all zero or of another length than most of the group are left out.
    """

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows[rows[vector].notna()].sort_values(order, kind="stable")
        sizes = rows[vector].map(len)
        if not len(rows):
            return rows
        rows = rows[sizes == sizes.mode().iloc[0]]
        values = np.stack([np.asarray(v, dtype=np.float64) for v in rows[vector]])
        lengths = np.linalg.norm(values, axis=1)
        sound = np.isfinite(lengths) & (lengths > 0)
        rows, values = rows[sound], values[sound] / lengths[sound, None]
        held = np.empty_like(values)
        kept: list[int] = []
        for at, x in enumerate(values):
            if not kept or float((held[: len(kept)] @ x).max()) < most_alike:
                held[len(kept)] = x
                kept.append(at)
        return rows.iloc[kept]

    return candidates.groupBy(group).applyInPandas(run, candidates.schema)


def with_recent(hits: DataFrame, recent: DataFrame, key: str = "id", most: int = 12) -> DataFrame:
    """Hits first, then recent entries not among them, at most ``most``; both have a ``rank``."""
    first = hits.select(key, "rank", F.lit(0).alias("src"))
    later = recent.join(hits.select(key), key, "left_anti").select(key, "rank", F.lit(1).alias("src"))
    return first.unionByName(later).orderBy("src", "rank", key).limit(most)


def relevance(score: str, query: str) -> Column:
    """high or medium by score; recent for entries without a score or a query under eight characters."""
    return F.when(F.col(score).isNull() | (F.length(F.trim(F.col(query))) < 8), "recent").when(F.col(score) > 0.85, "high").otherwise("medium")


def snippets(hits: DataFrame, text: str = "text", most: int = 300) -> DataFrame:
    return hits.withColumn("snippet", cut_text(text, most))


# --- context of an answer


def context_text(hits: DataFrame, text: str = "text", order: str = "rank") -> DataFrame:
    """One row: the texts of a bounded list of hits in order, with a rule between."""
    parts = F.array_sort(F.collect_list(F.struct(F.col(order).alias("o"), F.col(text).alias("t"))))
    return hits.agg(F.array_join(F.transform(parts, lambda x: x["t"]), "\n\n---\n\n").alias("context"))


def graph_lines(edges: DataFrame) -> DataFrame:
    return edges.select(F.concat(F.lit("- "), "subject", F.lit(" --["), "predicate", F.lit("]--> "), "object").alias("line"))


# --- upkeep


def upserted(stored: DataFrame, fresh: DataFrame, keys: Sequence[str], order: str | None = None) -> DataFrame:
    """Stored rows with those of equal keys replaced by fresh ones; of several fresh rows the latest counts.

    ``order`` is a column that grows with each version; without it any one of several fresh rows stands.
    """
    later = Window.partitionBy(*keys).orderBy(*([F.col(order).desc_nulls_last()] if order else []), *[F.col(c).desc_nulls_last() for c in fresh.columns if c not in keys and c != order])
    latest = fresh.withColumn("__n", F.row_number().over(later)).where("__n = 1").drop("__n")
    return stored.join(latest.select(*keys), list(keys), "left_anti").unionByName(latest)


def deleted(stored: DataFrame, **equal: Any) -> DataFrame:
    """Rows left after deleting those equal in a column; an unknown column deletes nothing."""
    for column, value in equal.items():
        if column in stored.columns:
            stored = stored.where(~F.coalesce(F.col(column) == value, F.lit(False)))
    return stored


def deleted_keys(stored: DataFrame, gone: DataFrame, keys: Sequence[str]) -> DataFrame:
    return stored.join(gone.select(*keys).distinct(), list(keys), "left_anti")


def by_ids(stored: DataFrame, ids: DataFrame, key: str) -> DataFrame:
    """Rows of the wanted ids."""
    return stored.join(ids.select(key).distinct(), key, "left_semi")


def recent(entries: DataFrame, owner: str, value: Any, at: str = "created_at", key: str = "id", most: int = 10) -> DataFrame:
    """An owner's newest entries first."""
    return entries.where(F.col(owner) == value).orderBy(F.col(at).desc_nulls_last(), F.desc(key)).limit(most)
