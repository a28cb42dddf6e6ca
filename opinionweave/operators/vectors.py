"""Nearest vectors by cosine, topic assignment, centroids and topic trees."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..plans.lineage import written
from ..plans.skew import salted_join
from .vector_index import cosine_topk  # noqa: F401 (part of this module's interface)

# Query vectors carried to every task in one pass; more queries mean more passes.
BLOCK_ROWS = 8192
# Similarities held at once in a task.
CELLS = 4 * 1024 * 1024


def _blocks(queries: DataFrame, query_id: str, vector: str):
    """Query vectors in blocks of at most BLOCK_ROWS, one at a time."""
    ids, rows = [], []
    for r in queries.select(query_id, vector).orderBy(query_id).toLocalIterator(prefetchPartitions=False):
        ids.append(r[0])
        rows.append(r[1])
        if len(ids) == BLOCK_ROWS:
            yield ids, rows
            ids, rows = [], []
    if ids:
        yield ids, rows


def nearest_centroid(
    vectors: DataFrame,
    centroids: DataFrame,
    row_id: str = "vec_id",
    topic: str = "topic",
    vector: str = "embedding",
    digits: int = 6,
    with_vector: bool = False,
) -> DataFrame:
    """Topic with the highest cosine per vector (ties to the smaller topic), no shuffle.

    Centroids go to the tasks in bounded blocks; each further block compares with
    the best so far. A row without a vector keeps a NULL topic.
    """
    id_type, topic_type = vectors.schema[row_id].dataType, centroids.schema[topic].dataType
    names = [f.simpleString() for f in (id_type, topic_type)]
    out = vectors.select(row_id, vector, F.lit(None).cast(topic_type).alias(topic), F.lit(None).cast("double").alias("similarity"))
    schema = f"{row_id} {names[0]}, {vector} {vectors.schema[vector].dataType.simpleString()}, {topic} {names[1]}, similarity double"
    for ids, rows in _blocks(centroids, topic, vector):
        out = out.mapInPandas(_assign_from(ids, rows, topic, vector, digits), schema)
        if len(ids) == BLOCK_ROWS:
            out = written(out, "assigned")
    return out if with_vector else out.drop(vector)


def _assign_from(ids, rows, topic, vector, digits):
    def assign(batches):
        import numpy as np
        import pandas as pd

        def unit(m):
            norm = np.linalg.norm(m, axis=1, keepdims=True)
            return np.divide(m, norm, out=np.zeros_like(m), where=norm > 0)

        q = unit(np.asarray(rows, dtype=float))
        names = pd.Series(ids)
        for pdf in batches:
            known = pdf[vector].notna().to_numpy()
            if known.any():
                m = np.vstack(pdf[vector].to_numpy()[known]).astype(float)
                at, top = np.empty(len(m), np.int64), np.empty(len(m))
                step = max(1, CELLS // len(q))
                for i in range(0, len(m), step):
                    sims = np.round(unit(m[i : i + step]) @ q.T, digits)
                    at[i : i + step] = sims.argmax(axis=1)
                    top[i : i + step] = sims.max(axis=1)
                best = pdf["similarity"].to_numpy(dtype=float, copy=True)
                labels = pdf[topic].to_numpy(dtype=object, copy=True)
                old = best[known]
                better = np.isnan(old) | (top > old)
                labels[known] = np.where(better, names.iloc[at].to_numpy(dtype=object), labels[known])
                best[known] = np.where(better, top, old)
                pdf[topic] = pd.Series(labels, index=pdf.index, dtype=object).where(pd.notna(labels), None)
                pdf["similarity"] = best
                if known.all():
                    pdf[topic] = pdf[topic].astype(names.dtype)
            yield pdf

    return assign


def centroids(vectors: DataFrame, keys: Sequence[str] = ("topic",), vector: str = "embedding") -> DataFrame:
    """Mean vector and volume per topic: positions are averaged with map-side combine."""
    parts = (
        vectors.select(*keys, F.posexplode(vector).alias("pos", "x"))
        .groupBy(*keys, "pos").agg(F.avg(F.col("x").cast("double")).alias("x"), F.count(F.lit(1)).alias("volume"))
    )
    # one entry per dimension: the list is bounded by the vector length
    return parts.groupBy(*keys).agg(
        F.transform(F.array_sort(F.collect_list(F.struct("pos", "x"))), lambda p: p["x"]).alias(vector),
        F.max("volume").alias("volume"),
    )


def kmeans_topics(
    vectors: DataFrame, k: int, row_id: str = "vec_id", vector: str = "embedding", rounds: int = 20, tolerance: float = 0.0
) -> DataFrame:
    """Spherical k-means: topic per vector after ``rounds`` of assignment and averaging.

    The vectors of the k smallest ids are the first centroids, so results repeat; ties go to the smaller topic, a
    topic that loses all vectors keeps its centroid, and a row without a vector has no topic. Rounds end early when
    no centroid moves by more than ``tolerance``.
    """
    data = vectors.select(row_id, vector)
    seeds = data.filter(F.col(vector).isNotNull()).orderBy(row_id).limit(k).select(row_id, F.col(vector).cast("array<double>").alias(vector))
    # k rows
    current = [(i, r[1]) for i, r in enumerate(seeds.collect())]
    schema = f"topic bigint, {vector} array<double>"
    for _ in range(rounds):
        assigned = nearest_centroid(data, vectors.sparkSession.createDataFrame(current, schema), row_id, vector=vector, with_vector=True)
        means = centroids(assigned.filter("topic is not null"), vector=vector)
        moved = {r["topic"]: r[vector] for r in means.collect()}
        after = [(i, moved.get(i, c)) for i, c in current]
        still = all(max((abs(x - y) for x, y in zip(a[1], b[1])), default=0.0) <= tolerance for a, b in zip(current, after))
        current = after
        if still:
            break
    return nearest_centroid(data, vectors.sparkSession.createDataFrame(current, schema), row_id, vector=vector).select(row_id, "topic")


def topic_rollup(topics: DataFrame, volumes: DataFrame) -> DataFrame:
    """Own volume and subtree volume per topic.

    ``topics``: topic, parent (NULL for a root, and like it a parent that is no topic). ``volumes``: topic, volume, already
    one row per topic. Pointers double: after r rounds a topic has the sum of all topics less than 2^r levels below and
    points 2^r levels up, where it hands its sum on; so rounds grow with the logarithm of the depth. Pointers that
    are left after as many levels as there are topics mean a cycle, an error.
    """
    own = topics.join(volumes, "topic", "left").select("topic", "parent", F.coalesce("volume", F.lit(0)).alias("volume"))
    state = written(own.withColumns({"total": F.col("volume"), "up": F.col("parent")}), "rollup")
    for _ in range(max(1, state.count()).bit_length() + 1):
        moving = state.filter("up is not null")
        if moving.isEmpty():
            break
        # one ancestor may be that of very many: sums are combined before the shuffle, pointers looked up by a salted join
        handed = moving.groupBy(F.col("up").alias("topic")).agg(F.sum("total").alias("more"))
        above = salted_join(moving.select("topic", "up"), state.select(F.col("topic").alias("up"), F.col("up").alias("next")), ["up"], ["topic"])
        after = state.drop("up").join(handed, "topic", "left").join(above.select("topic", "next"), "topic", "left")
        after = after.select("topic", "parent", "volume", (F.col("total") + F.coalesce("more", F.lit(0))).alias("total"), F.col("next").alias("up"))
        state = written(after, "rollup")
    else:
        raise ValueError("topic tree has a cycle")
    return state.select("topic", "parent", "volume", F.col("total").alias("subtree_volume"))
