"""Exact nearest neighbours by cosine similarity.

Vectors are scanned where they are; only each query's best k rows move. Query vectors are few and given by the caller,
so they are broadcast.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lodestone.functions.vectors import cosine, doubles, l2_normalize


def scored(vectors: DataFrame, query: list[float], threshold: float | None = 0.0) -> DataFrame:
    """Adds similarity; rows below the threshold, and zero vectors, are left out."""
    out = vectors.withColumn("similarity", cosine(F.col("embedding"), F.lit(query)))
    return out.where(F.col("similarity").isNotNull() if threshold is None else F.col("similarity") >= threshold)


def nearest(vectors: DataFrame, query: list[float], k: int, threshold: float = 0.0, where: Column | None = None) -> DataFrame:
    """The k most similar (id, embedding) rows; ties go to the smaller id. `where` holds before ranking."""
    base = vectors if where is None else vectors.where(where)
    return scored(base, query, threshold).orderBy(F.desc("similarity"), "id").limit(k)


def vector_of(vectors: DataFrame, key: int) -> list[float] | None:
    row = vectors.where(F.col("id") == key).select("embedding").first()
    return None if row is None else [float(x) for x in row[0]]


def similar_to(vectors: DataFrame, key: int, k: int, threshold: float = 0.0) -> DataFrame:
    """The k nearest of a stored vector, itself left out; no rows for an unknown id."""
    query = vector_of(vectors, key)
    if query is None:
        return vectors.limit(0).withColumn("similarity", F.lit(0.0))
    return nearest(vectors, query, k, threshold, F.col("id") != key)


def mean_vector(queries: list[list[float]]) -> list[float]:
    """The normalised mean of a few query vectors."""
    mean = [sum(x) / len(queries) for x in zip(*queries, strict=True)]
    size = sum(x * x for x in mean) ** 0.5
    return [x / size for x in mean] if size else mean


def nearest_to_any(vectors: DataFrame, queries: list[list[float]], k: int, threshold: float = 0.0) -> DataFrame:
    """(id, similarity): each query's k nearest, the best similarity of each id, and of these the k best."""
    parts = [nearest(vectors, q, k, threshold).select("id", "similarity") for q in queries]
    union = parts[0]
    for p in parts[1:]:
        union = union.unionByName(p)
    return union.groupBy("id").agg(F.max("similarity").alias("similarity")).orderBy(F.desc("similarity"), "id").limit(k)


def similarity_of(vectors: DataFrame, query: list[float], ids: DataFrame) -> DataFrame:
    return scored(vectors.join(ids.select("id"), "id", "left_semi"), query, None).select("id", "similarity")


def centroids(vectors: DataFrame, key: str) -> DataFrame:
    """The normalised mean vector of each key; components are averaged apart, so a large key is no one task's."""
    parts = vectors.select(key, F.posexplode(doubles(F.col("embedding"))).alias("pos", "x")).groupBy(key, "pos").agg(F.avg("x").alias("x"))
    whole = parts.groupBy(key).agg(F.array_sort(F.collect_list(F.struct("pos", "x"))).alias("p"))
    return whole.select(key, l2_normalize(F.transform("p", lambda s: s["x"])).alias("embedding"))


def ranked(df: DataFrame, score: str = "similarity") -> DataFrame:
    """Ranks an already limited result from 0."""
    return df.withColumn("rank", F.row_number().over(Window.orderBy(F.desc(score), "id")) - 1)
