"""Reciprocal rank fusion, negative demotion and quality reranking of candidate lists."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

RRF_K = 60


def axis_ranks(lists: dict[str, DataFrame]) -> DataFrame:
    """(axis, id, score, rank) of (id, score) lists that are limited to their best rows; ranks start at 0."""
    union = None
    for axis, df in lists.items():
        part = df.select(F.lit(axis).alias("axis"), "id", F.col("score").cast("double").alias("score"))
        union = part if union is None else union.unionByName(part)
    return union.withColumn("rank", F.row_number().over(Window.partitionBy("axis").orderBy(F.desc("score"), "id")) - 1)


def fuse(lists: dict[str, DataFrame], weights: dict[str, float] | None = None, k: int = RRF_K) -> DataFrame:
    """(id, rrf, <axis>_score ...): the weighted sum of 1 / (k + rank + 1); an axis without weight has 1."""
    ranks = axis_ranks(lists)
    weight = F.lit(1.0)
    for axis, w in (weights or {}).items():
        weight = F.when(F.col("axis") == axis, float(w)).otherwise(weight)
    own = [F.max(F.when(F.col("axis") == a, F.col("score"))).alias(f"{a}_score") for a in lists]
    return ranks.groupBy("id").agg(F.sum(weight / (k + F.col("rank") + 1)).alias("rrf"), *own)


def demote(results: DataFrame, terms: list[str], haystack: Column, neg_sim: str | None = None, limit: float = 0.45, few: bool = False) -> DataFrame:
    """Adds neg_score and demoted: a point for each term found, 0.6 for a negative similarity far above the others'.

    Far above: over the mean by a population standard deviation, of three rows or more. Nothing is removed. few: the
    results are limited to their best rows, so one window over all of them is cheaper than a second pass.
    """
    low = F.lower(F.coalesce(haystack, F.lit("")))
    score = sum((F.contains(low, F.lit(t.lower())).cast("int") for t in terms), F.lit(0)).cast("double")
    if neg_sim:
        stats = {"_m": F.avg(neg_sim), "_s": F.stddev_pop(neg_sim), "_n": F.count(neg_sim)}
        if few:
            results = results.withColumns({k: v.over(Window.partitionBy()) for k, v in stats.items()})
        else:
            results = results.crossJoin(F.broadcast(results.agg(*(v.alias(k) for k, v in stats.items()))))  # one row
        score = score + F.when((F.col("_n") >= 3) & (F.col(neg_sim) > F.col("_m") + F.col("_s")), 0.6).otherwise(0.0)
    return results.withColumn("neg_score", score).withColumn("demoted", F.col("neg_score") > limit).drop("_m", "_s", "_n")


def blend(axes: dict[str, float], fallback: Column) -> Column:
    """The weighted mean of the axes that aren't null, else the fallback."""
    total = sum((F.when(F.col(a).isNotNull(), F.col(a) * w).otherwise(0.0) for a, w in axes.items()), F.lit(0.0))
    weight = sum((F.when(F.col(a).isNotNull(), w).otherwise(0.0) for a, w in axes.items()), F.lit(0.0))
    return F.when(weight > 0, total / weight).otherwise(fallback)


def completeness(caption: Column, has_tags: Column, has_type: Column, has_user: Column) -> Column:
    share = lambda c, w: F.when(c, w).otherwise(0.0)
    return share(caption, 0.35) + share(has_tags, 0.25) + share(has_type, 0.30) + share(has_user, 0.10)


def token_score(tokens: list[str], *haystack: Column) -> Column:
    """The share of the tokens that the fields hold, joined by spaces; 0 without tokens. Array fields join too."""
    low = F.lower(F.concat_ws(" ", *haystack))
    return sum((F.contains(low, F.lit(t)).cast("double") for t in tokens), F.lit(0.0)) / max(1, len(tokens))


#: Filters that count for filter_score.
SOFT_FILTERS = ("format", "image_type", "scene_type", "art_style", "time_of_day", "weather", "folder_path")


def filter_score(filters: dict[str, str | None], columns: dict[str, Column]) -> Column:
    """The share of the soft filters given that the row has, whatever its case; 0 without any."""
    given = {k: str(v).lower() for k, v in filters.items() if k in SOFT_FILTERS and v not in (None, "")}
    hits = [F.coalesce(F.lower(columns[k].cast("string")) == v, F.lit(False)).cast("double") if k in columns else F.lit(0.0) for k, v in given.items()]
    return sum(hits, F.lit(0.0)) / max(1, len(given))


def path_score(query: str, *paths: Column) -> Column:
    """For a query that looks like a path: 1 for an equal path or suffix, 0.8 where it is contained, else 0.

    Paths are looked at in order (relative, whole, folder); the first that matches counts.
    """
    q = (query or "").replace("\\", "/").strip().lower()
    if "/" not in q and not q.endswith((".psd", ".png", ".jpg", ".jpeg")):
        return F.lit(0.0)
    out = F.lit(0.0)
    for path in reversed(paths):
        low = F.lower(F.translate(F.coalesce(path, F.lit("")), "\\", "/"))
        out = F.when(F.endswith(low, F.lit(q)), 1.0).when(F.contains(low, F.lit(q)), 0.8).otherwise(out)
    return out


def quality(blended: Column, prior: Column, meta: Column, token: Column, filters: Column, path: Column) -> Column:
    return 0.62 * blended + 0.23 * prior + 0.10 * meta + 0.05 * (0.55 * token + 0.25 * filters + 0.20 * path)


def with_prior(pool: DataFrame, order: list) -> DataFrame:
    """Adds idx (from 0) and prior = 1 - idx / (n - 1) to a pool that is limited to its best rows."""
    n = F.count("*").over(Window.partitionBy())
    out = pool.withColumn("idx", F.row_number().over(Window.orderBy(*order)) - 1)
    return out.withColumn("prior", F.when(n > 1, 1.0 - F.col("idx") / (n - 1)).otherwise(1.0))
