"""The composed search: candidates by axis, fusion, demotion, filters, enrichment, reranking and trimming.

Axes are V (visual), S (meaning), X (structure) and M (words). Only each axis's best rows are ever ranked together, so
what follows the candidate lists is small: top_k * MULTIPLIER rows an axis.
"""

from __future__ import annotations

from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lodestone.functions import predicates as P
from lodestone.functions.vectors import cosine
from lodestone.operators import fusion, knn, segments, textindex
from lodestone.plans.decompose import Plan, query_tokens, weights
from lodestone.sources.shared import cut

MULTIPLIER = 5
AXES = ("V", "S", "X", "M")
#: Weights of the axes in the reranking, where fusion has none.
BLEND = {"V": 0.30, "X": 0.15, "S": 0.35, "M": 0.20}
CLASSES = ("image_type", "art_style", "scene_type", "time_of_day", "weather")
#: The score that the best place on one axis gives; percentages are of it.
BEST_RRF = 0.01639


@dataclass
class Corpus:
    """files: id and the columns that filters and reranking know; vectors: axis to (id, embedding); text: an index of words
    (segments.Index), or the texts themselves (id, strong, weak), which each search then reads."""

    files: DataFrame
    vectors: dict[str, DataFrame] = field(default_factory=dict)
    text: segments.Index | textindex.Texts | DataFrame | None = None


def _column(files: DataFrame, name: str) -> Column:
    return F.col(name) if name in files.columns else F.lit(None).cast("string")


def conditions(files: DataFrame, filters: dict, strict: bool) -> Column:
    """The filters that are given, all of them: format, folder_path, user_category, min_rating, tags and classes."""
    out = []
    for k, v in filters.items():
        if v in (None, "", []):
            continue
        col = _column(files, k)
        if k in CLASSES:
            out.append(P.classified(col, v, strict))
        elif k == "format":
            out.append(P.equals_ci(col, v))
        elif k == "folder_path":
            out.append(P.starts_with(col, v))
        elif k == "user_category":
            out.append(P.same(col, v))
        elif k == "min_rating":
            out.append(P.min_rating(_column(files, "user_rating").cast("int"), v))
        elif k in ("user_tags", "folder_tags"):
            out.append(reduce(lambda a, b: a | b, [P.tag_contains(col, t) for t in ([v] if isinstance(v, str) else v)]))
        else:
            raise ValueError(f"unknown filter {k}")
    return P.every(out)


def candidates(corpus: Corpus, queries: dict[str, list[float]], plan: Plan, top_k: int, thresholds: dict[str, float] | None = None) -> dict[str, DataFrame]:
    """Each axis's best (id, score), top_k * MULTIPLIER of them; words scaled to 0..1."""
    n, least = top_k * MULTIPLIER, thresholds or {}
    lists = {a: knn.nearest(corpus.vectors[a], q, n, least.get(a, 0.0)).select("id", F.col("similarity").alias("score")) for a, q in queries.items()}
    if corpus.text is not None and plan.keywords:
        hits = textindex.matching(corpus.text, plan.keywords, plan.excluded)
        best = textindex.bm25(corpus.text, hits).orderBy(F.desc("score"), "id").limit(n)
        lists["M"] = textindex.min_max(best, "score", "scaled", few=True).select("id", F.col("scaled").alias("score"))
    return lists


def merged(lists: dict[str, DataFrame], plan: Plan) -> tuple[DataFrame, dict[str, float] | None]:
    """(id, rrf, V_score ... M_score), and the weights, of the axes that have rows.

    One such axis alone isn't fused: rrf is null, its score orders. The lists, some rows each, are computed once.
    """
    if not lists:
        raise ValueError("no axis is asked for")
    held = cut(reduce(DataFrame.unionByName, [rows.select(F.lit(a).alias("axis"), "id", "score") for a, rows in lists.items()]))
    found = {r["axis"] for r in held.select("axis").distinct().collect()}
    lists = {a: held.where(F.col("axis") == a).select("id", "score") for a in lists if a in found} or {next(iter(lists)): held.select("id", "score")}
    if len(lists) == 1:
        ((axis, rows),) = lists.items()
        out, used = rows.select("id", F.lit(None).cast("double").alias("rrf"), F.col("score").alias(f"{axis}_score")), None
    else:
        used = weights(plan.query_type, list(lists))
        out = fusion.fuse(lists, used)
    for a in AXES:
        if f"{a}_score" not in out.columns:
            out = out.withColumn(f"{a}_score", F.lit(None).cast("double"))
    return out.withColumn("first", F.coalesce("rrf", *(f"{a}_score" for a in AXES))), used


def enrich(pool: DataFrame, corpus: Corpus, queries: dict[str, list[float]], keywords: list[str]) -> DataFrame:
    """Fills axis scores that are missing: similarities of stored vectors, and of words those of whole keywords as
    phrases, both fields alike, scaled over the pool."""
    ids = pool.select("id")
    for a, q in queries.items():
        own = knn.similarity_of(corpus.vectors[a], q, ids).withColumnRenamed("similarity", "_s")
        pool = pool.join(own, "id", "left").withColumn(f"{a}_score", F.coalesce(f"{a}_score", "_s")).drop("_s")
    if corpus.text is not None and keywords:
        hits = reduce(DataFrame.unionByName, [textindex.phrase(corpus.text, k) for k in keywords])
        own = textindex.bm25(corpus.text, hits, {"strong": 1.0, "weak": 1.0}).join(ids, "id", "left_semi")
        own = textindex.min_max(own, "score", "_s", few=True).select("id", "_s")
        pool = pool.join(own, "id", "left").withColumn("M_score", F.coalesce("M_score", "_s")).drop("_s")
    return pool


def rerank(pool: DataFrame, query: str, filters: dict, used: dict[str, float] | None, tokens: list[str]) -> DataFrame:
    """Adds quality to a pool with idx (from 0), axis scores and file columns."""
    n = F.count("*").over(Window.partitionBy())
    pool = pool.withColumn("prior", F.when(n > 1, 1.0 - F.col("idx") / (n - 1)).otherwise(1.0))
    for a in AXES:
        pool = textindex.min_max(pool, f"{a}_score", f"{a}_norm", few=True)
    col = lambda c: _column(pool, c)
    tags = col("ai_tags") if "ai_tags" in pool.columns else F.array().cast("array<string>")
    user = F.coalesce(P.present(col("user_note")) | P.present(col("user_category")), F.lit(False))
    if "user_tags" in pool.columns:
        user = user | (F.size(F.coalesce("user_tags", F.array())) > 0)
    kinds = P.present(col("image_type")) | P.present(col("scene_type")) | P.present(col("art_style"))
    meta = fusion.completeness(P.present_trimmed(col("mc_caption")), F.coalesce(F.size(tags) > 0, F.lit(False)), kinds, user)
    fields = ("file_name", "folder_path", "relative_path", "file_path", "mc_caption", "image_type", "scene_type", "art_style")
    token = fusion.token_score(tokens, *map(col, fields), tags)
    soft = fusion.filter_score(filters, {k: F.col(k) for k in fusion.SOFT_FILTERS if k in pool.columns})
    path = fusion.path_score(query, col("relative_path"), col("file_path"), col("folder_path"))
    mixed = fusion.blend({f"{a}_norm": (used or {}).get(a, w) for a, w in BLEND.items()}, F.col("prior"))
    return pool.withColumn("quality", fusion.quality(mixed, F.col("prior"), meta, token, soft, path))


def composed(corpus: Corpus, queries: dict[str, list[float]], plan: Plan, top_k: int = 20, user_filters: dict | None = None, negative: list[float] | None = None, tokens: list[str] | None = None, pool_size: int | None = None) -> DataFrame:
    """The top_k files by place, with rrf, all axis scores, demotion and quality.

    In order: candidates, fusion, demotion by the plan's excluded terms and the negative visual vector, the plan's
    filters (leniently), the user's (strictly), enrichment of the pool, reranking, trimming. What the pool doesn't
    take follows in its order. No candidates give no rows. tokens: the query's, which are cut from it if not given.
    """
    rows, used = merged(candidates(corpus, queries, plan, top_k), plan)
    rows = rows.join(corpus.files, "id")
    terms = [t.lower() for t in plan.negative.replace(",", " ").split()] if plan.negative else []
    sim = None
    if terms and negative is not None and "V" in corpus.vectors:
        own = corpus.vectors["V"].join(rows.select("id"), "id", "left_semi").select("id", cosine(F.col("embedding"), F.lit(negative)).alias("_neg"))
        rows, sim = rows.join(own, "id", "left"), "_neg"
    hay = F.concat_ws(" ", _column(rows, "mc_caption"), F.array_join(F.col("ai_tags"), " ") if "ai_tags" in rows.columns else F.lit(None).cast("string"))
    rows = fusion.demote(rows, terms, hay, sim, few=True)
    rows = rows.where(conditions(corpus.files, plan.filters, False) & conditions(corpus.files, user_filters or {}, True))
    order = Window.orderBy("demoted", F.when(F.col("demoted"), -F.col("neg_score")).otherwise(0.0), F.desc("first"), "id")
    rows = rows.withColumn("idx", F.row_number().over(order) - 1)
    size = max(top_k, pool_size or max(3 * top_k, 80))
    pool = enrich(rows.where(F.col("idx") < size), corpus, queries, plan.keywords)
    pool = rerank(pool, plan.query, {**plan.filters, **(user_filters or {})}, used, query_tokens(plan.query) if tokens is None else list(tokens))
    tail = rows.where(F.col("idx") >= size)
    out = pool.unionByName(tail, allowMissingColumns=True)
    place = Window.orderBy(F.col("idx") >= size, F.desc(F.round("quality", 9)), F.desc(F.coalesce("rrf", F.lit(0.0))), "idx")
    return out.withColumn("place", F.row_number().over(place)).where(F.col("place") <= top_k)


def shape(rows: DataFrame) -> DataFrame:
    """Results as callers get them: combined score and its percentage of the best possible, nulls as defaults."""
    score = F.coalesce(F.col("rrf"), *(F.col(f"{a}_score") for a in AXES), F.lit(0.0))
    return rows.select("id", "place", score.alias("combined_score"), F.round(score / BEST_RRF * 100, 1).alias("percent"), *(F.col(f"{a}_score") for a in AXES), F.coalesce("quality", F.lit(0.0)).alias("quality"))


# What a result row holds of its file, in this order.
RESULT_COLUMNS = (
    "id", "file_path", "file_name", "format", "width", "height", "mc_caption", "ai_tags", "ocr_text", "metadata", "thumbnail_url",
    "user_note", "user_tags", "user_category", "user_rating", "folder_path", "folder_depth", "folder_tags", "storage_root", "relative_path",
    "image_type", "art_style", "color_palette", "scene_type", "time_of_day", "weather", "character_type", "item_type", "ui_type",
)


def project(rows: DataFrame, *scores: str) -> DataFrame:
    """The columns of a result, those that the catalog lacks as null, and the scores; no others are read."""
    return rows.select(*(F.col(c) if c in rows.columns else F.lit(None).cast("string").alias(c) for c in RESULT_COLUMNS), *scores)


def page_after(rows: DataFrame, key: str, last: tuple | None, size: int, id_column: str = "id") -> DataFrame:
    """The next `size` rows by falling key, then id, after the last one's (key, id); from the start for None.

    The place is a condition on the columns, which reaches the scan, so a page costs no more the further on it is, and
    rows that come or go before it neither repeat others nor hide them. Rows of a null key come last.
    """
    if last is not None:
        value, i = F.lit(last[0]), F.col(id_column) > F.lit(last[1])
        after = (F.col(key).isNull() & i) if last[0] is None else (F.col(key) < value) | ((F.col(key) == value) & i) | F.col(key).isNull()
        rows = rows.where(after)
    return rows.orderBy(F.desc_nulls_last(key), id_column).limit(size)


def by_metadata(corpus: Corpus, filters: dict, top_k: int) -> DataFrame:
    """Filters alone, the last parsed first."""
    return corpus.files.where(conditions(corpus.files, filters, True)).orderBy(F.desc("parsed_at"), "id").limit(top_k)


def search(mode: str, corpus: Corpus, queries: dict[str, list[float]] | None = None, plan: Plan | None = None, top_k: int = 20, **how) -> DataFrame:
    """The search of a mode: vector, meaning, structure, image, multi_image_and, multi_image_or, hybrid, metadata, fts,
    similar and similar_structure (to the file how["id"], itself left out), image_text (how["vectors"] are images, the
    text's vectors and plan as for triaxis) or triaxis. Unknown modes are refused."""
    queries, filters = queries or {}, how.get("user_filters") or {}
    one = {"vector": "V", "image": "V", "meaning": "S", "structure": "X"}
    if mode in one:
        axis = one[mode]
        return knn.nearest(corpus.vectors[axis], queries[axis], top_k, how.get("threshold", 0.0))
    if mode in ("multi_image_and", "multi_image_or"):
        vectors = how["vectors"]
        return knn.nearest(corpus.vectors["V"], knn.mean_vector(vectors), top_k) if mode == "multi_image_and" else knn.nearest_to_any(corpus.vectors["V"], vectors, top_k)
    if mode in ("similar", "similar_structure"):
        return knn.similar_to(corpus.vectors["V" if mode == "similar" else "X"], how["id"], top_k, how.get("threshold", 0.0))
    if mode == "image_text":
        images = how.pop("vectors")
        return composed(corpus, {**queries, "V": knn.mean_vector(images)}, plan, top_k, **how)
    if mode == "hybrid":
        able = corpus.files.where(conditions(corpus.files, filters, True)).select("id")
        return knn.nearest(corpus.vectors["V"].join(able, "id", "left_semi"), queries["V"], top_k, how.get("threshold", 0.0))
    if mode == "metadata":
        return by_metadata(corpus, filters, top_k)
    if mode == "fts":
        return candidates(Corpus(corpus.files, {}, corpus.text), {}, plan, max(1, -(-top_k // MULTIPLIER)))["M"].orderBy(F.desc("score"), "id").limit(top_k)
    if mode == "triaxis":
        return composed(corpus, queries, plan, top_k, **how)
    raise ValueError(f"unknown mode {mode}")
