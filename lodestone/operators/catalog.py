"""Catalog statistics, and writes as pure functions from a table and its changes to the new table."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestone.functions.predicates import present
from lodestone.functions.text import root_of
from lodestone.operators.ranking import numbered
from lodestone.sources.shared import cut


def with_axes(files: DataFrame, **vectors: DataFrame) -> DataFrame:
    """Adds has_<name> for each vector table (id): an existence test that can stand in an aggregate."""
    for name, v in vectors.items():
        files = files.join(v.select("id").distinct().withColumn(f"has_{name}", F.lit(True)), "id", "left").withColumn(f"has_{name}", F.coalesce(f"has_{name}", F.lit(False)))
    return files


def counts(files: DataFrame, caption: str, number: str) -> DataFrame:
    """One row: all files, those with a caption, and the mean of a number as an integer (0 if there is none)."""
    return files.agg(F.count("*").alias("total"), F.count_if(F.col(caption).isNotNull()).alias("captioned"), F.coalesce(F.floor(F.avg(number)).cast("long"), F.lit(0).cast("long")).alias("avg_number"))


def complete_files(files: DataFrame, caption: str) -> DataFrame:
    """One row: files that have caption and both vectors, each file on its own (needs with_axes vv, mv)."""
    return files.agg(F.count_if(present(F.col(caption)) & F.col("has_vv") & F.col("has_mv")).alias("complete"))


def distribution(files: DataFrame, key: str) -> DataFrame:
    """Rows by key, most first; null is a group of its own."""
    return files.groupBy(key).agg(F.count("*").alias("n")).orderBy(F.desc("n"), F.asc_nulls_last(key))


def phase_stats(files: DataFrame, root: Column, caption: str) -> DataFrame:
    """By root: files, and how many have caption and vectors; done is the least of these, not a count of files."""
    g = files.groupBy(root.alias("root")).agg(F.count("*").alias("total"), F.count_if(present(F.col(caption))).alias("mc"), F.count_if("has_vv").alias("vv"), F.count_if("has_mv").alias("mv"))
    return g.withColumn("done", F.least("mc", "vv", "mv"))


def incomplete_roots(files: DataFrame, root: str, caption: str) -> DataFrame:
    return phase_stats(files, F.col(root), caption).where("done < total")


def incomplete_totals(files: DataFrame, root: str, caption: str) -> DataFrame:
    """phase_stats of the roots that aren't done, with incomplete, and total_files and total_incomplete over all roots."""
    stats = phase_stats(files, F.col(root), caption).withColumn("incomplete", F.col("total") - F.col("done"))
    whole = stats.agg(F.coalesce(F.sum("total"), F.lit(0)).alias("total_files"), F.coalesce(F.sum("incomplete"), F.lit(0)).alias("total_incomplete"))
    return stats.where("incomplete > 0").crossJoin(F.broadcast(whole))  # one row


def effective_root(root: str, path: str, name: str) -> Column:
    return root_of(F.col(root), F.col(path), F.col(name))


def ancestor_rollup(stats: DataFrame, key: str = "root") -> DataFrame:
    """Sums by each folder that a row lies in, its own included."""
    parts = F.split(key, "/")
    up = F.transform(F.sequence(F.lit(1), F.size(parts)), lambda i: F.array_join(F.slice(parts, F.lit(1), i), "/"))
    return stats.withColumn("folder", F.explode(up)).groupBy("folder").agg(F.sum("total").alias("total"), F.sum("done").alias("done"), F.bool_or(F.col("done") < F.col("total")).alias("incomplete"))


def null_profile(df: DataFrame, columns: list[str]) -> DataFrame:
    """One row per column: rows, values and nulls, in one pass over df."""
    one = df.agg(F.count("*").alias("_n"), *(F.count(c).alias(c) for c in columns))
    items = F.array(*(F.struct(F.lit(c).alias("column"), F.col(c).alias("filled")) for c in columns))
    return one.select("_n", F.explode(items).alias("x")).select("x.column", F.col("_n").alias("total"), "x.filled", (F.col("_n") - F.col("x.filled")).alias("missing"))


def duplicate_groups(files: DataFrame, key: str) -> DataFrame:
    """Keys that two rows or more have, with their ids in order as text."""
    return files.where(F.col(key).isNotNull()).groupBy(key).agg(F.count("*").alias("n"), F.array_join(F.sort_array(F.collect_list("id")), ",").alias("ids")).where("n > 1")


def duplicate_members(files: DataFrame, key: str) -> DataFrame:
    """(key, n, place, id): the rows of each key that two or more have, numbered from 1 by id, a row each, so that no key's
    ids are in one row or counted by one task."""
    many = files.where(F.col(key).isNotNull()).groupBy(key).agg(F.count("*").alias("n")).where("n > 1")
    return numbered(files.select(key, "id").join(many, key), [key], ["id"], "place").select(key, "n", "place", "id")


def _one_per_key(patch: DataFrame, key: str) -> DataFrame:
    """The patch with one row of each key, the last as JSON. Keys alone are counted; only rows of repeated ones are compared."""
    several = cut(patch.groupBy(F.col(key).alias("_k")).agg(F.count("*").alias("_n")).where("_n > 1").select("_k"))
    if several.isEmpty():
        return patch
    same = F.col(key).eqNullSafe(F.col("_k"))
    rows = patch.join(several, same, "left_semi").groupBy(key).agg(F.max_by(F.struct("*"), F.to_json(F.struct("*"))).alias("_r"))
    return patch.join(several, same, "left_anti").unionByName(rows.select("_r.*"))


def upsert(base: DataFrame, patch: DataFrame, key: str, replace: list[str]) -> DataFrame:
    """base with patch rows inserted, or on conflict the columns `replace` taken from patch, null or not.

    Other columns of base stay; those that an inserted row lacks are null. Of patch rows with one key one counts, the
    last by all its columns as JSON. One full outer join.
    """
    patch = _one_per_key(patch, key)
    p = patch.select(F.col(key).alias("_k"), F.lit(True).alias("_p"), *(F.col(c).alias(f"_{c}") for c in patch.columns if c != key))
    hit, new = F.col("_p").isNotNull(), F.col(key).isNull()
    out = [F.coalesce(key, "_k").alias(key)]
    for c in base.columns:
        if c != key:
            mine = F.col(f"_{c}") if c in patch.columns else F.lit(None).cast(base.schema[c].dataType)
            out.append((F.when(hit & (F.lit(c in replace) | new), mine).otherwise(F.col(c))).alias(c))
    return base.join(p, base[key] == F.col("_k"), "full_outer").select(*out)


# What a new analysis of a file replaces. What users enter is never among it.
ANALYSIS = (
    "mc_caption", "ai_tags", "ocr_text", "dominant_color", "ai_style", "metadata", "parsed_at", "folder_path", "folder_depth", "folder_tags",
    "image_type", "art_style", "color_palette", "scene_type", "time_of_day", "weather", "character_type", "item_type", "ui_type", "structured_meta",
    "storage_root", "relative_path", "embedding_model", "embedding_version", "perceptual_hash", "dup_group_id",
    "mode_tier", "caption_model", "text_embed_model", "runtime_version", "preprocess_params",
)


def insert_files(base: DataFrame, patch: DataFrame, now: Column, key: str = "file_path") -> DataFrame:
    """base with analysed files: new ones whole, known ones with ANALYSIS replaced, null or not, and parsed now."""
    return upsert(base, patch.withColumn("parsed_at", now), key, [c for c in ANALYSIS if c in base.columns])


def patch_fields(base: DataFrame, patch: DataFrame, key: str, allowed: list[str]) -> DataFrame:
    """base with the allowed columns of patch where patch has a value; unknown keys and other columns are ignored."""
    columns, patch = [c for c in allowed if c in patch.columns], _one_per_key(patch, key)
    p = patch.select(F.col(key).alias("_k"), *(F.col(c).alias(f"_{c}") for c in columns))
    return base.join(p, base[key] == F.col("_k"), "left").select(*(F.coalesce(f"_{c}", c).alias(c) if c in columns else base[c] for c in base.columns))


def rate(base: DataFrame, ratings: DataFrame, key: str = "id") -> DataFrame:
    """Sets user_rating where the new one is from 0 to 5; others change nothing."""
    return patch_fields(base, ratings.where("user_rating between 0 and 5"), key, ["user_rating"])


def replace_vectors(old: DataFrame, new: DataFrame) -> DataFrame:
    """Vectors of new in place of those with the same id; null embeddings leave the old one alone."""
    given = new.where("embedding is not null")
    return old.join(given.select("id"), "id", "left_anti").unionByName(given.select(old.columns))


def delete_cascade(gone: DataFrame, **tables: DataFrame) -> dict[str, DataFrame]:
    """Each table without the rows of the ids in gone."""
    return {name: t.join(gone.select("id"), "id", "left_anti") for name, t in tables.items()}


def reset(**tables: DataFrame) -> DataFrame:
    """name, n, removed: how many rows each table has after a reset, and had before; the empty tables are t.limit(0)."""
    rows = [t.agg(F.count("*").alias("removed")).select(F.lit(name).alias("name"), F.lit(0).alias("n"), "removed") for name, t in tables.items()]
    out = rows[0]
    for r in rows[1:]:
        out = out.unionByName(r)
    return out


def unique_names(df: DataFrame, name: str, order: str) -> DataFrame:
    """Adds stored_name: in order, a row whose name is taken gets _1, _2, ... before the extension, the first that is free.

    The copies of a name count on by themselves, however many there are, unless another name of the table is one that
    they might get (a_1.png beside two a.png): such names, those that differ in numbers at their ends only, are settled
    one after another, in one task for each such family.
    """
    pattern = r"^(.*?)(\.[^.]*)?$"
    stem, ext = F.regexp_extract(name, pattern, 1), F.regexp_extract(name, pattern, 2)
    family = F.concat(F.regexp_replace(stem, r"(_[1-9][0-9]*)+$", ""), ext)
    sizes = df.groupBy(F.col(name).alias("_n")).agg(F.count("*").alias("_c")).where("_n is not null")
    sizes = sizes.withColumns({"_s": F.regexp_extract("_n", pattern, 1), "_e": F.regexp_extract("_n", pattern, 2)})
    # names that a copy of another name might get
    parents = sizes.where("_c > 1").select(F.col("_n").alias("_p"))
    children = sizes.where(F.col("_s").rlike(r"_[1-9][0-9]*$")).withColumn("_p", F.concat(F.regexp_replace("_s", r"_[1-9][0-9]*$", ""), "_e"))
    mixed = cut(children.join(parents, "_p", "left_semi").select(F.concat(F.regexp_replace("_s", r"(_[1-9][0-9]*)+$", ""), "_e").alias("_f")).distinct())
    n = F.col("_rn") - 1
    stored = F.when(n == 0, F.col(name)).otherwise(F.concat(stem, F.lit("_"), n.cast("string"), ext))
    if mixed.isEmpty():
        return numbered(df, [name], [order], "_rn").withColumn("stored_name", stored).drop("_rn")
    rows = df.withColumn("_f", family)
    alone = numbered(rows.join(mixed, "_f", "left_anti").drop("_f"), [name], [order], "_rn").withColumn("stored_name", stored).drop("_rn")

    def settle(part: pd.DataFrame) -> pd.DataFrame:
        part, taken, nexts, out = part.sort_values(order), set(), {}, []
        for x in part[name]:
            got, k = x, nexts.get(x, 1)
            at = x.rfind(".") if "." in x else len(x)
            while got in taken:
                got, k = f"{x[:at]}_{k}{x[at:]}", k + 1
            nexts[x] = k
            taken.add(got)
            out.append(got)
        return part.drop(columns="_f").assign(stored_name=out)

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema) + ", stored_name string"
    return alone.unionByName(rows.join(mixed, "_f", "left_semi").groupBy("_f").applyInPandas(settle, schema))
