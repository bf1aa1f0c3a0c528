"""Audits of the catalog and its queue, and listings over users and sessions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestone.functions.predicates import present, present_trimmed, under
from lodestone.operators.jobs import throughput
from lodestone.sources.files import nfc


def captions_without_vector(files: DataFrame, meaning: DataFrame, folder: str | None = None) -> DataFrame:
    """Files (below a folder, if one is given) that have a caption and no meaning vector."""
    rows = files.where(present_trimmed(F.col("caption")))
    rows = rows if folder is None else rows.where(under(F.col("file_path"), folder))
    return rows.join(meaning.select("id"), "id", "left_anti")


def vectors_without(files: DataFrame, vectors: DataFrame) -> DataFrame:
    """One row: vectors of files without caption, of files without hash, and of files with one."""
    rows = vectors.select("id").join(files.select("id", "caption", "hash"), "id")
    return rows.agg(F.count_if(~present(F.col("caption"))).alias("no_caption"), F.count_if(F.col("hash").isNull()).alias("no_hash"), F.count("hash").alias("hashed"))


def tokens_of_users(tokens: DataFrame, users: DataFrame, now: Column) -> DataFrame:
    """Tokens that haven't expired or been revoked, with their users, who must be active."""
    live = tokens.where((F.col("expires_at") > now) & ~F.coalesce("revoked", F.lit(False)))
    return live.join(users.where(F.coalesce("is_active", F.lit(True))), "user_id")


def by_login(users: DataFrame, login: str) -> DataFrame:
    """Users whose name or address is the login."""
    return users.where((F.col("username") == login) | (F.col("email") == login))


def with_captions(jobs: DataFrame, files: DataFrame) -> DataFrame:
    """Each job with the caption of the file at its path; paths are compared in Unicode NFC."""
    f = files.select(nfc(F.col("file_path")).alias("_p"), F.col("caption"))
    return jobs.withColumn("_p", nfc(F.col("file_path"))).join(f, "_p", "left").drop("_p")


def assigned(sessions: DataFrame, jobs: DataFrame) -> DataFrame:
    """Sessions that hold a job."""
    return sessions.join(jobs.where(F.col("status").isin("assigned", "processing")).select("session"), "session", "left_semi")


def resume_totals(stats: DataFrame, roots: list[str]) -> DataFrame:
    """One row: sums over the roots chosen and all below them."""
    chosen = F.lit(False)
    for r in roots:
        chosen = chosen | under(F.col("root"), r)
    return stats.where(chosen).agg(*(F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in ("total", "done")))


def parse_histogram(jobs: DataFrame) -> DataFrame:
    """Pending jobs by parse status, none as `unparsed`."""
    return jobs.where("status = 'pending'").groupBy(F.coalesce("parse_status", F.lit("unparsed")).alias("parse_status")).agg(F.count("*").alias("n"))


def build_status(files: DataFrame, index_version: int, level: int, current_index: int = 2, current_level: int = 3) -> DataFrame:
    """One row: needs_rebuild, level and the reasons. A level of 0 or less is inferred from the gaps found."""
    one = files.agg(F.count("*").alias("total"), F.count_if(~present_trimmed(F.col("relative_path"))).alias("missing_relative"))
    old = (F.col("total") > 0) & F.lit(index_version < current_index)
    reasons = F.array_compact(F.array(F.when(old, "text index is outdated"), F.when(F.col("missing_relative") > 0, F.concat(F.col("missing_relative").cast("string"), F.lit(" files lack a relative path")))))
    rebuild = F.size("reasons") > 0
    known = F.lit(min(level, current_level)) if level > 0 else F.lit(current_level)
    inferred = F.when(rebuild, level if level > 0 else max(1, current_level - 1)).otherwise(known)
    return one.withColumn("reasons", reasons).select("total", "missing_relative", rebuild.alias("needs_rebuild"), inferred.alias("level"), "reasons")


def child_counts(files: DataFrame, path: str) -> DataFrame:
    """Files that lie directly in each folder."""
    folder = F.regexp_extract(path, r"^(.*)/[^/]*$", 1)
    return files.groupBy(folder.alias("folder")).agg(F.count("*").alias("n"))


def client_rate(done: DataFrame, now: Column, seconds: int = 60) -> DataFrame:
    """One row: events of the last seconds, and per minute since the first of them (0 without time between)."""
    recent = done.where((F.col("ts") > now - F.expr(f"interval {seconds} seconds")) & (F.col("ts") <= now)).agg(F.count("*").alias("n"), F.min("ts").alias("first"))
    span = (F.unix_micros(now.cast("timestamp")) - F.unix_micros(F.col("first").cast("timestamp"))) / 1e6
    return recent.select("n", F.coalesce(F.when(span > 0, F.col("n") / span * 60), F.lit(0.0)).alias("per_minute"))


def throughput_levels(done: DataFrame, now: Column) -> DataFrame:
    """Throughput by session and by user: level, key, m1, m5, per_minute."""
    parts = [throughput(done, "ts", now, [k]).select(F.lit(k).alias("level"), F.col(k).cast("string").alias("key"), "m1", "m5", "per_minute") for k in ("session", "user_id")]
    return parts[0].unionByName(parts[1])


def sample(df: DataFrame, n: int, seed: int) -> DataFrame:
    """n random rows; the same seed gives the same by id."""
    return df.orderBy(F.xxhash64("id", F.lit(seed)), "id").limit(n)
