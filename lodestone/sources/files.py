"""Sources and sinks: file discovery with content hashes, JSON sidecars, archives, append logs."""

from __future__ import annotations

import json

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf

# The file types that are indexed, and folders that are passed over.
EXTENSIONS = ("psd", "png", "jpg", "jpeg")
SKIPPED = (".git", "__pycache__", "node_modules", ".venv", "venv", ".idea", ".vs")
HEAD = 8192


def content_hash(content: Column, size: Column) -> Column:
    """SHA-256 of the size (8 bytes, little-endian), the first 8 KB and the last 8 KB that don't overlap them."""
    le = F.unhex(F.concat(*(F.substring(F.lpad(F.hex(size), 16, "0"), 15 - 2 * i, 2) for i in range(8))))
    tail = F.when(size > HEAD, F.expr(f"substring(content, greatest({HEAD}, length - {HEAD}) + 1, {HEAD})")).otherwise(F.unhex(F.lit("")))
    return F.sha2(F.concat(le, F.substring(content, 1, HEAD), tail), 256)


def discover(spark: SparkSession, root: str, extensions: tuple[str, ...] = EXTENSIONS) -> DataFrame:
    """path, name, folder, depth, tags, format, size, modified, hash of the files under root, in no order.

    Folders whose name begins with a dot or is in SKIPPED are passed over.
    """
    glob = "*.{" + ",".join(x for e in extensions for x in (e, e.upper())) + "}"
    raw = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", glob).load(root)
    base = root.rstrip("/").removeprefix("file:").replace("//", "/")
    relative = F.regexp_replace(F.regexp_replace("path", "^file:/*", "/"), f"^{base}/?", "")
    parts = F.split(relative, "/")
    folders = F.slice(parts, F.lit(1), F.size(parts) - 1)
    hidden = F.exists(folders, lambda f: f.startswith(".") | f.isin(*SKIPPED))
    ext = F.upper(F.element_at(F.split("path", r"\."), -1))
    return raw.where(~hidden).select("path", F.element_at(parts, -1).alias("name"), F.array_join(folders, "/").alias("folder"), F.size(folders).alias("depth"), folders.alias("tags"), F.when(ext == "JPEG", "JPG").otherwise(ext).alias("format"), F.col("length").alias("size"), F.col("modificationTime").alias("modified"), content_hash(F.col("content"), F.col("length")).alias("hash"))


def by_hash(files: DataFrame, each: int = 1000) -> DataFrame:
    """hash, chunk, paths: the paths of each content hash in order, `each` of them in a row, so that no list is unbounded."""
    spread = files.withColumn("chunk", F.pmod(F.xxhash64("path"), F.lit(64)))
    n = Window.partitionBy("hash", "chunk").orderBy("path")
    part = spread.withColumn("chunk", F.col("chunk") + 64 * F.floor((F.row_number().over(n) - 1) / each))
    return part.groupBy("hash", "chunk").agg(F.array_sort(F.collect_list("path")).alias("paths"))


def write_sidecars(df: DataFrame, path: str, key: str = "id") -> None:
    """One JSON object per line, dealt out by key so that equal file stems don't overwrite each other."""
    df.repartition(F.col(key)).write.mode("overwrite").json(path)


def append_log(df: DataFrame, path: str) -> None:
    df.write.mode("append").json(path)


def export_archive(spark: SparkSession, path: str, tables: dict[str, DataFrame], **facts) -> None:
    """Each table as Parquet, and a manifest of one row with their row counts."""
    n = {}
    for name, df in tables.items():
        df.write.mode("overwrite").parquet(f"{path}/{name}")
        n[name] = spark.read.parquet(f"{path}/{name}").count()
    spark.createDataFrame([(json.dumps({"tables": n, **facts}),)], "manifest string").coalesce(1).write.mode("overwrite").text(f"{path}/manifest")


def import_archive(spark: SparkSession, path: str, names: list[str]) -> dict[str, DataFrame]:
    return {n: spark.read.parquet(f"{path}/{n}") for n in names}


def nfc(column: Column) -> Column:
    """Unicode NFC, in Arrow batches: there is no built-in for it."""
    @pandas_udf("string")
    def normalize(s: pd.Series) -> pd.Series:
        return s.str.normalize("NFC")

    return normalize(column)


def decode_vectors(column: Column) -> Column:
    """Base64 of little-endian float32 to an array."""
    @pandas_udf("array<float>")
    def decode(s: pd.Series) -> pd.Series:
        return s.map(lambda b: None if b is None else np.frombuffer(b, "<f4"))

    return decode(F.unbase64(column))
