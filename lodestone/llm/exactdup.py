"""Exact deduplication by a Golomb-coded fingerprint exchange.

Each partition sends its sorted fingerprints, Golomb-Rice coded, to the owners of the fingerprint ranges. An owner
answers each partition with a bitmap of those that occur elsewhere too. Only rows so marked shuffle their texts, which
are compared byte by byte. Unmarked rows are alone for certain: equal texts have equal fingerprints.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestone.llm.common import SPACE, cut, join_hot, shuffle_width, small

#: Fingerprints that one owner decodes at a time.
_PER_OWNER = 1 << 21


def golomb_encode(values: np.ndarray, k: int) -> bytes:
    """Rice code of ascending integers: each gap's upper part in unary, its k lower bits in binary."""
    gaps = np.diff(values, prepend=np.uint64(0))
    high, low = (gaps >> np.uint64(k)).astype(np.int64), gaps & np.uint64((1 << k) - 1)
    unary = np.zeros(int(high.sum()) + len(high), np.uint8)
    unary[np.cumsum(high + 1) - 1] = 1
    binary = np.unpackbits(low.astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")[:, :k].ravel()
    return np.packbits(np.concatenate([unary, binary])).tobytes()


def golomb_decode(data: bytes, n: int, k: int) -> np.ndarray:
    bits = np.unpackbits(np.frombuffer(data, np.uint8))
    ends = np.flatnonzero(bits)[:n]  # the unary part comes first, and its ones are the first n
    high = np.diff(ends, prepend=-1) - 1
    at = int(ends[-1]) + 1 if n else 0
    binary = np.zeros((n, 64), np.uint8)
    binary[:, :k] = bits[at : at + n * k].reshape(n, k)
    low = np.packbits(binary, axis=1, bitorder="little").view("<u8").ravel()
    return np.cumsum((high.astype(np.uint64) << np.uint64(k)) | low, dtype=np.uint64)


def rice_parameter(n: int, spread: int) -> int:
    """Bits of the mean gap."""
    return max(1, (spread // max(1, n)).bit_length() - 1)


def owner_of(h: np.ndarray, owners: int) -> np.ndarray:
    """Owners hold equal ranges of the upper 32 bits."""
    return ((h >> np.uint64(32)) * np.uint64(owners)) >> np.uint64(32)


def _send(owners: int) -> Callable:
    def run(batches):
        parts: dict[int, list[np.ndarray]] = {}
        for b in batches:
            part, h = b.column("part").to_numpy(), b.column("fp").to_numpy().view(np.uint64)
            for p in np.unique(part):
                parts.setdefault(int(p), []).append(h[part == p])
        for p, held in parts.items():
            h = np.sort(np.concatenate(held))
            cuts = np.searchsorted(owner_of(h, owners), np.arange(owners + 1))
            out = {"owner": [], "part": [], "n": [], "k": [], "codes": []}
            for o, (i, j) in enumerate(zip(cuts[:-1], cuts[1:], strict=True)):
                if i < j:
                    k = rice_parameter(int(j - i), (1 << 64) // owners)
                    base = np.uint64(-(-(o << 32) // owners) << 32)
                    for name, x in (("owner", o), ("part", p), ("n", int(j - i)), ("k", k), ("codes", golomb_encode(h[i:j] - base, k))):
                        out[name].append(x)
            yield pa.record_batch({"owner": pa.array(out["owner"], pa.int32()), "part": pa.array(out["part"], pa.int32()), "n": pa.array(out["n"], pa.int64()), "k": pa.array(out["k"], pa.int32()), "codes": pa.array(out["codes"], pa.binary())})

    return run


def _answer(pdf: pd.DataFrame) -> pd.DataFrame:
    """For one owner: which of each partition's fingerprints occur twice or more over all partitions."""
    held = [golomb_decode(c, int(n), int(k)) for c, n, k in zip(pdf["codes"], pdf["n"], pdf["k"], strict=True)]
    every = np.sort(np.concatenate(held))
    twice = every[1:][every[1:] == every[:-1]]
    maps = []
    for h in held:
        at = np.searchsorted(twice, h)
        at[at == len(twice)] = 0
        maps.append(np.packbits(twice[at] == h if len(twice) else np.zeros(len(h), bool)).tobytes())
    return pd.DataFrame({"part": pdf["part"], "owner": pdf["owner"], "n": pdf["n"], "marks": maps})


def _mark(key: tuple, rows: pa.Table, maps: pa.Table) -> pa.Table:
    """The rows of a partition whose fingerprints the owners marked."""
    h = rows.column("fp").to_numpy().view(np.uint64)
    order = np.argsort(h, kind="stable")
    maps = maps.sort_by("owner")
    marks = [np.unpackbits(np.frombuffer(m, np.uint8))[:n] for m, n in zip(maps.column("marks").to_pylist(), maps.column("n").to_pylist(), strict=True)]
    marked = np.zeros(len(h), bool)
    marked[order] = np.concatenate(marks).astype(bool) if marks else False
    return rows.select(["row"]).filter(pa.array(marked))


def exact_groups(docs: DataFrame) -> DataFrame:
    """doc_id, keep_id, group_size, kept, text_sha256: one row per row of docs (doc_id integer, text string).

    Texts are equal if identical once each run of `[\\x20\\x09-\\x0D]` is one space; null counts as empty, and empty
    texts equal each other. keep_id is the group's smallest doc_id (rows without doc_id count for group_size but
    can't be it; a group without any doc_id has keep_id null, and its rows are kept). Rows that repeat a doc_id within
    a group are all kept or all dropped. Other columns are ignored; an empty table gives no rows. Should two texts
    ever share a SHA-256 digest, the job fails rather than merge them.
    """
    spark = docs.sparkSession
    text = F.regexp_replace(F.coalesce("text", F.lit("")), SPACE, " ")
    base = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text.alias("t"))
    # the cut fixes which partition and row number each row has
    rows = cut(base.select("doc_id", F.xxhash64("t").alias("fp"), F.sha2("t", 256).alias("sha"), F.spark_partition_id().alias("part")).withColumn("row", F.monotonically_increasing_id()))
    owners = max(shuffle_width(spark), rows.count() // _PER_OWNER)
    sent = rows.select("part", "fp").mapInArrow(_send(owners), "owner int, part int, n long, k int, codes binary")
    answers = sent.groupBy("owner").applyInPandas(_answer, "part int, owner int, n long, marks binary")
    marked = rows.select("part", "row", "fp").groupBy("part").cogroup(answers.groupBy("part")).applyInArrow(_mark, "row long")
    suspects = cut(rows.drop("part", "fp").join(marked, "row"))
    ids = suspects.select(F.col("doc_id").alias("i"), F.col("sha").alias("s")).distinct()
    texts = base.withColumn("sha", F.sha2("t", 256)).join(small(ids, suspects.count(), 100), F.col("doc_id").eqNullSafe(F.col("i")) & (F.col("sha") == F.col("s")), "left_semi")
    # bytes are compared as grouping keys, partly before the shuffle; nothing gathers a group's texts
    classes = texts.groupBy("sha", "t").agg(F.min("doc_id").alias("keep_id"), F.count("*").alias("group_size"))
    classes = classes.groupBy("sha").agg(F.min("keep_id").alias("keep_id"), F.sum("group_size").alias("group_size"), F.count("*").alias("texts"))
    sure = F.when(F.col("texts") > 1, F.raise_error(F.lit("two texts share a SHA-256 digest")).cast("long")).otherwise(F.col("group_size"))
    classes = cut(classes.select("sha", "keep_id", sure.alias("group_size")))
    grouped = join_hot(rows.select("doc_id", "sha"), classes, ["sha"], "group_size", "left")
    keep = F.when(F.col("group_size").isNull(), F.col("doc_id")).otherwise(F.col("keep_id"))
    return grouped.select("doc_id", keep.alias("keep_id"), F.coalesce("group_size", F.lit(1).cast("long")).alias("group_size"), F.col("doc_id").eqNullSafe(keep).alias("kept"), F.col("sha").alias("text_sha256"))
