"""Line deduplication across documents with two Bloom filters.

Line keys are SHA-256 digests. Every task sends each digest it holds once (marked if several of its documents hold it)
to the owner of the digest's bucket, which sets it in a filter of once-seen digests, or if it is there already in one
of twice-seen digests. Then all (document, digest) rows stream past their bucket's second filter; only those it holds,
suspected repeats, are grouped by digest for an exact count and the first document. A bucket that a hot line makes
large is streamed by several tasks, each with a copy of the filter.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestone.llm.common import cut, join_hot, shuffle_width, small, sub_batches

STRIP = " \t\n\x0b\x0c\r"
LEAST = 10
BITS_PER_KEY = 12
PROBES = 6
SALTS = 8
#: Keys that one bucket's filters are made for.
BUCKET_KEYS = 1 << 18
_UPPER = {c: c + 32 for c in range(65, 91)}


def digest(line: str) -> bytes | None:
    """Of the line's key; None if the key is too short to count."""
    key = line.strip(STRIP)
    return hashlib.sha256(key.translate(_UPPER).encode()).digest() if len(key) >= LEAST else None


class Bloom:
    def __init__(self, bits: np.ndarray):
        self.bits, self.mask = bits, np.uint64(len(bits) * 8 - 1)

    @classmethod
    def sized(cls, keys: int) -> Bloom:
        return cls(np.zeros(1 << max(6, (keys * BITS_PER_KEY // 8 - 1).bit_length()), np.uint8))

    def _at(self, keys: np.ndarray, i: int) -> tuple[np.ndarray, np.ndarray]:
        """keys: rows of 64-bit words of the digest; the bucket is taken from another word."""
        bit = (keys[:, 1] + np.uint64(i) * (keys[:, 2] | np.uint64(1))) & self.mask
        return (bit >> np.uint64(3)).astype(np.int64), np.uint8(1) << (bit & np.uint64(7)).astype(np.uint8)

    def add(self, keys: np.ndarray) -> None:
        for i in range(PROBES):
            at, bit = self._at(keys, i)
            np.bitwise_or.at(self.bits, at, bit)

    def holds(self, keys: np.ndarray) -> np.ndarray:
        found = np.ones(len(keys), bool)
        for i in range(PROBES):
            at, bit = self._at(keys, i)
            found &= (self.bits[at] & bit) > 0
        return found


def _words(column: pa.Array) -> np.ndarray:
    """32-byte digests as rows of 4 words."""
    return np.frombuffer(b"".join(column.to_pylist()), np.uint64).reshape(-1, 4)


def _keys(batches):
    """Of each document, its distinct digests."""
    for batch in batches:
        for part in sub_batches(batch, "text"):
            docs, digests = [], []
            for doc, text in zip(part.column("doc_id").to_pylist(), part.column("text").to_pylist(), strict=True):
                if doc is not None:
                    found = {d for line in set((text or "").split("\n")) if (d := digest(line))}
                    digests += found
                    docs += [doc] * len(found)
            yield pa.record_batch({"doc_id": pa.array(docs, pa.int64()), "digest": pa.array(digests, pa.binary())})


def _seen(buckets: int) -> Callable:
    def run(batches):
        for batch in batches:
            if not batch.num_rows:
                continue
            counts = pc.value_counts(batch.column("digest"))
            d, n = counts.field("values"), counts.field("counts").to_numpy()
            yield pa.record_batch({"bucket": pa.array((_words(d)[:, 0] % np.uint64(buckets)).astype(np.int32)), "digest": d, "twice": pa.array(n > 1)})

    return run


def _filters(batches):
    """A bucket's filter of twice-seen digests; rows come with the buckets of a task one after another."""
    now, once, twice = None, None, None
    for batch in batches:
        bucket, many = batch.column("bucket").to_numpy(), batch.column("twice").to_numpy(zero_copy_only=False)
        w = _words(batch.column("digest"))
        for b in np.unique(bucket):
            if b != now:
                if now is not None:
                    yield pa.record_batch({"bucket": pa.array([now], pa.int32()), "bits": pa.array([twice.bits.tobytes()], pa.binary())})
                now, once, twice = int(b), Bloom.sized(BUCKET_KEYS), Bloom.sized(BUCKET_KEYS)
            mine = bucket == b
            k, m = w[mine], many[mine].copy()
            _, first = np.unique(k[:, 3], return_index=True)  # words that agree by chance only make a suspect
            again = np.ones(len(k), bool)
            again[first] = False
            twice.add(k[m | again | once.holds(k)])
            once.add(k)
    if now is not None:
        yield pa.record_batch({"bucket": pa.array([now], pa.int32()), "bits": pa.array([twice.bits.tobytes()], pa.binary())})


def _suspects(batches):
    """The rows that their bucket's filter holds; in each group the filter comes first."""
    now, held = None, None
    for batch in batches:
        bucket, salt, bits = batch.column("bucket").to_numpy(), batch.column("salt").to_numpy(), batch.column("bits")
        group = bucket.astype(np.int64) * SALTS + salt
        starts = np.append(np.flatnonzero(np.append(True, group[1:] != group[:-1])), len(group))
        for i, j in zip(starts[:-1], starts[1:], strict=True):
            if group[i] != now:
                now, held = int(group[i]), None
            if bits[int(i)].is_valid:
                held = Bloom(np.frombuffer(bits[int(i)].as_py(), np.uint8))
                i += 1
            if held is not None and i < j:
                rows = batch.slice(int(i), int(j - i))
                found = pa.array(held.holds(_words(rows.column("digest"))))
                yield pa.record_batch({"doc_id": rows.column("doc_id").filter(found), "digest": rows.column("digest").filter(found)})


def _apply(batches):
    for batch in batches:
        for part in sub_batches(batch, "text"):
            out = {"doc_id": part.column("doc_id"), "text": [], "n_lines": [], "n_dropped": [], "sha": []}
            for text, drop in zip(part.column("text").to_pylist(), part.column("drops").to_pylist(), strict=True):
                lines = (text or "").split("\n")
                gone = set(drop or ())
                kept = [x for x in lines if digest(x) not in gone] if gone else lines
                left = "\n".join(kept)
                out["text"].append(left)
                out["n_lines"].append(len(lines))
                out["n_dropped"].append(len(lines) - len(kept))
                out["sha"].append(hashlib.sha256(left.encode()).hexdigest())
            yield pa.record_batch({"doc_id": out["doc_id"], "text": pa.array(out["text"], pa.string()), "n_lines": pa.array(out["n_lines"], pa.int64()), "n_dropped": pa.array(out["n_dropped"], pa.int64()), "kept_sha256": pa.array(out["sha"], pa.string())})


def repeated_lines(docs: DataFrame) -> DataFrame:
    """doc_id, digest: the line keys that a document must lose, as another document of smaller doc_id has them."""
    spark = docs.sparkSession
    # a key's digest stands for it: the count below is exact but for SHA-256 collisions
    keys = cut(docs.mapInArrow(_keys, "doc_id long, digest binary"))
    n = keys.count()
    buckets = max(1, -(-n // BUCKET_KEYS))
    tasks = min(buckets, shuffle_width(spark))
    seen = keys.mapInArrow(_seen(buckets), "bucket int, digest binary, twice boolean").repartition(tasks, "bucket").sortWithinPartitions("bucket")
    filters = cut(seen.mapInArrow(_filters, "bucket int, bits binary"))
    rows = keys.mapInArrow(_tag(buckets), "bucket int, salt int, doc_id long, digest binary").withColumn("bits", F.lit(None).cast("binary"))
    copies = filters.select("bucket", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("salt"), F.lit(None).cast("long").alias("doc_id"), F.lit(None).cast("binary").alias("digest"), "bits")
    streams = rows.unionByName(copies).repartition(shuffle_width(spark), "bucket", "salt").sortWithinPartitions("bucket", "salt", F.col("bits").isNull())
    suspects = cut(streams.mapInArrow(_suspects, "doc_id long, digest binary"))
    first = cut(suspects.groupBy("digest").agg(F.min("doc_id").alias("first"), F.max("doc_id").alias("last"), F.count("*").alias("rows")).where("first < last"))
    return join_hot(suspects, first, ["digest"], "rows").where("doc_id > first").select("doc_id", "digest").distinct()


def _tag(buckets: int) -> Callable:
    def run(batches):
        for batch in batches:
            if batch.num_rows:
                w = _words(batch.column("digest"))
                doc = batch.column("doc_id").to_numpy()
                salt = ((doc.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(40)) % np.uint64(SALTS)
                yield pa.record_batch({"bucket": pa.array((w[:, 0] % np.uint64(buckets)).astype(np.int32)), "salt": pa.array(salt.astype(np.int32)), "doc_id": batch.column("doc_id"), "digest": batch.column("digest")})

    return run


def drop_repeated_lines(docs: DataFrame) -> DataFrame:
    """doc_id, text, n_lines, n_dropped, kept_sha256: one row per row of docs (doc_id integer, text string).

    A line's key is the line without `[\\x20\\x09-\\x0D]` at both ends, A-Z lower-cased. Keys of LEAST code points or
    more that two documents or more hold lose all their lines but in the smallest doc_id of those; within that
    document repeats stay. Null and empty texts are one empty line. Rows of one doc_id count as one document. Rows
    without doc_id take no part: they keep all lines and make no line a repeat. Other columns are ignored; an empty
    table gives no rows. Carriage returns at line ends belong to the line and stay with it.
    """
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    # a document's list is no longer than its own lines
    drops = cut(repeated_lines(docs).groupBy(F.col("doc_id").alias("id")).agg(F.collect_list("digest").alias("drops")))
    size = drops.agg(F.count("*"), F.coalesce(F.sum(F.size("drops")), F.lit(0))).first()
    both = docs.join(small(drops, size[0] + size[1], 48), F.col("doc_id") == F.col("id"), "left").select("doc_id", "text", "drops")
    return both.mapInArrow(_apply, "doc_id long, text string, n_lines long, n_dropped long, kept_sha256 string")
