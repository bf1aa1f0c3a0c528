"""What the operators share: the shared folder, lineage cuts, and vectorised word hashing.

Word hashing reads Arrow string buffers directly. Words are `[^\\x20\\x09-\\x0D]+` with A-Z lower-cased; each gets
a 64-bit hash, which all users take for the word. Words of up to 8 bytes of one length never share a hash. Longer ones
are mixed in 8 bytes at a time, each step a bijection of the state, so that two words that weren't made for it share a
hash with a chance of 2**-64; very long ones get a cryptographic digest cut to 64 bits.
"""

from __future__ import annotations

import hashlib
import tempfile
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: A side is broadcast only if it is known to be at most so large.
BROADCAST_BYTES = 32 << 20
WORD = r"[^\x20\x09-\x0D]+"
SPACE = r"[\x20\x09-\x0D]+"


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir. Where it is unset, a local one will do for a
    local master (tests) only."""
    sc = spark.sparkContext
    path = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get("spark.checkpoint.dir")
    if not path:
        set_by_hand = sc._jsc.sc().getCheckpointDir()
        if set_by_hand.isEmpty() and not sc.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        path = set_by_hand.get() if set_by_hand.isDefined() else tempfile.mkdtemp(prefix="lodestone-")
    if sc._jsc.sc().getCheckpointDir().isEmpty():
        sc.setCheckpointDir(path)
    return path


def shared_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"


def cut(df: DataFrame) -> DataFrame:
    """Computes df once and keeps it in the shared folder, where a lost executor doesn't take it along."""
    shared_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shuffle_width(spark: SparkSession) -> int:
    return max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))


def small(df: DataFrame, rows: int, row_bytes: int) -> DataFrame:
    """df, marked for broadcast if the counted rows fit BROADCAST_BYTES; else the planner picks a shuffled join."""
    return F.broadcast(df) if rows * row_bytes <= BROADCAST_BYTES else df


def join_hot(left: DataFrame, right: DataFrame, keys: list[str], rows: str, how: str = "inner", least: int = 1000) -> DataFrame:
    """left joined (inner or left) with right, which has one row per key, so that no key's rows meet in one task.

    rows: the column of right that says how many rows of left have the key. Keys with more than `least` rows and than
    a 2**17th of all are fewer than 2**17, and go by broadcast; the others shuffle. Both sides are read twice: cut
    them first.
    """
    total, most = right.agg(F.coalesce(F.sum(rows), F.lit(0)), F.coalesce(F.max(rows), F.lit(0))).first()
    limit = max(least, total >> 17)
    if most <= limit:
        return left.join(right, keys, how)
    hot = right.where(F.col(rows) > limit)
    cold = left.join(F.broadcast(hot.select(*keys)), keys, "left_anti").join(right.where(F.col(rows) <= limit), keys, how)
    return left.join(F.broadcast(hot), keys).unionByName(cold)


def crc32_of(col: str | Column) -> Column:
    """crc32 of an integer's decimal text; of null, that of the empty text."""
    col = F.col(col) if isinstance(col, str) else col
    return F.crc32(F.coalesce(col.cast("string"), F.lit("")).cast("binary"))


# ---------------------------------------------------------------- word hashing

_PIECE = 1 << 20
#: Words of more bytes are hashed one by one.
_LONG = 512
_SEED = np.uint64(0x9E3779B97F4A7C15)
_IS_SPACE = np.zeros(256, dtype=bool)
_IS_SPACE[[0x20, *range(0x09, 0x0E)]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += np.uint8(32)
#: The lower n bytes of a 64-bit word.
_BYTES = np.array([(1 << 8 * n) - 1 for n in range(9)], dtype=np.uint64)


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser: each input bit changes each output bit about half the time."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def word_hashes(b: np.ndarray, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """Hashes of the words b[i:j] of lower-cased bytes."""
    padded = np.append(b, np.zeros(8, np.uint8))
    eight = np.ndarray((len(b) + 1,), "<u8", padded, strides=(1,))
    size = j - i
    h = mix(size.astype(np.uint64) + _SEED)
    live = np.flatnonzero(size <= _LONG)
    at = 0
    while len(live):
        left = size[live] - at
        part = eight[i[live] + at] & _BYTES[np.minimum(left, 8)]
        h[live] = mix((h[live] ^ part) + _SEED)
        live = live[left > 8]
        at += 8
    for k in np.flatnonzero(size > _LONG):
        h[k] = int.from_bytes(hashlib.blake2b(b[i[k] : j[k]].tobytes(), digest_size=8).digest(), "little")
    return h


class Texts:
    """The texts of an Arrow string column. Null counts as empty.

    buf: UTF-8 bytes; starts, ends: of each text in buf.
    """

    def __init__(self, column: pa.Array | pa.ChunkedArray):
        if isinstance(column, pa.ChunkedArray):
            column = column.combine_chunks()
        if isinstance(column, pa.ChunkedArray):
            column = pa.concat_arrays(column.chunks)
        column = column.cast(pa.large_string())
        if column.null_count:
            column = column.fill_null("")
        self.n = len(column)
        _, offsets, data = column.buffers()
        off = np.frombuffer(offsets, dtype=np.int64)[column.offset : column.offset + self.n + 1] if self.n else np.zeros(1, np.int64)
        self.starts, self.ends = off[:-1], off[1:]
        self.buf = np.frombuffer(data, dtype=np.uint8) if data is not None and self.n else np.zeros(0, np.uint8)

    def _pieces(self) -> Iterator[tuple[int, int, np.ndarray]]:
        """(from, to, text starts within), of about _PIECE bytes; long texts are cut at a space."""
        if not self.n:
            return
        end, at = int(self.ends[-1]), int(self.starts[0])
        while at < end:
            to = min(end, at + _PIECE)
            if to < end:
                k = int(np.searchsorted(self.starts, to, side="right")) - 1
                if self.starts[k] > at:
                    to = int(self.starts[k])
                else:  # within one text: go on to the next space, or the text's end
                    stop = int(self.starts[k + 1]) if k + 1 < self.n else end
                    while to < stop:
                        found = np.flatnonzero(_IS_SPACE[self.buf[to : min(stop, to + 65536)]])
                        if len(found):
                            to += int(found[0])
                            break
                        to = min(stop, to + 65536)
            i, j = np.searchsorted(self.starts, [at, to], side="left")
            yield at, to, self.starts[i:j]
            at = to

    def spans(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Of all words: first byte, byte after the last, hash."""
        firsts, lasts, hashes = [], [], []
        for at, to, begins in self._pieces():
            b = self.buf[at:to]
            word = ~_IS_SPACE[b]
            begin = np.zeros(len(b) + 1, dtype=bool)
            begin[begins - at] = True
            begin[len(b)] = True
            first = word.copy()
            first[1:] &= ~word[:-1] | begin[1:-1]
            last = word.copy()
            last[:-1] &= ~word[1:] | begin[1:-1]
            i, j = np.flatnonzero(first), np.flatnonzero(last) + 1
            firsts.append(i + at)
            lasts.append(j + at)
            hashes.append(word_hashes(_LOWER[b], i, j))
        if not hashes:
            return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.uint64)
        return np.concatenate(firsts), np.concatenate(lasts), np.concatenate(hashes)

    def words(self) -> tuple[np.ndarray, np.ndarray]:
        """(hash of each word, bounds): text k has the words bounds[k]:bounds[k + 1]."""
        first, _, h = self.spans()
        return h, np.append(np.searchsorted(first, self.starts), len(h)) if self.n else np.zeros(1, np.int64)


def shingles(h: np.ndarray, n: int) -> np.ndarray:
    """Hashes of the n-word runs of one text, in order; of a shorter text, its whole sequence as one; of none, none."""
    if not len(h):
        return h
    width = min(n, len(h))
    acc = np.full(len(h) - width + 1, width, dtype=np.uint64)
    for i in range(width):
        acc = mix(acc * np.uint64(0x9E3779B97F4A7C15) + h[i : len(h) - width + 1 + i])
    return acc


def sub_batches(batch: pa.RecordBatch, column: str, most: int = 8 << 20) -> Iterator[pa.RecordBatch]:
    """Splits a batch so that the texts of each part have about `most` bytes at most (or are one text)."""
    if not batch.num_rows:
        return
    texts = Texts(batch.column(column))
    size = np.cumsum(texts.ends - texts.starts)
    at = 0
    while at < batch.num_rows:
        base = size[at - 1] if at else 0
        to = max(at + 1, int(np.searchsorted(size, base + most, side="right")))
        yield batch.slice(at, to - at)
        at = to
