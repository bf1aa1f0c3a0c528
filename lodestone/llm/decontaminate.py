"""Benchmark decontamination with SimHash windows.

Each benchmark item of n words is compared with the n-word windows of every document. Windows and items have 128-bit
SimHash fingerprints of their five-word shingles; a multi-index over eight 16-bit blocks finds all items within RADIUS
bits of a window (with eight blocks one differs in no more than RADIUS // 8 bits, and all such values are probed), and
the exact similarity of the shingles, weighted by how often each occurs, verifies them. Only windows that hold enough
shingles of items of their size for the threshold get a fingerprint: others can't reach it with any item.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from itertools import chain, combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestone.llm.common import Texts, cut, mix, shared_path, shingles, small, sub_batches

WIDTH = 5
PERCENT = 80
#: At the threshold two fingerprints differ in 19 of 128 bits on average, with a standard deviation of 4.
RADIUS = 39
#: Items are searched for in blocks of so many bytes of text; each block is one pass.
BLOCK_BYTES = 16 << 20
_MASKS = np.array([sum(1 << b for b in c) for r in range(RADIUS // 8 + 1) for c in combinations(range(16), r)], dtype=np.uint16)
_SHIFT = np.arange(64, dtype=np.uint64)


def _signs(s: np.ndarray) -> np.ndarray:
    """-1 or 1 for each shingle and fingerprint bit."""
    both = np.stack([mix(s + np.uint64(1)), mix(s ^ np.uint64(0xA5A5A5A5A5A5A5A5))], axis=1)
    return (((both[:, :, None] >> _SHIFT) & np.uint64(1)).astype(np.int8) * 2 - 1).reshape(len(s), 128)


def _pack(sums: np.ndarray) -> np.ndarray:
    """Fingerprints as rows of eight 16-bit blocks."""
    return np.packbits(sums > 0, axis=1).view(np.uint16)


def _weighted(a: np.ndarray, b: np.ndarray) -> tuple[int, int]:
    """Sums of the smaller and of the larger counts of each shingle."""
    every = np.unique(np.concatenate([a, b]))
    x, y = (np.bincount(np.searchsorted(every, v), minlength=len(every)) for v in (a, b))
    return int(np.minimum(x, y).sum()), int(np.maximum(x, y).sum())


class Items:
    """The index of a block of items."""

    def __init__(self, ids: list[int], texts: list[str], percent: int = PERCENT):
        self.percent, self.ids, self.shingles, prints = percent, [], [], []
        sized: dict[tuple[int, int], list[np.ndarray]] = {}
        self.widths: dict[int, dict[int, int]] = {}  # shingle width: {shingles of an item: words of it}
        h, bounds = Texts(pa.array(texts, pa.string())).words()
        for item, i, j in zip(ids, bounds[:-1], bounds[1:], strict=True):
            if i < j:
                s = shingles(h[i:j], WIDTH)
                self.ids.append(item)
                self.shingles.append(s)
                self.widths.setdefault(min(WIDTH, int(j - i)), {})[len(s)] = int(j - i)
                sized.setdefault((min(WIDTH, int(j - i)), len(s)), []).append(s)
                prints.append(_signs(s).sum(0))
        self.known = np.unique(np.concatenate(self.shingles)) if self.ids else np.zeros(0, np.uint64)
        self.of_size = {k: np.unique(np.concatenate(v)) for k, v in sized.items()}
        self.prints = _pack(np.array(prints)) if prints else np.zeros((0, 8), np.uint16)
        self.order = [np.argsort(self.prints[:, b], kind="stable") for b in range(8)]
        self.starts = [np.searchsorted(self.prints[o, b], np.arange(65537)) for b, o in enumerate(self.order)]

    def within(self, prints: np.ndarray) -> list[np.ndarray]:
        """For each fingerprint, the items that differ in RADIUS bits or fewer."""
        out = []
        for p in prints:
            found = [np.zeros(0, np.int64)]
            for b in range(8):
                probe = (_MASKS ^ p[b]).astype(np.int64)
                i, j = self.starts[b][probe], self.starts[b][probe + 1]
                found += [self.order[b][x:y] for x, y in zip(i[i < j], j[i < j], strict=True)]
            near = np.unique(np.concatenate(found))
            out.append(near[np.bitwise_count(self.prints[near] ^ p).sum(1) <= RADIUS])
        return out

    def search(self, column: pa.Array) -> list[tuple[int, int, float, int, int]]:
        """(row, item_id, similarity, first word, words) of the best window of each text and item, over all texts."""
        h, bounds = Texts(column).words()
        prints, where = [], []  # where: (row, start, shingles of the window, words, shingle hashes)
        for row, (i, j) in enumerate(zip(bounds[:-1], bounds[1:], strict=True)):
            for width, lengths in self.widths.items():
                if j - i < width:
                    # a shorter text has no shingle of this width; its only one can't equal an item's
                    continue
                s = shingles(h[i:j], width)
                at = np.searchsorted(self.known, s)
                at[at == len(self.known)] = 0
                hit = self.known[at] == s
                if not hit.any():
                    continue
                hits = np.flatnonzero(hit)
                for size, words in lengths.items():
                    # items of this size only: a window of a longer item's words is no candidate for them
                    own = hits[np.isin(s[hits], self.of_size[width, size])]
                    k = min(size, len(s))
                    need = -(-self.percent * (size + k) // (100 + self.percent))
                    if len(own) < need:
                        continue
                    total = np.zeros(len(s) + 1, np.int64)
                    total[own + 1] = 1
                    total = np.cumsum(total)
                    starts = np.flatnonzero(total[k:] - total[:-k] >= need)
                    if len(starts):
                        # running sums over stretches with hits only
                        for a, b in _stretches(starts, k):
                            c = np.zeros((b - a + 1, 128), np.int32)
                            np.cumsum(_signs(s[a:b]), axis=0, out=c[1:], dtype=np.int32)
                            own = starts[(starts >= a) & (starts + k <= b)] - a
                            prints.append(_pack(c[own + k] - c[own]))
                            where += [(row, int(x) + a, k, min(words, int(j - i)), s[x + a : x + a + k]) for x in own]
        if not where:
            return []
        prints = np.concatenate(prints)
        keys, inverse = np.unique(prints.view("V16").ravel(), return_inverse=True)
        near = self.within(keys.view(np.uint16).reshape(-1, 8))
        best: dict[tuple[int, int], tuple[float, int, int]] = {}
        seen: dict[tuple[bytes, int], tuple[int, int]] = {}
        for (row, start, _, words, s), k in zip(where, inverse, strict=True):
            for item in near[k]:
                key = (s.tobytes(), int(item))
                if key not in seen:
                    seen[key] = _weighted(s, self.shingles[item])
                low, high = seen[key]
                if 100 * low >= self.percent * high:
                    place = (row, self.ids[item])
                    best[place] = max(best.get(place, (0.0, 0, 0)), (low / high, -start, words))
        return [(row, item, sim, -start, words) for (row, item), (sim, start, words) in sorted(best.items())]


def _stretches(starts: np.ndarray, k: int) -> list[tuple[int, int]]:
    """The windows' starts merged to (from, to) stretches of at most a few windows' length."""
    out: list[tuple[int, int]] = []
    for x in starts.tolist():
        if out and x <= out[-1][1] and out[-1][1] - out[-1][0] < 64 * k + 4096:
            out[-1] = (out[-1][0], x + k)
        else:
            out.append((x, x + k))
    return out


def item_blocks(benchmark: DataFrame, percent: int = PERCENT, most: int = BLOCK_BYTES, unnamed: bool = False) -> Iterator[Items]:
    """The benchmark (item_id, text) in blocks of about `most` bytes, one at a time, whatever ids its items have; an empty
    one is a block too. Items without words match nothing. unnamed: items without item_id are in too, as item 0."""
    named = benchmark if unnamed else benchmark.where("item_id is not null")
    rows = named.select(F.coalesce(F.col("item_id").cast("long"), F.lit(0).cast("long")).alias("item_id"), "text").where(F.col("text").isNotNull())
    ids, texts, size = [], [], 0
    for r in rows.orderBy("item_id", "text").toLocalIterator():
        if size > most:
            yield Items(ids, texts, percent)
            ids, texts, size = [], [], 0
        ids.append(r["item_id"])
        texts.append(r["text"])
        size += len(r["text"].encode())
    yield Items(ids, texts, percent)


def _each_block(rows: DataFrame, blocks: Iterator[Items], run: Callable, schema: str) -> DataFrame:
    """What run(broadcast block) makes of rows, for several blocks: each is broadcast and used, and its rows are written,
    before the next one is made."""
    spark, path = rows.sparkSession, shared_path(rows.sparkSession, "leaks")
    for k, block in enumerate(blocks):
        shared = spark.sparkContext.broadcast(block)
        rows.mapInArrow(run(shared), schema).write.parquet(f"{path}/block={k}")
        shared.destroy()
    return spark.read.schema(f"{schema}, block int").parquet(path).drop("block")


def _hits(shared, *more: str) -> Callable:
    """The best windows of each text and item of a block; more: columns of the rows that go along."""

    def run(batches):
        for batch in batches:
            for part in sub_batches(batch, "text"):
                found = shared.value.search(part.column("text"))
                row, item, sim, start, words = zip(*found, strict=True) if found else [()] * 5
                at = pa.array(row, pa.int64())
                facts = {"item_id": pa.array(item, pa.int64()), "similarity": pa.array(sim, pa.float64()), "first_word": pa.array(start, pa.int64()), "n_words": pa.array(words, pa.int64())}
                yield pa.record_batch({"doc_id": part.column("doc_id").take(at), **facts, **{c: part.column(c).take(at) for c in more}})

    return run


def contaminated(docs: DataFrame, benchmark: DataFrame, percent: int = PERCENT, most: int = BLOCK_BYTES) -> DataFrame:
    """doc_id, item_id, similarity, first_word, n_words: the best window of each row of docs that holds an item.

    docs: doc_id integer, text string; benchmark: item_id integer, text string. An item is held if the weighted
    Jaccard similarity of its five-word shingles and those of a window of as many words (of the whole text, if that
    is shorter) is percent / 100 or more; words are compared with A-Z lower-cased. Items of fewer than five words are
    one shingle, and so are windows for them. Of equal windows the first counts. Null or empty texts hold nothing;
    rows that repeat are each reported; rows without doc_id are reported with null; items that share an item_id are
    searched for each, and the best window is reported. Texts of any length are searched whole. Items without item_id
    or text, an empty benchmark or an empty table give no rows. Other columns are ignored. most: see item_blocks.
    """
    blocks = item_blocks(benchmark, percent, most)
    first = next(blocks)
    following = next(blocks, None)
    thin = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    schema = "doc_id long, item_id long, similarity double, first_word long, n_words long"
    if following is None:
        return thin.mapInArrow(_hits(docs.sparkSession.sparkContext.broadcast(first)), schema)
    # the texts of one item_id may be in several blocks: its best window is that of all of them
    path = shared_path(docs.sparkSession, "searched")
    thin.withColumn("row", F.monotonically_increasing_id()).write.parquet(path)
    rows = docs.sparkSession.read.schema("doc_id long, text string, row long").parquet(path)
    found = _each_block(rows, chain([first, following], blocks), lambda shared: _hits(shared, "row"), f"{schema}, row long")
    best = F.max(F.struct("similarity", (-F.col("first_word")).alias("at"), "n_words")).alias("b")
    return found.groupBy("row", "doc_id", "item_id").agg(best).select("doc_id", "item_id", "b.similarity", (-F.col("b.at")).alias("first_word"), "b.n_words")


def clean_documents(docs: DataFrame, benchmark: DataFrame, percent: int = PERCENT, most: int = BLOCK_BYTES) -> DataFrame:
    """The rows of docs, with all their columns, whose text holds no benchmark item (see contaminated), with item_id or without."""
    blocks = item_blocks(benchmark, percent, most, unnamed=True)
    first = next(blocks)
    following = next(blocks, None)
    if following is None:
        return docs.mapInArrow(_kept(docs.sparkSession.sparkContext.broadcast(first)), docs.schema)
    path, schema = shared_path(docs.sparkSession, "searched"), docs.schema
    docs.select(F.struct("*").alias("all"), "text", F.monotonically_increasing_id().alias("row")).write.parquet(path)
    rows = docs.sparkSession.read.parquet(path)
    gone = _each_block(rows.select(F.lit(None).cast("long").alias("doc_id"), "text", "row"), chain([first, following], blocks), lambda shared: _hits(shared, "row"), "doc_id long, item_id long, similarity double, first_word long, n_words long, row long")
    gone = cut(gone.select("row").distinct())
    left = rows.join(small(gone, gone.count(), 16), "row", "left_anti")
    return left.select(*(F.col("all")[c].alias(c) for c in schema.names))


def _kept(shared) -> Callable:
    def run(batches):
        for batch in batches:
            for part in sub_batches(batch, "text"):
                keep = np.ones(part.num_rows, bool)
                keep[[r[0] for r in shared.value.search(part.column("text"))]] = False
                yield part.filter(pa.array(keep))

    return run
