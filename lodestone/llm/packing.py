"""Packing documents into sequences by vector best-fit.

A sequence has three capacities: tokens, documents, and attention cost (the sum of squared lengths). Pieces go in by
falling length; each takes, of the open sequences that have room in every respect, the one whose residuals fit best by
the rule: least norm of what would be left, or largest dot product of residuals and piece. Pieces of one length are
alike, so the search runs over the histogram of lengths and over classes of sequences with the same residuals: its
size depends on the capacity, not on the rows. It yields patterns of lengths with their numbers of sequences. Each
piece then finds its place by its rank among the pieces of its length.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field
from math import isqrt

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lodestone.llm.common import shared_path, small
from lodestone.llm.subwords import Ragged, Words, byte_bpe, byte_bpe_ids, byte_bpe_sizes, encode_words, runs, texts_of

CAPACITY = 1024
#: The id after each document.
END = 2
#: (rule, weights of tokens, documents and attention cost); of several, the plan with the fewest sequences counts.
RULES = (("norm", (1.0, 0.0, 0.0)), ("norm", (1.0, 0.1, 0.1)), ("dot", (1.0, 0.1, 0.1)))


@dataclass(frozen=True)
class Capacities:
    """Of a sequence. By default, only tokens bind: no more documents fit, and no more cost can arise."""

    tokens: int = CAPACITY
    documents: int | None = None
    attention: int | None = None

    @property
    def all(self) -> tuple[int, int, int]:
        return self.tokens, self.tokens if self.documents is None else self.documents, self.tokens**2 if self.attention is None else self.attention

    @property
    def piece(self) -> int:
        """Tokens of the longest piece that a sequence can hold."""
        return min(self.tokens, isqrt(self.all[2]))


@dataclass
class Plan:
    """Places by length: run i of `length` takes ranks from `first` on; the j-th of the run goes to sequence
    `sequence + j`, at `offset`."""

    sequences: int = 0
    runs: dict[int, list[tuple[int, int, int]]] = field(default_factory=dict)


def best_fit(counts: dict[int, int], caps: Capacities, rule: str = "norm", weights: tuple[float, float, float] = (1.0, 0.0, 0.0)) -> list[tuple[tuple[int, ...], int]]:
    """(lengths, number of sequences) so that all pieces of the histogram are placed.

    The same as best-fit of one piece at a time by falling length: while the sequence just used stays the best, it is
    filled on, and all sequences of its class are treated alike. Of equally good classes the one opened first counts.
    """
    if counts and max(counts) > caps.piece:
        raise ValueError(f"no sequence can hold {max(counts)} tokens")
    scale, w = np.array(caps.all, float), np.array(weights)
    size = 64
    left, much = np.zeros((size, 3), np.int64), np.zeros(size, np.int64)
    content: list[tuple[tuple[int, ...], int] | None] = [None] * size
    used, done = 0, []

    def score(residuals: np.ndarray, v: np.ndarray) -> np.ndarray:
        fits = (residuals >= v).all(axis=-1)
        rest = (residuals - v) / scale
        s = -(w * rest * rest).sum(axis=-1) if rule == "norm" else (w * residuals / scale * (v / scale)).sum(axis=-1)
        return np.where(fits, s, -np.inf)

    shortest = min(counts, default=1)
    least = np.array([shortest, 1, shortest**2])
    for length in sorted(counts, reverse=True):
        c, v = counts[length], np.array([length, 1, length * length])
        while c:
            scores = score(left[:used], v)
            scores[much[:used] == 0] = -np.inf
            best = int(scores.argmax()) if used else -1
            if best < 0 or scores[best] == -np.inf:
                r, n, before, other, best = np.array(caps.all), c, (), -np.inf, -1
            else:
                r, n, before = left[best], int(much[best]), content[best]
                # the others of this class stay as good as they are while there are any
                if n == 1:
                    scores[best] = -np.inf
                other = scores.max()
            t = 0
            while t < c and (r >= v).all() and (t == 0 or score(r, v) >= other):
                r, t = r - v, t + 1
            m = min(n, c // t)
            c -= m * t
            if best >= 0:
                much[best] -= m
            lengths = (before, length, t)
            if not (r >= least).all():
                done.append((lengths, m))
                continue
            if used == size:
                keep = np.flatnonzero(much[:used])
                left[: len(keep)], much[: len(keep)] = left[keep], much[keep]
                content[: len(keep)] = [content[k] for k in keep]
                used = len(keep)
                if used > size // 2:
                    left, much, content, size = np.concatenate([left, np.zeros_like(left)]), np.concatenate([much, np.zeros_like(much)]), content + [None] * size, 2 * size
            left[used], much[used], content[used] = r, m, lengths
            used += 1
    done += [(content[i], int(much[i])) for i in range(used) if much[i]]

    def spelt(chain: tuple) -> tuple[int, ...]:
        out = []
        while chain:
            chain, length, t = chain
            out.append((length,) * t)
        return tuple(x for part in reversed(out) for x in part)

    return [(spelt(chain), m) for chain, m in done]


def make_plan(counts: dict[int, int], caps: Capacities, rules=RULES) -> Plan:
    """The plan with the fewest sequences of those by the rules; the first, if several have as few."""
    patterns = min((best_fit(counts, caps, *r) for r in rules), key=lambda p: sum(m for _, m in p))
    plan, first = Plan(), {}
    for lengths, m in patterns:
        offset = 0
        for x in lengths:
            plan.runs.setdefault(x, []).append((first.get(x, 0), plan.sequences, offset))
            first[x] = first.get(x, 0) + m
            offset += x
        plan.sequences += m
    return plan


def cut_documents(docs: DataFrame, model: str, caps: Capacities = Capacities(), end: int = END, with_ids: bool = False) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32, and part and nth: the how-manieth of its length the task `part` makes.

    A document is its ids and `end`. Longer ones than a piece may be are cut from the back, so that only the first
    piece is shorter. with_ids adds the ids themselves.
    """
    spark, most = docs.sparkSession, caps.piece
    shared = spark.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokenizer, stored = byte_bpe(shared.value), Ragged(np.uint32)
        sizes = byte_bpe_sizes(tokenizer)
        part, had = TaskContext.get().partitionId(), np.zeros(most + 1, np.int64)

        def learn(new: list[str]) -> None:
            stored.extend(*encode_words(new, lambda t: byte_bpe_ids(tokenizer, t), sizes))

        words = Words(learn, lambda: stored.__init__(np.uint32), first_space=False)
        for batch in batches:
            for docs_part, texts in texts_of(batch, "text"):
                number, n_words = words.numbers(texts)
                size = np.append(0, np.cumsum(stored.sizes(number)))
                bounds = size[np.append(0, np.cumsum(n_words))]
                total = np.diff(bounds) + 1
                ids = np.full(int(total.sum()), end, np.uint32)
                begin = np.cumsum(total) - total
                ids[runs(begin, total - 1)] = stored.take(number)
                pieces = -(-total // most)
                doc = np.repeat(np.arange(len(total)), pieces)
                piece = runs(np.zeros(len(total), np.int64), pieces)
                start = np.maximum(0, total[doc] - (pieces[doc] - piece) * most)
                length = total[doc] - (pieces[doc] - piece - 1) * most - start
                # counted by length, over all batches of the task
                order = np.argsort(length, kind="stable")
                same = length[order]
                nth = np.empty(len(length), np.int64)
                nth[order] = np.arange(len(same)) - np.searchsorted(same, same) + had[same]
                had += np.bincount(length, minlength=most + 1)
                at = begin[doc] + start
                le = ids.astype("<u4")
                crc = [zlib.crc32(le[i : i + n].data) for i, n in zip(at.tolist(), length.tolist(), strict=True)]
                columns = [docs_part.column(0).take(pa.array(doc)), pa.array(piece.astype(np.int32)), *map(pa.array, (start, length)), pa.array(crc, pa.int64()), pa.array(np.full(len(doc), part)), pa.array(nth)]
                names = ["doc_id", "piece", "start", "length", "ids_crc32", "part", "nth"]
                if with_ids:
                    columns.append(pa.ListArray.from_arrays(pa.array(np.append(0, np.cumsum(length)).astype(np.int32)), pa.array(ids[runs(at, length)].astype(np.int32))))
                    names.append("ids")
                yield pa.RecordBatch.from_arrays(columns, names)

    kind = docs.schema["doc_id"].dataType.simpleString()
    schema = f"doc_id {kind}, piece int, start long, length long, ids_crc32 long, part long, nth long" + (", ids array<int>" if with_ids else "")
    return docs.select("doc_id", "text").mapInArrow(run, schema)


def pack(docs: DataFrame, model: str, caps: Capacities = Capacities(), rules=RULES, end: int = END, with_ids: bool = False) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32, sequence_id, offset (and ids) of all pieces of docs (doc_id, text).

    model: JSON of the tokenizer. Null and empty texts are `end` alone; repeated rows and null keys are documents like
    others; texts of any length are encoded whole; further columns play no part. No documents give no rows. Pieces of
    one length are numbered over all tasks by the counts of the tasks before, so no length meets in one task. Where
    rows are dealt otherwise to tasks, another of several equal-sized pieces may take a place; the number of sequences
    and their lengths stay.
    """
    spark = docs.sparkSession
    path = shared_path(spark, "pieces")
    cut_documents(docs, model, caps, end, with_ids).write.parquet(path)
    pieces = spark.read.parquet(path)
    per_part = pieces.groupBy("part", "length").agg(F.count("*").alias("n"))
    by = Window.partitionBy("length").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    heads = per_part.select("part", "length", F.coalesce(F.sum("n").over(by), F.lit(0).cast("long")).alias("head"))
    counts = {r["length"]: r["n"] for r in per_part.groupBy("length").agg(F.sum("n").alias("n")).collect()}
    plan = make_plan(counts, caps, rules)
    # runs in order of length and rank: a piece's run is the last that isn't after it
    table = np.array([(x, *r) for x in sorted(plan.runs) for r in plan.runs[x]], np.int64).reshape(-1, 4)
    before = np.append(0, np.cumsum([counts.get(x, 0) for x in range(1, caps.piece + 1)]))
    starts = before[table[:, 0] - 1] + table[:, 1]
    shared = spark.sparkContext.broadcast((starts, table, before))
    rows = pieces.join(small(heads, per_part.count(), 40), ["part", "length"])
    out = ["doc_id", "piece", "start", "length", "ids_crc32", *(["ids"] if with_ids else [])]
    placed = rows.select(*out, (F.col("head") + F.col("nth")).alias("rank"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        starts, table, before = shared.value
        for b in batches:
            length, rank = b.column("length").to_numpy(), b.column("rank").to_numpy()
            i = np.searchsorted(starts, before[length - 1] + rank, side="right") - 1
            sequence = table[i, 2] + rank - table[i, 1]
            yield pa.RecordBatch.from_arrays([*(b.column(c) for c in out), pa.array(sequence), pa.array(table[i, 3])], [*out, "sequence_id", "offset"])

    kinds = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in placed.select(*out).schema)
    return placed.mapInArrow(run, f"{kinds}, sequence_id long, offset long")


def sequences(packed: DataFrame) -> DataFrame:
    """sequence_id, ids, and starts (where each document's piece begins), of pieces packed with their ids."""
    rows = packed.groupBy("sequence_id").agg(F.array_sort(F.collect_list(F.struct("offset", "ids"))).alias("p"))
    return rows.select("sequence_id", F.flatten(F.transform("p", lambda x: x["ids"])).alias("ids"), F.transform("p", lambda x: x["offset"]).alias("starts"))
