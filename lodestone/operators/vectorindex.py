"""Exact nearest neighbours that leave out what can't be among them: vectors stored by cells of directions.

A cell has a centre and the smallest cosine of its vectors with it. No vector of a cell can be nearer to a query than
the angle between query and centre less the cell's widest angle; cells whose best possible similarity is below that of
the k-th neighbour found so far aren't read. The rows are those of a scan.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from math import isqrt

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestone.operators import knn

#: Vectors that centres are fitted on, at most: those of the smallest hashes of their ids.
SAMPLE = 20_000
MOST_CELLS = 4096
ROUNDS = 8
#: Vectors of one file, about.
PER_FILE = 1 << 18
#: Angles are taken to be so much smaller, for rounding.
SLACK = 1e-6


def _matrix(column: pa.Array) -> np.ndarray:
    return np.asarray(column.flatten(), dtype=np.float64).reshape(len(column), -1)


def centres(sample: np.ndarray, n: int, rounds: int = ROUNDS) -> np.ndarray:
    """Unit vectors: spherical k-means from n of the sample's rows, evenly spread; the empty ones stay where they are."""
    unit = sample / np.linalg.norm(sample, axis=1, keepdims=True)
    out = unit[np.linspace(0, len(unit) - 1, n).astype(int)]
    for _ in range(rounds):
        own = (unit @ out.T).argmax(axis=1)
        sums = np.zeros_like(out)
        np.add.at(sums, own, unit)
        size = np.linalg.norm(sums, axis=1, keepdims=True)
        out = np.where(size > 0, sums / np.where(size > 0, size, 1.0), out)
    return out


@dataclass(frozen=True)
class Cells:
    """A stored index. centre, low (smallest cosine of a cell's vectors with its centre) and n by cell."""

    spark: SparkSession
    path: str
    schema: str
    cell: np.ndarray
    centre: np.ndarray
    low: np.ndarray
    n: np.ndarray

    def vectors(self, cells: list[int] | None = None) -> DataFrame:
        rows = self.spark.read.schema(f"{self.schema}, cell int").parquet(f"{self.path}/vectors")
        return (rows if cells is None else rows.where(F.col("cell").isin(cells))).drop("cell")

    def bounds(self, query: list[float]) -> np.ndarray:
        """The best similarity that a vector of each cell could have."""
        q = np.array(query, float)
        size = np.linalg.norm(q)
        if not size:
            return np.full(len(self.cell), -1.0)
        apart = np.arccos(np.clip(self.centre @ (q / size), -1, 1)) - np.arccos(np.clip(self.low, -1, 1)) - SLACK
        return np.where(apart <= 0, 1.0, np.cos(np.minimum(apart, np.pi)))

    def needed(self, query: list[float], k: int, threshold: float = 0.0) -> list[int]:
        """The cells that hold the k nearest: first those that look best, then all that may hold a nearer one."""
        best = self.bounds(query)
        order = np.argsort(-best, kind="stable")
        first = order[: int(np.searchsorted(np.cumsum(self.n[order]), k)) + 1]
        found = knn.nearest(self.vectors(self.cell[first].tolist()), query, k, threshold).agg(F.count("*"), F.min("similarity")).first()
        least = max(threshold, found[1]) if found[0] == k else threshold
        return sorted({*self.cell[first].tolist(), *self.cell[best >= least].tolist()})

    def nearest(self, query: list[float], k: int, threshold: float = 0.0) -> DataFrame:
        """knn.nearest of all vectors."""
        return knn.nearest(self.vectors(self.needed(query, k, threshold)), query, k, threshold)


def write(vectors: DataFrame, path: str, cells: int | None = None) -> Cells:
    """An index of vectors (id, embedding of one length); null and zero vectors, which are near nothing, aren't in it.

    cells: their number, by default the root of the vectors'. The driver holds the sample and the centres.
    """
    spark = vectors.sparkSession
    rows = vectors.select("id", "embedding").where("embedding is not null and exists(embedding, x -> x <> 0)")
    total = rows.count()
    kinds = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in rows.schema)
    n = max(1, min(cells or isqrt(total), MOST_CELLS, total))
    sample = rows.orderBy(F.xxhash64("id"), "id").limit(SAMPLE).select("embedding").toArrow()["embedding"].combine_chunks() if total else None
    middle = centres(_matrix(sample), n) if total else np.zeros((1, 1))
    shared = spark.sparkContext.broadcast(middle)

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                x = _matrix(b.column(1))
                cosine = (x / np.linalg.norm(x, axis=1, keepdims=True)) @ shared.value.T
                own = cosine.argmax(axis=1)
                yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(own.astype(np.int32)), pa.array(cosine[np.arange(len(own)), own])], ["id", "embedding", "cell", "cosine"])

    files = max(1, -(-total // PER_FILE))
    salt = F.pmod(F.xxhash64("id"), F.lit(-(-files // n) * 4 if files > n else 1))
    placed = rows.mapInArrow(assign, f"{kinds}, cell int, cosine double").repartition(max(files, min(n, 64)), "cell", salt)
    placed.write.partitionBy("cell").parquet(f"{path}/vectors")
    facts = spark.read.schema(f"{kinds}, cosine double, cell int").parquet(f"{path}/vectors").groupBy("cell").agg(F.min("cosine").alias("low"), F.count("*").alias("n"))
    known = spark.createDataFrame([(i, c.tolist()) for i, c in enumerate(middle)], "cell int, centre array<double>")
    facts.join(F.broadcast(known), "cell").write.parquet(f"{path}/cells")
    return open_cells(spark, path, kinds)


def open_cells(spark: SparkSession, path: str, schema: str = "id long, embedding array<float>") -> Cells:
    rows = spark.read.parquet(f"{path}/cells").orderBy("cell").collect()
    if not rows:
        return Cells(spark, path, schema, np.zeros(0, int), np.zeros((0, 1)), np.zeros(0), np.zeros(0, int))
    return Cells(spark, path, schema, np.array([r.cell for r in rows]), np.array([r.centre for r in rows]), np.array([r.low for r in rows]), np.array([r.n for r in rows]))
