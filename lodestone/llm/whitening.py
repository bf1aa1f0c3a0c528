"""Whitening of embeddings with an exact scatter matrix in residue numbers.

Vectors become whole numbers x. The scatter of (1, x) over the distinct x is summed modulo several primes: per block one
matrix product of residues for each prime, small enough that doubles hold it exactly. Residues add up over partitions
in any order, and Chinese remaindering of the few sums (their number depends on the dimension alone) gives the exact
count, sums and products. From these follows n*n times the covariance as whole numbers, rounded once, and its
eigenvectors in double precision.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from math import prod

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestone.llm.common import shared_path

SCALE = 256
COMPONENTS = 4
#: Residues are at most half of this in size, so that BLOCK products of two add up below 2**53.
PRIMES_BELOW = 1 << 20
BLOCK = 1 << 14
_LEAST, _MOST = -(1 << 63), (1 << 63) - 1


def primes(bound: int, below: int = PRIMES_BELOW) -> list[int]:
    """The largest primes under `below`, so many that their product is over `bound`."""
    out, p = [], below - 1
    while prod(out) <= bound:
        if all(p % d for d in range(2, int(p**0.5) + 1)):
            out.append(p)
        p -= 1
    return out


def remainders_to_int(residues: list[int], mods: list[int]) -> int:
    """The whole number nearest to 0 that has these residues."""
    whole = prod(mods)
    x = sum(r * (whole // p) * pow(whole // p, -1, p) for r, p in zip(residues, mods, strict=True)) % whole
    return x - whole if x > whole // 2 else x


def whole_numbers(vectors: pa.Array, dim: int | None = None) -> tuple[np.ndarray, dict[int, tuple[np.ndarray, np.ndarray]]]:
    """(usable rows, {dimension: (rows, their x)}) of a list column; of one dimension only, if it is given.

    Null vectors and those with null, infinite or NaN entries aren't usable. Beyond 64 bits x is the nearest end.
    """
    vectors = vectors.combine_chunks() if isinstance(vectors, pa.ChunkedArray) else vectors
    lists = vectors.cast(pa.large_list(pa.float64()))
    offsets = np.asarray(lists.offsets)
    start, size = offsets[:-1], np.diff(offsets)
    flat = np.asarray(lists.values.to_numpy(zero_copy_only=False), dtype=np.float64)
    bad = np.append(0, np.cumsum(~np.isfinite(flat)))
    size = np.where(np.asarray(lists.is_valid()), size, 0)
    usable = np.asarray(lists.is_valid()) & (bad[start + size] == bad[start])
    out = {}
    for d in [dim] if dim is not None else np.unique(size[usable]):
        rows = np.flatnonzero(usable & (size == d))
        value = np.floor(flat[start[rows][:, None] + np.arange(d)] * SCALE)
        x = np.clip(value, -9.3e18, 9.3e18)
        inside = np.abs(x) < 2.0**63
        out[int(d)] = rows, np.where(inside, np.where(inside, x, 0).astype(np.int64), np.where(x < 0, _LEAST, _MOST))
    return usable, out


@dataclass
class Fit:
    """n vectors of the fit list, their sums, eigenvalues (falling) and unit eigenvectors (columns) of the covariance."""

    n: int
    dim: int
    sums: list[int]
    values: np.ndarray
    vectors: np.ndarray
    trace: float
    most: int
    identity_error: float = 0.0

    def project(self, x: np.ndarray, k: int) -> np.ndarray:
        """The first k whitened coordinates; 0 along directions in which the fit list doesn't vary."""
        mean = np.array([s / self.n for s in self.sums])
        e = self.values[:k]
        live = e > max(self.trace, 0.0) * 1e-14
        return (x - mean) @ self.vectors[:, :k] * np.where(live, 1 / np.sqrt(np.where(live, e, 1.0)), 0.0)


def fit(vectors: DataFrame, column: str = "embedding", components: int = COMPONENTS) -> Fit | None:
    """The whitening of a table's vectors; None without a usable one.

    The fit list is each distinct x once; copies fall together before they are shuffled. Where vectors have several
    dimensions, those of the commonest (of equally common ones, the largest) count, the others are like null ones.
    """
    spark = vectors.sparkSession
    only = vectors.select(F.col(column).alias("v"))

    def survey(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found = whole_numbers(b.column(0))[1]
            for d, (rows, x) in found.items():
                most = max(int(x.max()), -int(x.min())) if x.size else 0
                yield pa.RecordBatch.from_pydict({"d": [d], "n": [len(rows)], "bits": [most.bit_length()]})

    seen = only.mapInArrow(survey, "d long, n long, bits long").groupBy("d").agg(F.sum("n").alias("n"), F.max("bits").alias("bits")).where("d > 0").orderBy(F.desc("n"), F.desc("d")).first()
    if seen is None:
        return None
    dim, bits = seen["d"], seen["bits"]
    # x as bytes, no wider than its values need
    kind = np.dtype("<i2" if bits < 15 else "<i4" if bits < 31 else "<i8")

    def packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            _, x = whole_numbers(b.column(0), dim)[1][dim]
            rows = pa.FixedSizeBinaryArray.from_buffers(pa.binary(dim * kind.itemsize), len(x), [None, pa.py_buffer(np.ascontiguousarray(x.astype(kind)))])
            yield pa.RecordBatch.from_arrays([rows.cast(pa.binary())], ["x"])

    path = shared_path(spark, "fit-list")
    only.mapInArrow(packed, "x binary").distinct().write.parquet(path)
    fit_list = spark.read.schema("x binary").parquet(path)

    def blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[np.ndarray]:
        for b in batches:
            for at in range(0, b.num_rows, BLOCK):
                yield np.frombuffer(b"".join(b.column(0).slice(at, BLOCK).to_pylist()), kind).reshape(-1, dim).astype(np.int64)

    mods = primes(2 * seen["n"] * (1 << 2 * bits))
    upper = np.triu_indices(dim + 1)

    def scatter(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = np.zeros((len(mods), len(upper[0])), np.int64)
        for x in blocks(batches):
            for i, p in enumerate(mods):
                r = np.ones((len(x), dim + 1))
                r[:, 1:] = (x + p // 2) % p - p // 2 if bits < 62 else x % p - np.where(x % p > p // 2, p, 0)
                sums[i] = (sums[i] + (r.T @ r)[upper].astype(np.int64)) % p
        for i in range(len(mods)):
            yield pa.RecordBatch.from_arrays([pa.array(np.full(sums.shape[1], i)), pa.array(np.arange(sums.shape[1])), pa.array(sums[i])], ["prime", "entry", "r"])

    sums = np.zeros((len(mods), len(upper[0])), np.int64)
    reduced = fit_list.mapInArrow(scatter, "prime long, entry long, r long").groupBy("prime", "entry").agg(F.sum("r").alias("r")).toArrow()
    sums[reduced["prime"].to_numpy(), reduced["entry"].to_numpy()] = reduced["r"].to_numpy()
    whole = {(i, j): remainders_to_int([int(v) for v in sums[:, k]], mods) for k, (i, j) in enumerate(zip(*map(list, upper), strict=True))}
    n, s = whole[0, 0], [whole[0, j + 1] for j in range(dim)]
    cov = np.zeros((dim, dim))
    for i in range(dim):
        for j in range(i, dim):
            cov[i, j] = cov[j, i] = (n * whole[i + 1, j + 1] - s[i] * s[j]) / (n * n)
    values, axes = np.linalg.eigh(cov)
    values, axes = values[::-1], axes[:, ::-1]
    # the entry largest in size is positive, so that reruns agree
    axes = axes * np.where(axes[np.abs(axes).argmax(axis=0), np.arange(dim)] < 0, -1.0, 1.0)
    trace = sum(n * whole[i + 1, i + 1] - s[i] * s[i] for i in range(dim)) / (n * n)
    out = Fit(n, dim, s, values, axes, trace, 1 << bits)
    k = min(components, dim)

    def spread(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((k, k))
        for x in blocks(batches):
            w = out.project(x, k)
            total += w.T @ w
        yield pa.RecordBatch.from_pydict({"c": [c for c in range(k * k)], "v": total.ravel().tolist()})

    cells = {r["c"]: r["v"] for r in fit_list.mapInArrow(spread, "c long, v double").groupBy("c").agg(F.sum("v").alias("v")).collect()}
    out.identity_error = max(abs(cells[i * k + j] / n - (i == j)) for i in range(k) for j in range(k))
    return out


def deviations(x: np.ndarray, found: Fit) -> list[int | None]:
    """Of each row the sum of (n*x - S)**2, exact; null beyond 64 bits."""
    far = found.n * found.most + max(map(abs, found.sums))
    if far * far * found.dim <= _MOST:
        d = found.n * x - np.array(found.sums, np.int64)
        return (d * d).sum(axis=1).tolist()
    s = np.array(found.sums, object)
    return [v if (v := int(((found.n * row.astype(object) - s) ** 2).sum())) <= _MOST else None for row in x]


def whitened(vectors: DataFrame, key: str = "vec_id", column: str = "embedding", components: int = COMPONENTS) -> DataFrame:
    """key, component, n, deviation, whitened, explained, identity_error of each usable vector and component.

    Dropped are null vectors, those with null or non-finite entries, and those not of the commonest dimension (fit()).
    Repeated rows and null keys are rows like others; further columns play no part. There are as many components as
    dimensions, up to `components`. Where the fit list doesn't vary along one (a single vector, say), whitened is 0,
    which identity_error shows as 1; explained is 0 if nothing varies. deviation is null where it passes 64 bits. A
    table without usable vectors gives no rows. The driver holds matrices of the dimension's size, never vectors.
    """
    name = vectors.schema[key].dataType.simpleString()
    schema = f"{key} {name}, component int, n long, deviation long, whitened double, explained double, identity_error double"
    found = fit(vectors, column, components)
    if found is None:
        return vectors.sparkSession.createDataFrame([], schema)
    k = min(components, found.dim)
    share = found.values[:k] / found.trace if found.trace > 0 else np.zeros(k)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows, x = whole_numbers(b.column(1), found.dim)[1][found.dim]
            each = np.repeat(rows, k)
            m = len(each)
            columns = [b.column(0).take(pa.array(each)), np.tile(np.arange(1, k + 1, dtype=np.int32), len(rows)), np.full(m, found.n), pa.array(deviations(x, found), pa.int64()).take(pa.array(np.repeat(np.arange(len(rows)), k))), found.project(x, k).ravel(), np.tile(share, len(rows)), np.full(m, found.identity_error)]
            yield pa.RecordBatch.from_arrays([pa.array(c) if isinstance(c, np.ndarray) else c for c in columns], ["key", "component", "n", "deviation", "whitened", "explained", "identity_error"])

    return vectors.select(F.col(key).alias("key"), F.col(column).alias("v")).mapInArrow(run, schema.replace(f"{key} ", "key ", 1)).withColumnRenamed("key", key)
