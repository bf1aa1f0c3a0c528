"""The size of the next batch, from how fast the last ones went: a search that carries state from step to step.

A run grows by 1, 2, 3, ... while its rate holds, then looks between the largest size known to be fast and the smallest
known to be slow until they are neighbours, and stays there; if the rate falls far below the best one it looks again, and
each PROBE steps it tries to grow.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame

# A rate under the last one's part is slower, one under the best one's part is far below; steps that grow
# whatever the rate; steps that stay before the next try; loads that shrink a batch to the least, and that end the run.
SLOWER, FAR_BELOW = 0.95, 0.80
WARM_UP, PROBE = 3, 8
CRITICAL, DANGER = 0.85, 0.90
# Least, most and first size by phase.
LIMITS = {"vlm": (1, 128, 2), "vv": (1, 256, 4), "mv": (2, 256, 16)}


@dataclass
class Search:
    """One run. fast, slow: the bounds found, None where there is none."""

    least: int
    most: int
    size: int
    mode: str = "growing"
    stride: int = 1
    fast: int | None = None
    slow: int | None = None
    grown: int = 0
    stayed: int = 0
    last: float | None = None
    best: float | None = None

    def after(self, rate: float, load: float = 0.0) -> tuple[int, str]:
        """(next size, why): growth, refine, locked, probe, emergency or abort. Under a high load nothing is learnt."""
        if load >= DANGER:
            return 0, "abort"
        if load >= CRITICAL:
            self.size, self.stride = self.least, 1
            return self.size, "emergency"
        slower = self.last is not None and self.last > 0 and rate < self.last * SLOWER
        why = {"growing": self._grow, "refining": self._refine}.get(self.mode, self._stay)(slower, rate)
        self.last = rate
        self.best = rate if self.best is None else max(self.best, rate)
        return self.size, why

    def _stride(self, limit: int) -> int:
        self.stride += 1
        return min(limit, self.size + self.stride - 1)

    def _settled(self) -> bool:
        """Whether no size is left between the bounds; then the fast one is it."""
        low, high = self.fast or self.least, self.slow or self.most
        if high - low > 1:
            return False
        self.size, self.mode = low, "locked"
        return True

    def _grow(self, slower: bool, rate: float) -> str:
        if self.grown < WARM_UP or not slower:
            self.fast, self.size, self.grown = self.size, self._stride(self.most), self.grown + 1
            return "growth"
        self.slow, self.stride, self.mode = self.size, 1, "refining"
        self.size = self.fast or max(self.least, self.size - 1)
        return "locked" if self._settled() else "refine"

    def _refine(self, slower: bool, rate: float) -> str:
        if slower:
            self.slow, self.stride = min(self.slow or self.size, self.size), 1
            if self.fast is not None and self.fast < self.size:
                self.size = self.fast
            else:
                self.size, self.fast = max(self.least, self.size - 1), None
        else:
            self.fast = max(self.fast or 0, self.size)
            self.size = max(self.size, self._stride((self.slow or self.most) - 1))
        return "locked" if self._settled() else "refine"

    def _stay(self, slower: bool, rate: float) -> str:
        if self.best is not None and self.best > 0 and rate < self.best * FAR_BELOW:
            self.fast, self.slow, self.stride, self.mode = None, None, 1, "refining"
            return "refine"
        self.stayed += 1
        if self.stayed < PROBE:
            return "locked"
        self.stayed, self.stride, self.mode = 0, 1, "growing"
        self.fast, self.slow, self.size = self.size, None, min(self.most, self.size + 1)
        return "probe"


def batch_sizes(steps: DataFrame, phase: str = "vlm", limits: dict[str, tuple[int, int, int]] = LIMITS) -> DataFrame:
    """(run, step, size, why, mode) after each row of steps (run LONG, step LONG, rate DOUBLE, load DOUBLE).

    A run's steps reach a task in order, and only its search is kept, however long the run is. Null rates count as 0,
    null loads as none.
    """
    least, most, first = limits[phase]

    def fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        run, search, begun = None, None, False
        for b in batches:
            out = []
            for r in b.to_pylist():
                if not begun or r["run"] != run:
                    run, search, begun = r["run"], Search(least, most, first), True
                size, why = search.after(r["rate"] or 0.0, r["load"] or 0.0)
                out.append((run, r["step"], size, why, search.mode))
            columns = list(zip(*out, strict=True)) if out else [()] * 5
            kinds = [pa.int64(), pa.int64(), pa.int32(), pa.string(), pa.string()]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], ["run", "step", "size", "why", "mode"])

    ordered = steps.select("run", "step", "rate", "load").repartition("run").sortWithinPartitions("run", "step")
    return ordered.mapInArrow(fold, "run long, step long, size int, why string, mode string")
