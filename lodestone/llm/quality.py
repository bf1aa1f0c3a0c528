"""A quality classifier: a generalised additive model with pairwise interactions.

Cyclic boosting of shallow trees, one feature at a time, adds up to a lookup table per feature; the pairs of features
that explain most of what is left get a table each. A score is a sum of table entries. The model is fitted on the
driver from a bounded sample of labelled rows (TRAIN_ROWS); scoring streams all documents past the tables, whose size
doesn't depend on the data.
"""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, IntegerType, StructField, StructType

from lodestone.llm.common import Texts, crc32_of, shingles, sub_batches

TRAIN_ROWS = 20_000
BINS = 32
COARSE = 8
PAIRS = 6

_CLASS = np.zeros(256, np.uint8)
for _n, _chars in enumerate(("abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "0123456789", "\n", ".,;:", "!?", "#$%&*@^~+=", "|", "<>[]{}\\/_", "'\"-()"), 1):
    _CLASS[[ord(c) for c in _chars]] = _n
_CLASS[128:192], _CLASS[192:] = 11, 12
_ENDS = np.isin(_CLASS, (6, 7))

FEATURES = ("log_words", "word_bytes", "upper", "digits", "newlines", "stops", "exclaims", "symbols", "pipes", "brackets", "quotes", "beyond_ascii", "distinct_words", "adjacent_repeats", "repeated_trigrams", "top_word", "noisy_ends", "long_words")


def features(column: pa.Array) -> np.ndarray:
    """A row of FEATURES for each whole text; of a text without words, zeros."""
    t = Texts(column)
    first, last, h = t.spans()
    bounds = np.append(np.searchsorted(first, t.starts), len(h)) if t.n else np.zeros(1, np.int64)
    noisy = _ENDS[t.buf[last - 1]] if len(last) else np.zeros(0, bool)
    length = last - first
    out = np.zeros((t.n, len(FEATURES)))
    for k in range(t.n):
        i, j = bounds[k], bounds[k + 1]
        n = int(j - i)
        if not n:
            continue
        c = np.bincount(_CLASS[t.buf[t.starts[k] : t.ends[k]]], minlength=13).astype(float)
        w = h[i:j]
        s = np.sort(w)
        new = np.flatnonzero(np.append(True, s[1:] != s[:-1]))
        runs = np.diff(np.append(new, n))
        tri = np.sort(shingles(w, 3))
        # lengths of prose vary; the share of different words is taken as an exponent of the number of words
        out[k] = (
            np.log1p(n), length[i:j].mean(), c[2] / max(1, c[1] + c[2]), c[3] / n, c[4] / n, c[5] / n, c[6] / n, c[7] / n, c[8] / n, c[9] / n, c[10] / n, c[12] / n,
            np.log1p(len(new)) / np.log1p(n), (w[1:] == w[:-1]).mean() if n > 1 else 0, (tri[1:] == tri[:-1]).sum() / len(tri), runs.max() / n, noisy[i:j].mean(), (length[i:j] > 30).mean(),
        )
    return out


@dataclass
class Model:
    intercept: float = 0.0
    edges: list[np.ndarray] = field(default_factory=list)
    tables: list[np.ndarray] = field(default_factory=list)
    coarse: list[np.ndarray] = field(default_factory=list)
    pairs: list[tuple[int, int, np.ndarray]] = field(default_factory=list)

    def score(self, x: np.ndarray) -> np.ndarray:
        """The probability of label 1, by adding up bins."""
        z = np.full(len(x), self.intercept)
        for f, (edges, table) in enumerate(zip(self.edges, self.tables, strict=True)):
            z += table[np.searchsorted(edges, x[:, f], side="right")]
        for f, g, table in self.pairs:
            z += table[np.searchsorted(self.coarse[f], x[:, f], side="right"), np.searchsorted(self.coarse[g], x[:, g], side="right")]
        return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


def _gain(g, h, ridge):
    return g * g / (h + ridge)


def _tree(g: np.ndarray, h: np.ndarray, leaves: int, ridge: float) -> np.ndarray:
    """Steps over ordered bins: the best splits, one after another."""
    parts = [(0, len(g))]
    while len(parts) < leaves:
        best = (1e-6, None, None)
        for i, (a, b) in enumerate(parts):
            if b - a > 1:
                cg, ch = np.cumsum(g[a:b]), np.cumsum(h[a:b])
                rise = _gain(cg[:-1], ch[:-1], ridge) + _gain(cg[-1] - cg[:-1], ch[-1] - ch[:-1], ridge) - _gain(cg[-1], ch[-1], ridge)
                k = int(np.argmax(rise))
                if rise[k] > best[0]:
                    best = (rise[k], i, a + k + 1)
        if best[1] is None:
            break
        a, b = parts[best[1]]
        parts[best[1] : best[1] + 1] = [(a, best[2]), (best[2], b)]
    out = np.zeros(len(g))
    for a, b in parts:
        out[a:b] = g[a:b].sum() / (h[a:b].sum() + ridge)
    return out


def _quadrants(g: np.ndarray, h: np.ndarray, ridge: float) -> tuple[float, np.ndarray]:
    """The best cut of a grid in four, and its steps."""
    cg, ch = g.cumsum(0).cumsum(1), h.cumsum(0).cumsum(1)
    four = lambda c: (c[:-1, :-1], c[:-1, -1:] - c[:-1, :-1], c[-1:, :-1] - c[:-1, :-1], c[-1, -1] - c[:-1, -1:] - c[-1:, :-1] + c[:-1, :-1])
    rise = sum(_gain(a, b, ridge) for a, b in zip(four(cg), four(ch), strict=True)) - _gain(cg[-1, -1], ch[-1, -1], ridge)
    i, j = np.unravel_index(int(np.argmax(rise)), rise.shape)
    out = np.zeros_like(g)
    for rows in (slice(0, i + 1), slice(i + 1, None)):
        for cols in (slice(0, j + 1), slice(j + 1, None)):
            out[rows, cols] = g[rows, cols].sum() / (h[rows, cols].sum() + ridge)
    return float(rise[i, j]), out


def _cuts(x: np.ndarray, bins: int) -> np.ndarray:
    return np.unique(np.quantile(x, np.arange(1, bins) / bins))


def fit(x: np.ndarray, y: np.ndarray, rounds: int = 120, rate: float = 0.15, leaves: int = 3, pairs: int = PAIRS, pair_rounds: int = 40, ridge: float = 2.0) -> Model:
    """Without rows a model of 0.5; with one label only, of nearly that label."""
    if not len(y):
        return Model()
    base = np.clip(y.mean(), 1e-3, 1 - 1e-3)
    m = Model(float(np.log(base / (1 - base))))
    z, many = np.full(len(y), m.intercept), x.shape[1]
    m.edges = [_cuts(x[:, f], BINS) for f in range(many)]
    m.coarse = [_cuts(x[:, f], COARSE) for f in range(many)]
    at = [np.searchsorted(e, x[:, f], side="right") for f, e in enumerate(m.edges)]
    m.tables = [np.zeros(len(e) + 1) for e in m.edges]
    slopes = lambda: ((p := 1 / (1 + np.exp(-z))), y - p, p * (1 - p))[1:]
    for _ in range(rounds):
        for f in range(many):
            g, h = slopes()
            k = len(m.tables[f])
            step = rate * _tree(np.bincount(at[f], g, k), np.bincount(at[f], h, k), leaves, ridge)
            m.tables[f] += step
            z += step[at[f]]
    low = [np.searchsorted(e, x[:, f], side="right") for f, e in enumerate(m.coarse)]
    width = [len(e) + 1 for e in m.coarse]

    def grid(f, g2, v):
        return np.bincount(low[f] * width[g2] + low[g2], v, width[f] * width[g2]).reshape(width[f], width[g2])

    g, h = slopes()
    ranked = sorted(((-_quadrants(grid(a, b, g), grid(a, b, h), ridge)[0], a, b) for a in range(many) for b in range(a) if width[a] > 1 and width[b] > 1))[:pairs]
    tables = {(a, b): np.zeros((width[a], width[b])) for _, a, b in ranked}
    for _ in range(pair_rounds):
        for (a, b), table in tables.items():
            g, h = slopes()
            step = rate * _quadrants(grid(a, b, g), grid(a, b, h), ridge)[1]
            table += step
            z += step[low[a], low[b]]
    m.pairs = [(a, b, t) for (a, b), t in tables.items()]
    return m


def held_out():
    return crc32_of("doc_id") % 3 == 1


def _measured(batches):
    for batch in batches:
        for part in sub_batches(batch, "text"):
            x = features(part.column("text"))
            lists = pa.FixedSizeListArray.from_arrays(pa.array(x.ravel()), len(FEATURES)).cast(pa.list_(pa.float64()))
            yield pa.record_batch({"doc_id": part.column("doc_id"), "y": part.column("y"), "x": lists})


def train(docs: DataFrame, labels: DataFrame, most: int = TRAIN_ROWS) -> Model:
    """Fits on at most `most` labelled rows that aren't held out, in the order of a hash of doc_id.

    labels: doc_id, quality; qualities other than 0 and 1 are passed over. Of docs only doc_id and text are read.
    """
    known = labels.where("doc_id is not null and quality in (0, 1)").where(~held_out()).select(F.col("doc_id").cast("long").alias("doc_id"), F.col("quality").cast("int").alias("y"))
    # bounded by `most` rows of 12 bytes: safe to broadcast
    sample = known.orderBy(F.xxhash64("doc_id"), "doc_id", "y").limit(most)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").join(F.broadcast(sample), "doc_id").select("doc_id", "text", "y")
    got = rows.mapInArrow(_measured, "doc_id long, y int, x array<double>").orderBy(F.xxhash64("doc_id"), "doc_id", "y", "x").limit(most).toPandas()
    return fit(np.array(got["x"].tolist()).reshape(len(got), len(FEATURES)), got["y"].to_numpy(float))


def score_documents(docs: DataFrame, model: Model) -> DataFrame:
    """The columns of docs, with score and predicted (1 if score >= 0.5, else 0); columns of these names are replaced.

    A score depends on the text alone. Null and empty texts get the score of a text without words.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)
    kept = docs.drop("score", "predicted")

    def run(batches):
        for batch in batches:
            for part in sub_batches(batch, "text"):
                p = shared.value.score(features(part.column("text")))
                yield pa.record_batch([*part.columns, pa.array(p), pa.array((p >= 0.5).astype(np.int32))], names=[*part.schema.names, "score", "predicted"])

    schema = StructType([*kept.schema, StructField("score", DoubleType()), StructField("predicted", IntegerType())])
    return kept.mapInArrow(run, schema)


def quality_scores(docs: DataFrame, labels: DataFrame, most: int = TRAIN_ROWS) -> DataFrame:
    """doc_id, held_out, score, predicted: one row per row of docs (doc_id integer, text string).

    held_out: crc32 of doc_id as text, modulo 3, is 1 (null counts as empty text); such rows are never learnt from.
    Repeated rows get a row each; labels without a document and documents without a label are fine; without any
    usable label all scores are 0.5. Other columns are ignored; an empty table gives no rows.
    """
    thin = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    model = train(thin, labels, most)
    # texts don't leave the scan's task: only the score comes back
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        for batch in batches:
            for part in sub_batches(batch, "text"):
                p = shared.value.score(features(part.column("text")))
                yield pa.record_batch({"doc_id": part.column("doc_id"), "score": pa.array(p), "predicted": pa.array((p >= 0.5).astype(np.int32))})

    return thin.mapInArrow(run, "doc_id long, score double, predicted int").select("doc_id", held_out().alias("held_out"), "score", "predicted")
