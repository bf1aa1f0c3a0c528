"""Two-column text search: matching, phrases and BM25 over an index of words, stored (segments.py) or made on the fly.

An index gives, for wanted tokens, rows (id, part, token, dl, pos): the places of a token in a part of a document of dl
tokens. Nothing else is read, so a stored index answers from the postings of these tokens alone.
"""

from __future__ import annotations

import re
from collections.abc import Callable
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lodestone.functions.text import ascii_tokens, fold, tokens

K1, B, IDF_FLOOR = 1.2, 0.75, 1e-6
WEIGHTS = {"strong": 3.0, "weak": 1.5}
PARTS = ("strong", "weak")


@dataclass(frozen=True)
class Analyzer:
    """How text is cut into tokens: words for columns, cut for the words of a query, which gives the same tokens."""

    name: str
    words: Callable[[Column], Column]
    cut: Callable[[str], list[str]]

    def distinct(self, texts: list[str]) -> list[str]:
        return list(dict.fromkeys(t for x in texts for t in self.cut(x)))


ANY_SCRIPT = Analyzer("any_script", tokens, lambda t: [w for w in re.split(r"[\W_]+", fold(t)) if w])
ASCII = Analyzer("ascii", ascii_tokens, lambda t: [w for w in re.split("[^0-9a-z]+", t.lower()) if w])
ANALYZERS = {a.name: a for a in (ANY_SCRIPT, ASCII)}


def postings(docs: DataFrame, words: Callable[[Column], Column] = tokens) -> DataFrame:
    """(id, part, token, pos) of docs (id, strong, weak). words: how text is cut, here and for lengths."""
    parts = [docs.select("id", F.lit(p).alias("part"), F.posexplode(words(F.col(p))).alias("pos", "token")) for p in PARTS]
    return reduce(DataFrame.unionByName, parts).select("id", "part", "token", "pos")


def lengths(docs: DataFrame, words: Callable[[Column], Column] = tokens) -> DataFrame:
    return docs.select("id", (F.size(words(F.col("strong"))) + F.size(words(F.col("weak")))).cast("long").alias("dl"))


@dataclass(frozen=True)
class Texts:
    """An index of texts (id, strong, weak) that isn't stored: each question reads them all. ids are unique."""

    docs: DataFrame
    analyzer: Analyzer = ANY_SCRIPT

    def hits(self, wanted: list[str]) -> DataFrame:
        cut = self.docs.select("id", *(self.analyzer.words(F.col(p)).alias(p) for p in PARTS))

        def places(p: str) -> Column:
            found = F.transform(p, lambda t, i: F.struct(F.lit(p).alias("part"), t.alias("token"), i.alias("pos")))
            return F.filter(found, lambda x: x["token"].isin(wanted))

        # only the wanted tokens leave a document's row
        each = [places(p) for p in PARTS]
        rows = cut.select("id", (F.size("strong") + F.size("weak")).cast("long").alias("dl"), F.explode(F.concat(*each)).alias("x"))
        return rows.groupBy("id", "x.part", "x.token", "dl").agg(F.sort_array(F.collect_list("x.pos")).alias("pos")).select("id", "part", "token", "dl", "pos")

    def with_totals(self, rows: DataFrame) -> DataFrame:
        size = lengths(self.docs, self.analyzer.words)
        return rows.crossJoin(F.broadcast(size.agg(F.count("*").alias("n_docs"), F.avg("dl").alias("avgdl"))))  # one row


@dataclass(frozen=True)
class Postings:
    """postings() as an index, for matches and phrases; it knows no lengths."""

    rows: DataFrame
    analyzer: Analyzer = ANY_SCRIPT

    def hits(self, wanted: list[str]) -> DataFrame:
        rows = self.rows.where(F.col("token").isin(wanted)).groupBy("id", "part", "token").agg(F.sort_array(F.collect_list("pos")).alias("pos"))
        return rows.select("id", "part", "token", F.lit(None).cast("long").alias("dl"), "pos")


def as_index(index):
    """Texts of a table of texts, Postings of one of postings; an index as it is."""
    if isinstance(index, DataFrame):
        return Postings(index) if "token" in index.columns else Texts(index)
    return index


def matching(index, keywords: list[str], excluded: list[str] = ()) -> DataFrame:
    """The rows (id, part, token, dl, pos) of documents that hold a keyword's token and none of an excluded one's."""
    index = as_index(index)
    hits, out = index.hits(index.analyzer.distinct(keywords)), index.analyzer.distinct(list(excluded))
    return hits.join(index.hits(out).select("id").distinct(), "id", "left_anti") if out else hits


def _shifted(places: str, by: int) -> Column:
    return F.transform(places, lambda p: p - by)


def phrase(index, words: str) -> DataFrame:
    """Rows (id, part, token, dl, pos) where the words stand one after another; token is the phrase, pos where it begins.

    The phrase is cut as the index cuts texts, repeats included. One without a letter or digit is nowhere.
    """
    index = as_index(index)
    parts = index.analyzer.cut(words)
    rows = index.hits(list(dict.fromkeys(parts)))
    found = rows.where(F.col("token") == (parts[0] if parts else ""))
    for i, t in enumerate(parts[1:], 1):
        other = rows.where(F.col("token") == t).select("id", "part", _shifted("pos", i).alias("_at"))
        found = found.join(other, ["id", "part"]).withColumn("pos", F.array_intersect("pos", "_at")).where(F.size("pos") > 0).drop("_at")
    return found.select("id", "part", F.lit(" ".join(parts)).alias("token"), "dl", "pos")


def bm25(index, hits: DataFrame, weights: dict[str, float] = WEIGHTS) -> DataFrame:
    """(id, score): larger is better. hits: rows of tokens or phrases of the index, all there are of each."""
    weight = F.when(F.col("part") == "strong", weights["strong"]).otherwise(weights["weak"])
    tf = hits.groupBy("id", "token").agg(F.sum(weight * F.size("pos")).alias("tf"), F.max("dl").alias("dl"))
    df = tf.groupBy("token").agg(F.count("*").alias("df"))
    idf = F.greatest(F.lit(IDF_FLOOR), F.log((F.col("n_docs") - F.col("df") + 0.5) / (F.col("df") + 0.5)))
    part = idf * F.col("tf") * (K1 + 1) / (F.col("tf") + K1 * (1 - B + B * F.col("dl") / F.col("avgdl")))
    # a row per token of the query
    rows = as_index(index).with_totals(tf.join(F.broadcast(df), "token"))
    return rows.groupBy("id").agg(F.sum(part).alias("score"))


def min_max(df: DataFrame, col: str, name: str, few: bool = False) -> DataFrame:
    """col scaled to 0..1 over all rows; 1 where all are equal. The limits are one row; of few rows, a window's."""
    span = F.col("_hi") - F.col("_lo")
    scaled = F.when(F.col(col).isNull(), None).when(span <= 1e-12, 1.0).otherwise(F.least(F.lit(1.0), F.greatest(F.lit(0.0), (F.col(col) - F.col("_lo")) / span)))
    ends = {"_lo": F.min(col), "_hi": F.max(col)}
    if few:
        df = df.withColumns({k: v.over(Window.partitionBy()) for k, v in ends.items()})
    else:
        df = df.crossJoin(F.broadcast(df.agg(*(v.alias(k) for k, v in ends.items()))))
    return df.withColumn(name, scaled).drop("_lo", "_hi")
