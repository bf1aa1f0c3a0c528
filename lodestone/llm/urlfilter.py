"""URL filtering by rules, and by the ratio of two character models where no rule fits.

Both models are variable-order Markov models over 64 symbols: the probability of a character given the two before it
is smoothed with that given one, and that with that given none, by how often the context was seen. One learns from
URLs that a rule allows, one from those that a rule blocks. A URL's score is the mean over its characters of the
log ratio; the threshold is calibrated on the same URLs. All is DataFrame operations: the log ratios are 64**3 numbers
(whatever the data) in one array, in which every task looks up its URLs' trigrams.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lodestone.llm.common import cut

RULES = (("com/en/", "block"), ("example.com/en/7", "allow"), ("net/de/", "allow"), ("example.net/de/8", "block"), ("org/es/", "block"))
KAPPA = 4.0
SYMBOLS = 64
#: Symbol 0 is the start, 1 any other character; A-Z count as a-z.
_CAPITALS = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
_KNOWN = "abcdefghijklmnopqrstuvwxyz0123456789./-_?=&%#:~+,;@!$'()*[]"


def split_url(url: Column) -> tuple[Column, Column]:
    """host, path; both empty for null and where there is no `://`."""
    at = F.instr(url, "://")
    rest = F.coalesce(F.when(at > 0, F.substr(url, at + 3)), F.lit(""))
    host = F.regexp_extract(rest, r"(?s)^[^/?#]*", 0)
    path = F.regexp_extract(rest, r"(?s)^[^/?#]*([^?#]*)", 1)
    return F.translate(host, _CAPITALS, _CAPITALS.lower()), path


def _rule(rules: Sequence[tuple[str, str]]) -> Column:
    """(rule, verdict) of the longest rule that fits, else null."""
    found = F.lit(None)
    for rule, verdict in sorted(rules, key=lambda r: (len(r[0]), r[0])):
        host, slash, path = rule.partition("/")
        fits = ((F.col("host") == host) | F.endswith("host", F.lit(f".{host}"))) & F.startswith("path", F.lit(slash + path))
        found = F.when(fits, F.struct(F.lit(rule).alias("rule"), F.lit(verdict).alias("verdict"))).otherwise(found)
    return found


def _codes(text: Column) -> Column:
    """Two starts, then a symbol for each character."""
    letters = F.filter(F.split(F.translate(text, _CAPITALS, _CAPITALS.lower()), ""), lambda c: c != "")
    return F.concat(F.array(F.lit(0), F.lit(0)), F.transform(letters, lambda c: F.instr(F.lit(_KNOWN), c) + 1))


def trigrams(codes: Column) -> Column:
    """The number of each trigram of an array of symbols, in order; codes should be a stored column, not an expression."""
    n = F.greatest(F.lit(0), F.size(codes) - 2)
    first, second, third = (F.slice(codes, F.lit(i + 1), n) for i in range(3))
    return F.zip_with(F.zip_with(first, second, lambda x, y: x * SYMBOLS + y), third, lambda x, y: x * SYMBOLS + y)


def log_ratios(grams: DataFrame, kappa: float = KAPPA) -> DataFrame:
    """(gram, ratio) for each of the trigrams, ln P(allowed) - ln P(blocked), from (gram, allowed) rows."""
    counted = grams.groupBy("gram").agg(F.sum(F.col("allowed").cast("long")).alias("n1"), F.sum((~F.col("allowed")).cast("long")).alias("n0"))
    every = grams.sparkSession.range(SYMBOLS**3).select(F.col("id").alias("gram"))
    rows = every.join(counted, "gram", "left").na.fill(0, ["n0", "n1"]).withColumn("a", F.shiftright("gram", 12)).withColumn("b", F.shiftright("gram", 6) % SYMBOLS).withColumn("c", F.col("gram") % SYMBOLS)

    def given(k: int, *keys: str) -> Column:
        return F.sum(f"n{k}").over(Window.partitionBy(*keys))

    def p(k: int) -> Column:
        p0 = (given(k, "c") + 1.0) / (given(k) + float(SYMBOLS))
        p1 = (given(k, "b", "c") + kappa * p0) / (given(k, "b") + kappa)
        return (F.col(f"n{k}") + kappa * p1) / (given(k, "a", "b") + kappa)

    return rows.select("gram", F.log(p(1) / p(0)).alias("ratio"))


def judge_urls(pages: DataFrame, rules: Sequence[tuple[str, str]] = RULES, kappa: float = KAPPA) -> DataFrame:
    """page_id, host, path, rule, verdict, score: one row per row of pages (page_id integer, url string).

    A rule's host fits itself and its subdomains, its path all that it begins; of the rules that fit, the longest
    gives the verdict. Other URLs are blocked if their score is below the threshold, which lies between the means of
    the allowed and the blocked URLs, as many standard deviations from one as from the other. A URL without host and
    path has score 0 and is allowed, as are all where either kind of URL to learn from is missing. Null urls are as
    said, repeated rows get a row each, other columns are ignored, an empty table gives no rows. A score at the threshold
    (a tie) allows. Time and memory grow with a URL's length, which has no limit.
    """
    host, path = split_url(F.col("url"))
    whole = F.concat(host, path)
    # the checkpoint keeps the readers below on one computation, and the symbols from being cut for each trigram anew
    rows = cut(pages.select(F.col("page_id").cast("long").alias("page_id"), host.alias("host"), path.alias("path"), _codes(whole).alias("codes")).withColumn("hit", _rule(rules)))
    grams = rows.where("hit is not null").select((F.col("hit.verdict") == "allow").alias("allowed"), F.explode(trigrams(F.col("codes"))).alias("gram"))
    # SYMBOLS**3 numbers, whatever the data: one array that every task looks up
    table = log_ratios(grams, kappa).agg(F.array_sort(F.collect_list(F.struct("gram", "ratio"))).alias("r")).select(F.col("r.ratio").alias("r")).scalar()
    total = F.aggregate(trigrams(F.col("codes")), F.lit(0.0), lambda s, g: s + F.get("table", g))
    score = F.when(F.size("codes") > 2, total / (F.size("codes") - 2))
    scores = cut(rows.withColumn("table", table).select("page_id", "host", "path", "hit", score.alias("score")))
    good, bad = F.when(F.col("hit.verdict") == "allow", F.col("score")), F.when(F.col("hit.verdict") == "block", F.col("score"))
    stats = scores.agg(F.avg(good).alias("mg"), F.avg(bad).alias("mb"), F.stddev_pop(good).alias("sg"), F.stddev_pop(bad).alias("sb"))
    threshold = F.when(F.col("sg") + F.col("sb") > 0, (F.col("mb") * F.col("sg") + F.col("mg") * F.col("sb")) / (F.col("sg") + F.col("sb"))).otherwise((F.col("mg") + F.col("mb")) / 2)
    limit = stats.select(threshold.alias("threshold")).scalar()
    model = F.when(F.col("score") < limit, "block").otherwise("allow")
    return scores.select("page_id", "host", "path", F.col("hit.rule").alias("rule"), F.coalesce("hit.verdict", model).alias("verdict"), F.coalesce("score", F.lit(0.0)).alias("score"))
