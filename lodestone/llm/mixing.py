"""Mixing sources to target weights with a low-discrepancy schedule.

Slot i of the schedule has the point `i * phi mod 1` of the golden ratio; the source in whose share of the unit
interval the point falls has the slot. A source's slots are ranked in schedule order, and its r-th slot takes the r-th
equal-token block of the source's shuffled documents, starting over at the end. Everything is DataFrame operations;
ranks and running sums are taken in two levels (within a chunk, and over the chunks' totals), so that no source is in
one task however large it is.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lodestone.llm.common import WORD, cut

WEIGHTS = (3.0, 1.0, 2.0)
SHARE = 1.5
MOST = 2
BLOCK = 1024
#: The unit interval in steps, and the golden ratio's fraction as an odd number of them; i * STEP fits 64 bits.
UNIT = 1 << 31
STEP = 1327217885
_BINS = 4096
_SLOTS_PER_CHUNK = 1 << 14
_DOCS_PER_CHUNK = 1 << 14


def sizes(docs: DataFrame) -> Column:
    return F.coalesce(F.regexp_count("text", F.lit(WORD)), F.lit(0)).cast("long")


def targets(per_source: DataFrame, weights: tuple[float, ...] = WEIGHTS, share: float = SHARE, most: int = MOST) -> DataFrame:
    """Adds source_no, weight, target to (source, source_size), one row per source.

    Targets are in proportion to weight, but at most `most` times the source's size; what is over goes to the others
    by weight until none is above. In order of most * size / weight the full sources come first: source i is full if
    at the rate left to it and its followers it would pass its limit.
    """
    order = Window.orderBy(F.col("source").isNull(), "source")
    numbered = per_source.withColumn("source_no", F.row_number().over(order) - 1)
    weight = F.element_at(F.array(*map(F.lit, weights)), (F.col("source_no") % len(weights) + 1).cast("int"))
    full = F.col("source_size") * F.lit(float(most))
    rows = numbered.withColumn("weight", weight).withColumn("limit", full).withColumn("ratio", F.col("limit") / F.col("weight"))
    by = Window.orderBy("ratio", "source_no")
    before = by.rowsBetween(Window.unboundedPreceding, -1)
    after = by.rowsBetween(Window.currentRow, Window.unboundedFollowing)
    whole = Window.partitionBy()
    rows = rows.withColumn("total", F.sum("source_size").over(whole) * F.lit(share))
    rows = rows.withColumn("rate", (F.col("total") - F.coalesce(F.sum("limit").over(before), F.lit(0.0))) / F.sum("weight").over(after))
    rows = rows.withColumn("is_full", F.col("ratio") <= F.col("rate"))
    # the first that isn't full sets the rate of the rest
    rate = F.min(F.when(~F.col("is_full"), F.struct("ratio", "source_no", "rate"))).over(whole)["rate"]
    return rows.select("source", "source_no", "source_size", "weight", F.when(F.col("is_full"), F.col("limit")).otherwise(F.col("weight") * rate).alias("target"))


def _running(rows: DataFrame, key: str, chunk: str, order: list, value: Column, name: str) -> DataFrame:
    """Adds to each row the sum of value over the rows of its key before it; chunks are in order within a key."""
    sums = rows.groupBy(key, chunk).agg(F.sum(value).alias("_sum"))
    heads = Window.partitionBy(key).orderBy(chunk).rowsBetween(Window.unboundedPreceding, -1)
    sums = sums.select(F.col(key).alias("_key"), F.col(chunk).alias("_chunk"), F.coalesce(F.sum("_sum").over(heads), F.lit(0).cast("long")).alias("_head"))
    inner = Window.partitionBy(key, chunk).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    rows = rows.withColumn("_inner", F.coalesce(F.sum(value).over(inner), F.lit(0).cast("long")))
    return rows.join(sums, (F.col(key) == F.col("_key")) & (F.col(chunk) == F.col("_chunk"))).withColumn(name, F.col("_head") + F.col("_inner")).drop("_key", "_chunk", "_head", "_inner")


def schedule(sources: DataFrame, slots: int, block: int = BLOCK) -> DataFrame:
    """slot, source_no, rank, block, start, used: what each slot takes, up to each source's rounded target.

    A source that has its target leaves further slots empty. The few slots that the points leave a source short of
    (their number grows with the logarithm of all slots) follow at the end.
    """
    spark = sources.sparkSession
    shares = sources.where("target > 0").withColumn("quota", F.round("target").cast("long"))
    by = Window.orderBy("source_no").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    shares = shares.withColumn("_to", F.sum("target").over(by) / F.sum("target").over(Window.partitionBy()))
    shares = shares.withColumn("hi", F.round(F.col("_to") * UNIT).cast("long")).withColumn("lo", F.coalesce(F.lag("hi").over(Window.orderBy("source_no")), F.lit(0).cast("long")))
    blocks = F.ceil(F.col("source_size") / block).cast("long")
    # slots for whole passes, and for what is left
    full = F.floor(F.col("quota") / F.col("source_size")).cast("long")
    rest = F.ceil((F.col("quota") - full * F.col("source_size")) / block).cast("long")
    shares = cut(shares.withColumn("blocks", blocks).withColumn("need", full * blocks + rest).drop("_to"))
    width = UNIT // _BINS
    bins = shares.select("source_no", "lo", "hi", F.explode(F.sequence(F.floor(F.col("lo") / width), F.floor(F.greatest("lo", F.col("hi") - 1) / width))).alias("bin"))
    points = spark.range(slots).select(F.col("id").alias("slot"), ((F.col("id") % UNIT) * STEP % UNIT).alias("point"))
    points = points.withColumn("bin", F.floor(F.col("point") / width))
    hit = points.join(bins, "bin").where("point >= lo and point < hi").select("slot", "source_no", F.floor(F.col("slot") / _SLOTS_PER_CHUNK).alias("chunk"))
    ranked = _running(hit, "source_no", "chunk", ["slot"], F.lit(1).cast("long"), "rank").select("slot", "source_no", "rank")
    late = shares.join(hit.groupBy("source_no").agg(F.count("*").alias("had")), "source_no", "left").withColumn("had", F.coalesce("had", F.lit(0).cast("long"))).where("had < need")
    late = late.select("source_no", F.explode(F.sequence(F.col("had"), F.col("need") - 1)).alias("rank")).select((F.col("rank") + slots).alias("slot"), "source_no", "rank")
    taken = ranked.unionByName(late).join(shares.select("source_no", "blocks", "need", "quota", "source_size"), "source_no").where("rank < need")
    nth, start = F.col("rank") % F.col("blocks"), F.col("rank") % F.col("blocks") * block
    left = F.col("quota") - F.floor(F.col("rank") / F.col("blocks")) * F.col("source_size") - start
    return taken.select("slot", "source_no", "rank", nth.alias("block"), start.alias("start"), F.least(F.lit(block).cast("long"), F.col("source_size") - start, left).alias("used"))


def mix(docs: DataFrame, weights: tuple[float, ...] = WEIGHTS, share: float = SHARE, block: int = BLOCK) -> tuple[DataFrame, DataFrame, list[str]]:
    """(rows with their shuffle keys, facts of each row, columns to keep): the facts are size, source_size, target, taken.

    docs: doc_id integer, text and source strings.

    size: words of the text, null 0. taken: words of the document in the mix, repeats counted; at most MOST times
    size, as a source starts over at its end only. A source's taken words sum to its target, rounded. Sources go by
    code point, null last, and take the weights in turn. The shuffle within a source depends on doc_id and the text
    alone, so reruns agree; rows that are equal in both may swap places. Columns of docs named as the added ones are
    replaced. Empty texts have taken 0; an empty table, or one without a word, gives targets of 0.
    """
    added = ("size", "source_size", "target", "taken")
    keep = [c for c in docs.columns if c not in added]
    rows = docs.select(*keep, sizes(docs).alias("_size"), F.xxhash64("doc_id", "text").alias("_shuffle"))
    # texts are read for their size only; all that follows is narrow
    thin = cut(rows.select(F.col("doc_id").alias("_doc"), F.col("source").alias("_source"), "_size", "_shuffle"))
    total, count = thin.agg(F.coalesce(F.sum("_size"), F.lit(0)), F.count("*")).first()
    per_source = thin.groupBy(F.col("_source").alias("source")).agg(F.sum("_size").alias("source_size"))
    sources = cut(targets(per_source, weights, share))
    slots = int(-(-total * share // block))
    chunks = 1 << max(0, (count // _DOCS_PER_CHUNK).bit_length())
    # documents of a source, shuffled, one after another
    numbered = thin.join(sources.select(F.col("source").alias("_s"), "source_no"), F.col("_source").eqNullSafe(F.col("_s"))).withColumn("_chunk0", F.shiftrightunsigned("_shuffle", 64 - (chunks.bit_length() - 1)) if chunks > 1 else F.lit(0).cast("long"))
    numbered = cut(numbered.select("_doc", "_shuffle", "_size", "source_no", "_chunk0").withColumn("_row", F.monotonically_increasing_id()))
    placed = _running(numbered, "source_no", "_chunk0", ["_shuffle", "_doc", "_row"], F.col("_size"), "_at")
    pieces = placed.where("_size > 0").select("_row", "source_no", "_at", "_size", F.explode(F.sequence(F.floor(F.col("_at") / block), F.floor((F.col("_at") + F.col("_size") - 1) / block))).alias("block"))
    took = pieces.join(schedule(sources, slots, block), ["source_no", "block"])
    overlap = F.greatest(F.lit(0).cast("long"), F.least(F.col("_at") + F.col("_size"), F.col("start") + F.col("used")) - F.greatest("_at", "start"))
    taken = took.groupBy("_row").agg(F.sum(overlap).alias("taken"))
    facts = numbered.join(taken, "_row", "left").join(sources.select("source_no", "source_size", "target"), "source_no").select("_doc", "_shuffle", F.col("_size").alias("size"), "source_size", "target", F.coalesce("taken", F.lit(0).cast("long")).alias("taken"))
    return rows.drop("_size"), facts, keep


def mixed_sizes(docs: DataFrame, **how) -> DataFrame:
    """doc_id, size, source_size, target, taken, as of mix(); a row per row of docs."""
    return mix(docs.select("doc_id", "text", "source"), **how)[1].select(F.col("_doc").alias("doc_id"), "size", "source_size", "target", "taken")


def mixed_documents(docs: DataFrame, **how) -> DataFrame:
    """The documents that the mix takes words of, with all their columns and size, source_size, target, taken.

    Rows that are equal in doc_id and text share what the mix takes of them in about equal parts; no word is lost.
    """
    rows, facts, keep = mix(docs, **how)
    per_key = [F.max("size").alias("size"), F.max("source_size").alias("source_size"), F.max("target").alias("target"), F.sum("taken").alias("taken"), F.count("*").alias("_n")]
    facts = cut(facts.groupBy(F.col("_doc").alias("_d"), F.col("_shuffle").alias("_s")).agg(*per_key).where("taken > 0"))
    packed = rows.select(F.struct(*keep).alias("_all"), F.col("doc_id").alias("_i"), F.col("_shuffle").alias("_h"))
    same = F.col("_i").eqNullSafe(F.col("_d")) & (F.col("_h") == F.col("_s"))
    joined = packed.join(facts.where("_n = 1"), same)
    several = facts.where("_n > 1")
    if not several.isEmpty():
        # the k-th of n equal rows: numbered by partition, so that no group is in one task
        copies = cut(packed.join(several, same).withColumn("_row", F.monotonically_increasing_id()))
        copies = copies.withColumn("_key0", F.xxhash64("_i", "_h")).withColumn("_part", F.shiftright("_row", 33))
        k = _running(copies, "_key0", "_part", ["_row"], F.lit(1).cast("long"), "_k")
        share = F.floor(F.col("taken") * (F.col("_k") + 1) / F.col("_n")) - F.floor(F.col("taken") * F.col("_k") / F.col("_n"))
        joined = joined.unionByName(k.withColumn("taken", share).where("taken > 0").select(joined.columns))
    return joined.select(*(F.col("_all")[c].alias(c) for c in keep), "size", "source_size", "target", "taken")
