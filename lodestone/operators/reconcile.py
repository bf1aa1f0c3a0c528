"""Disk against catalog: what matches, moved, is new or missing; and audits of references between tables."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestone.functions.vectors import fingerprint
from lodestone.operators.ranking import numbered
from lodestone.sources.shared import cut

#: So many hashes that share a value are compared with each other; dividing fewer would cost more.
FULL = 1 << 14
#: So many copies of a hash are paired at a time.
BLOCK = 1 << 10


def nth(df: DataFrame, key: str, order: list) -> DataFrame:
    """df with the place (rn, from 1) of each row among those of its key; the key of empty files may have very many."""
    return numbered(df, [key], order)


def sync_plan(disk: DataFrame, catalog: DataFrame) -> DataFrame:
    """(state, hash, disk_path, catalog_path): disk (path, hash) against catalog (path, hash).

    Equal paths are matched. Of the rest, the i-th disk path of a hash moved from the i-th catalog path; what is then
    over is new on disk or missing there.
    """
    both = disk.select(F.col("path").alias("disk_path"), F.col("hash").alias("h1")).join(catalog.select(F.col("path").alias("catalog_path"), F.col("hash").alias("h2")), F.col("disk_path") == F.col("catalog_path"), "full_outer")
    # one join tells the three apart; its rows are read for each
    both = cut(both)
    matched = both.where("disk_path is not null and catalog_path is not null").select(F.lit("matched").alias("state"), F.col("h1").alias("hash"), "disk_path", "catalog_path")
    d = nth(both.where("catalog_path is null").select("h1", "disk_path"), "h1", ["disk_path"]).withColumnRenamed("rn", "r1")
    c = nth(both.where("disk_path is null").select("h2", "catalog_path"), "h2", ["catalog_path"]).withColumnRenamed("rn", "r2")
    rest = d.join(c, (F.col("h1") == F.col("h2")) & (F.col("r1") == F.col("r2")), "full_outer")
    state = F.when(F.col("catalog_path").isNull(), "new").when(F.col("disk_path").isNull(), "missing").otherwise("moved")
    return matched.unionByName(rest.select(state.alias("state"), F.coalesce("h1", "h2").alias("hash"), "disk_path", "catalog_path"))


def relink(disk: DataFrame, catalog: DataFrame) -> DataFrame:
    """(id, hash, new_path): a hash's most complete catalog row takes its first disk path, and so on.

    catalog: id, hash, has_mc, has_vv, has_mv.
    """
    c = nth(catalog, "hash", [F.desc("has_mc"), F.desc("has_vv"), F.desc("has_mv"), "id"])
    d = nth(disk, "hash", ["path"])
    return c.join(d, ["hash", "rn"]).select("id", "hash", F.col("path").alias("new_path"))


def relink_counts(disk: DataFrame, catalog: DataFrame) -> DataFrame:
    """By class of hash (matched, new, missing): pairs, disk rows, catalog rows."""
    a = disk.groupBy("hash").agg(F.count("*").alias("n_disk"))
    b = catalog.groupBy("hash").agg(F.count("*").alias("n_db"))
    both = a.join(b, "hash", "full_outer").na.fill(0, ["n_disk", "n_db"])
    kind = F.when((F.col("n_disk") > 0) & (F.col("n_db") > 0), "matched").when(F.col("n_disk") > 0, "new").otherwise("missing")
    return both.groupBy(kind.alias("kind")).agg(F.sum(F.least("n_disk", "n_db")).alias("pairs"), F.sum("n_disk").alias("n_disk"), F.sum("n_db").alias("n_db"))


def dangling(child: DataFrame, parent: DataFrame) -> DataFrame:
    return child.join(parent.select("id"), "id", "left_anti")


def fingerprint_collisions(vectors: DataFrame, hashes: DataFrame) -> DataFrame:
    """Vector fingerprints that files of different content share."""
    keyed = vectors.select("id", fingerprint(F.col("embedding")).alias("print")).join(hashes.select("id", "hash"), "id")
    return keyed.groupBy("print").agg(F.count_distinct("hash").alias("n_hashes"), F.count("*").alias("n")).where("n_hashes > 1")


def hamming(a: Column, b: Column) -> Column:
    return F.bit_count(a.bitwiseXOR(b))


def _low(n: int) -> Column:
    """The lowest n bits, all ones."""
    return F.lit((1 << n) - 1 if n < 64 else -1).cast("long")


def _shift(col: Column, by: Column) -> Column:
    """col shifted right without sign, by any number of bits."""
    return F.when(by < 64, F.call_function("shiftrightunsigned", col, by)).otherwise(F.lit(0).cast("long"))


def near_hashes(items: DataFrame, within: int = 10, bits: int = 64, full: int = FULL) -> DataFrame:
    """(a, b, distance): pairs of items (id, hash LONG) that differ in `within` bits or fewer, each once.

    Items with one hash are one row until the end, so copies don't multiply pairs: the result links each hash's first
    id, and (first, copy) at distance 0. Null hashes are near nothing.

    The bits that vary are dealt, the most even ones first, into within // 3 + 1 blocks: such a pair differs by two bits
    or fewer in one block at least. Every hash stands under its blocks' values and all values one bit away, so that such
    a pair meets under a value. Values that more than `full` hashes stand under are divided by blocks of the bits that
    are left, and so on, so that a value which most hashes share doesn't bring all of them together.
    """
    items, zero, one = items.where("hash is not null"), F.lit(0).cast("long"), F.lit(1).cast("long")
    first = cut(items.groupBy("hash").agg(F.min("id").alias("id")))
    ones = first.agg(F.count("*").alias("n"), *(F.sum(F.shiftrightunsigned("hash", b).bitwiseAND(one)).alias(f"b{b}") for b in range(bits))).first()
    varied = sorted((b for b in range(bits) if 0 < (ones[f"b{b}"] or 0) < ones["n"]), key=lambda b: (abs(2 * ones[f"b{b}"] - ones["n"]), b))
    m, left = within // 3 + 1, len(varied)
    width = max(1, -(-left // m))
    places = [at for i in range(width) for k in range(m) if (at := k * width + i) < 64]
    moved = reduce(Column.bitwiseOR, [F.shiftleft(F.shiftrightunsigned("hash", b).bitwiseAND(one), at) for b, at in zip(varied, places, strict=False)], zero)
    rows, found, widths, used = first.select("id", moved.alias("r0"), zero.alias("path")), [], [], 0
    tag = max(1, (m - 1).bit_length())
    while True:
        depth, width = len(widths), max(1, -(-left // m))
        widths.append(width)
        under = [F.struct(F.lit(k).alias("k"), F.lit(x).cast("long").alias("x")) for k in range(m) for x in [0, *(1 << j if j < 63 else -1 << 63 for j in range(width))]]
        rows = rows.select("*", F.explode(F.array(*under)).alias("_u")).select("*", F.col("_u.k").alias(f"k{depth}"), F.col("_u.x").alias(f"x{depth}")).drop("_u")
        value = _shift(F.col(f"r{depth}"), F.col(f"k{depth}") * width).bitwiseAND(_low(width)).bitwiseXOR(F.col(f"x{depth}"))
        rows = rows.withColumn("path", F.shiftleft(F.shiftleft("path", tag).bitwiseOR(F.col(f"k{depth}").cast("long")), width).bitwiseOR(value))
        used, left, many = used + tag + width, width * (m - 1), 0
        if left >= m and used + tag + -(-left // m) < 63:
            big = cut(rows.groupBy("path").count().where(F.col("count") > full).select("path"))
            many = big.count()
            big = F.broadcast(big) if many <= 1 << 20 else big
        found.append(_meetings(rows.join(big, "path", "left_anti") if many else rows, widths, m, within))
        if not many:
            break
        shift = F.col(f"k{depth}") * width
        rest = F.col(f"r{depth}").bitwiseAND(F.call_function("shiftleft", one, shift) - 1).bitwiseOR(F.call_function("shiftleft", _shift(F.col(f"r{depth}"), shift + width), shift))
        rows = rows.join(big, "path", "left_semi").withColumn(f"r{depth + 1}", rest)
    copies = items.join(first.withColumnRenamed("id", "a"), "hash").where("id > a").select("a", F.col("id").alias("b"), F.lit(0).alias("distance"))
    return reduce(DataFrame.unionByName, found).unionByName(copies)


def _meetings(rows: DataFrame, widths: list[int], m: int, within: int) -> DataFrame:
    """Pairs of near hashes that stand under one path, each at one of the places where it could meet: on each level in
    the first block that differs by two bits at most, under b's own value or, of the two values between, under one."""
    other = rows.select("path", *(F.col(c).alias(f"_{c}") for c in rows.columns if c != "path"))
    near = [F.col("path") == F.col("_path"), F.col("id") < F.col("_id"), hamming(F.col("r0"), F.col("_r0")) <= within]
    for i, w in enumerate(widths):
        x, y, k = F.col(f"x{i}"), F.col(f"_x{i}"), F.col(f"k{i}")
        near.append((y == 0) | ((x != 0) & (x < y)))
        differ = F.col(f"r{i}").bitwiseXOR(F.col(f"_r{i}"))
        near += [(k <= j) | (F.bit_count(F.shiftrightunsigned(differ, j * w).bitwiseAND(_low(w))) > 2) for j in range(m - 1)]
    other = other.withColumnRenamed("path", "_path")
    return rows.join(other, reduce(lambda a, b: a & b, near)).select(F.col("id").alias("a"), F.col("_id").alias("b"), hamming(F.col("r0"), F.col("_r0")).alias("distance"))


def near_pairs(items: DataFrame, within: int = 10, bits: int = 64, block: int = BLOCK) -> DataFrame:
    """(a, b, distance): all pairs a < b of items (id, hash LONG) that differ in `within` bits or fewer, copies too.

    near_hashes finds the distinct hashes that are near; their items meet in blocks of up to `block` copies, so that no
    task holds more of a hash's items, though the pairs of n copies are n * (n - 1) / 2. Rows that repeat an id are items
    each, but not paired with one of their id. Null hashes and ids are near nothing.
    """
    rows = numbered(items.where("hash is not null and id is not null").select("id", "hash"), ["hash"], ["id"])
    rows = cut(rows.select("hash", F.floor((F.col("rn") - 1) / block).alias("part"), "id"))
    kinds = cut(rows.groupBy("hash").agg(F.count("*").alias("n"), F.max("part").alias("last")))
    copied = kinds.where("n > 1").select(F.col("hash").alias("h1"), F.col("hash").alias("h2"), F.lit(0).alias("distance"))
    near = near_hashes(kinds.select(F.col("hash").alias("id"), "hash"), within, bits).toDF("h1", "h2", "distance").unionByName(copied)
    # fewer than one in `block` items has a hash of several parts
    several = kinds.where("last > 0")
    for h, p in (("h1", "p1"), ("h2", "p2")):
        near = near.join(several.select(F.col("hash").alias(h), "last"), h, "left")
        near = near.select("h1", "h2", "distance", *(c for c in near.columns if c == "p1"), F.explode(F.sequence(F.lit(0).cast("long"), F.coalesce("last", F.lit(0).cast("long")))).alias(p))
    near = near.where("h1 != h2 or p1 <= p2")
    for i in "12":
        near = near.join(rows.select(F.col("hash").alias(f"h{i}"), F.col("part").alias(f"p{i}"), F.col("id").alias(f"i{i}")), [f"h{i}", f"p{i}"])
    # within a part both orders meet
    near = near.where("i1 < i2 or i1 > i2 and (h1 != h2 or p1 != p2)")
    return near.select(F.least("i1", "i2").alias("a"), F.greatest("i1", "i2").alias("b"), "distance")


def set_classes(left: DataFrame, right: DataFrame, key: str) -> DataFrame:
    """(kind, n): keys in both, only left, only right."""
    parts = [("both", left.select(key).intersect(right.select(key))), ("left", left.select(key).subtract(right.select(key))), ("right", right.select(key).subtract(left.select(key)))]
    return reduce(DataFrame.unionByName, [d.agg(F.count("*").alias("n")).select(F.lit(k).alias("kind"), "n") for k, d in parts])
