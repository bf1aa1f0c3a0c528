"""Row numbers that no task has to count alone, however many rows a key has."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lodestone.sources.shared import cut

#: A key's rows that one task may sort.
MOST = 1 << 18


def numbered(df: DataFrame, keys: list[str], order: list[Column | str], name: str = "rn", most: int = MOST) -> DataFrame:
    """df with a row number from 1 (LONG) within the keys, null being a key like others; without keys, over all rows.

    Keys of up to `most` rows (or a 2**17th of all, if that is more) are numbered by a window. The rows of others, which
    are fewer than 2**17, are cut into ranges of the order; each is numbered on its own and starts where the ones before
    it end. The order should tell rows apart: ties are numbered in any order, and equal ones stay in one range.
    """
    plain = F.row_number().over(Window.partitionBy(*keys).orderBy(*order)).cast("long")
    sizes = df.groupBy(F.xxhash64(*keys).alias("_h") if keys else F.lit(0).cast("long").alias("_h")).agg(F.count("*").alias("_n"))
    total, largest = sizes.agg(F.coalesce(F.sum("_n"), F.lit(0)), F.coalesce(F.max("_n"), F.lit(0))).first()
    limit = max(most, total >> 17)
    if largest <= limit:
        return df.withColumn(name, plain)
    key = F.xxhash64(*keys) if keys else F.lit(0).cast("long")
    hot = F.broadcast(cut(sizes.where(F.col("_n") > limit).select("_h")))
    rows = df.withColumn("_h", key)
    many = rows.join(hot, "_h", "left_semi").drop("_h")
    width = max(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-total // limit))
    many = cut(many.repartitionByRange(width, *keys, *order).withColumn("_c", F.spark_partition_id()))
    counts = many.groupBy("_c", *keys).agg(F.count("*").alias("_n"))
    before = F.sum("_n").over(Window.partitionBy(*keys).orderBy("_c").rowsBetween(Window.unboundedPreceding, -1))
    starts = counts.select(F.col("_c").alias("_c2"), *(F.col(k).alias(f"_k{i}") for i, k in enumerate(keys)), F.coalesce(before, F.lit(0)).alias("_b"))
    within = F.row_number().over(Window.partitionBy("_c", *keys).orderBy(*order))
    same = reduce(lambda a, b: a & b, (F.col(k).eqNullSafe(F.col(f"_k{i}")) for i, k in enumerate(keys)), F.col("_c") == F.col("_c2"))
    # a row per range, and one more per key at most
    out = many.withColumn("_w", within).join(F.broadcast(starts), same).withColumn(name, F.col("_w") + F.col("_b")).select(*df.columns, name)
    if not keys:
        return out
    few = rows.join(hot, "_h", "left_anti").drop("_h").withColumn(name, plain)
    return few.unionByName(out)
