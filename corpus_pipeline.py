"""From raw documents to a training mixture, in five stages.

Each stage takes (spark, docs, sf_dir), works on all that the stage before it kept, and returns what it keeps; all but
the last return the columns of documents. run() writes each stage's result to the shared folder and reads it again, so
a lost executor costs no more than the stage that runs.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestone.llm.common import SPACE, cut, shared_path, small, table
from lodestone.llm.decontaminate import clean_documents
from lodestone.llm.exactdup import exact_groups
from lodestone.llm.mixing import mixed_documents
from lodestone.llm.neardup import near_duplicates
from lodestone.llm.quality import score_documents, train


def quality_classifier(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the documents that the classifier doesn't reject (score of 0.5 or more); null and empty texts are scored
    like others, repeated rows each."""
    scored = score_documents(docs, train(docs, table(spark, sf_dir, "labels")))
    return scored.where("predicted = 1").select(docs.columns)


def exact_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one row of each group of equal texts: one of the smallest doc_id; null and empty texts are a group too.

    Of rows that repeat the doc_id, or in a group without any, that which is first as JSON stays. An empty table gives
    none; texts of any length are compared whole.
    """
    groups = cut(exact_groups(docs).select(F.col("doc_id").alias("i"), F.col("text_sha256").alias("s"), "kept"))
    gone = cut(groups.where("not kept").select("i", "s").distinct())
    gone = small(gone, gone.count(), 100)
    sha = F.sha2(F.regexp_replace(F.coalesce(docs["text"], F.lit("")), SPACE, " "), 256)
    left = docs.join(gone, docs["doc_id"].eqNullSafe(gone["i"]) & (sha == gone["s"]), "left_anti")
    several = cut(groups.where("kept").groupBy("s").count().where("count > 1").select("s"))
    if several.isEmpty():
        return left
    several = small(several, several.count(), 90)
    again = left.join(several, sha == several["s"], "left_semi").select(sha.alias("s"), F.struct(*docs.columns).alias("r"))
    again = again.groupBy("s").agg(F.min_by("r", F.to_json("r")).alias("r")).select("r.*")
    return left.join(several, sha == several["s"], "left_anti").unionByName(again)


def minhash_neardup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one document, of the smallest doc_id, of each group of near-duplicates (five words, 0.8 or more).

    Rows without doc_id, or of one that several rows have, are documents of their own that come after all others.
    Null and empty texts are no one's duplicates; an empty table gives no rows.
    """
    repeated = cut(docs.groupBy(F.col("doc_id").alias("i")).count().where("i is null or count > 1").select("i", F.lit(True).alias("again")))
    rows = docs.select(F.struct("*").alias("r"), F.col("doc_id").cast("long").alias("key"))
    if not repeated.isEmpty():
        rows = rows.join(small(repeated, repeated.count(), 17), F.col("r.doc_id").eqNullSafe(F.col("i")), "left")
        own = F.shiftrightunsigned(F.xxhash64("r.doc_id", "r.text"), 2).bitwiseOR(F.lit(1 << 62))
        rows = rows.select("r", F.when(F.col("again"), own).otherwise(F.col("key")).alias("key"))
    found = near_duplicates(rows.select(F.col("key").alias("doc_id"), "r.text"), width=5, percent=80)
    gone = cut(found.where("not kept").select(F.col("doc_id").alias("key")).distinct())
    return rows.join(small(gone, gone.count(), 16), "key", "left_anti").select("r.*")


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the documents that hold no benchmark item; null and empty texts hold none, repeated rows are judged each."""
    return clean_documents(docs, table(spark, sf_dir, "benchmark"))


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the documents that the mixture takes words of, with size, source_size, target and taken.

    Null and empty texts have no words and go; so does a table without words. A null source is a source.
    """
    return mixed_documents(docs)


STAGES = [("quality classifier", quality_classifier), ("exact dedup", exact_dedup), ("MinHash near-dedup", minhash_neardup), ("benchmark decontamination", decontamination), ("mixing to target weights", mixing)]

#: No SQL expresses the classifier.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        path = shared_path(spark, name.replace(" ", "-"))
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
