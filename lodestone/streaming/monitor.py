"""Structured Streaming forms of the monitoring queries, a writer of keyed tables, and a watch over folders."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from lodestone.operators.jobs import sliding_counts
from lodestone.sources.files import EXTENSIONS
from lodestone.sources.shared import cut


def read_events(spark: SparkSession, path: str, schema) -> DataFrame:
    """New Parquet files under a folder, or matching a glob, as a stream."""
    return spark.readStream.schema(schema).parquet(path)


def live_throughput(events: DataFrame, late: str = "10 minutes", by: list[str] | None = None) -> DataFrame:
    return sliding_counts(events.withWatermark("ts", late), by=by)


def live_sessions(events: DataFrame, key: str = "user_id", gap: str = "3 minutes", late: str = "10 minutes") -> DataFrame:
    """A worker's spells of activity: a gap of silence ends one, as a heartbeat timeout does."""
    g = events.withWatermark("ts", late).groupBy(F.session_window("ts", gap), key).agg(F.count("*").alias("beats"))
    return g.select(key, F.col("session_window.start").alias("online"), F.col("session_window.end").alias("offline"), "beats")


def drain(stream: DataFrame, folder: str, mode: str = "complete") -> DataFrame:
    """Runs a stream over what there is and returns its result: in complete mode the last batch's, else that of all.

    Batches are Parquet in a new folder that driver and executors share; a batch that is run again replaces its own.
    """
    done: dict[int, str] = {}

    def keep(batch: DataFrame, i: int) -> None:
        done[i] = f"{folder}/batch-{i}"
        batch.write.mode("overwrite").parquet(done[i])

    q = stream.writeStream.foreachBatch(keep).outputMode(mode).option("checkpointLocation", f"{folder}/state").trigger(availableNow=True).start()
    q.awaitTermination()
    paths = [done[max(done)]] if done and mode == "complete" else list(done.values())
    spark = stream.sparkSession
    return spark.read.schema(stream.schema).parquet(*paths) if paths else spark.createDataFrame([], stream.schema)


class Writer:
    """foreachBatch sink of a keyed table: batches that are written twice change nothing, bad rows reject themselves only.

    A batch's good rows go to <path>/rows/batch=<i>, its others to <path>/rejected/batch=<i> with the reason: the name of
    the first check that doesn't hold, or of the key if that is null. Either folder is replaced as a whole, so that a
    batch that was cut short is done again. A key's row is that of the last batch (read_written); within a batch, of
    rows of one key, that which is last as JSON stays.
    """

    def __init__(self, path: str, key: str, checks: dict[str, Column] | None = None):
        self.path, self.key, self.checks = path, key, checks or {}

    def __call__(self, batch: DataFrame, i: int) -> None:
        done = self._done(batch.sparkSession)
        if done is not None and i <= done:
            return
        reason = F.when(F.col(self.key).isNull(), self.key)
        for name, check in self.checks.items():
            reason = reason.when(~F.coalesce(check, F.lit(False)), name)
        rows = batch.withColumn("reason", reason)
        rows.where("reason is not null").write.mode("overwrite").parquet(f"{self.path}/rejected/batch={i}")
        good = rows.where("reason is null").drop("reason")
        good = good.withColumn("_r", F.struct(*good.columns)).groupBy(self.key).agg(F.max_by("_r", F.to_json("_r")).alias("_r")).select("_r.*")
        good.write.mode("overwrite").parquet(f"{self.path}/rows/batch={i}")
        state = batch.sparkSession.createDataFrame([(i, self.key)], "done long, key string")
        state.coalesce(1).write.mode("overwrite").parquet(f"{self.path}/done/batch={i}")

    def _done(self, spark: SparkSession) -> int | None:
        """The last batch that is written whole."""
        return _state(spark, self.path)[0] if _exists(spark, f"{self.path}/done") else None

    def start(self, stream: DataFrame, every: str | None = None) -> StreamingQuery:
        """Writes a stream; without `every` (such as '10 seconds'), what there is."""
        trigger = {"processingTime": every} if every else {"availableNow": True}
        return stream.writeStream.foreachBatch(self).option("checkpointLocation", f"{self.path}/stream").trigger(**trigger).start()


def _exists(spark: SparkSession, path: str) -> bool:
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()).exists(p)


def _state(spark: SparkSession, path: str) -> tuple[int, str]:
    last = spark.read.parquet(f"{path}/done").orderBy(F.desc("done")).first()
    return last["done"], last["key"]


def read_written(spark: SparkSession, path: str) -> DataFrame:
    """The table that a Writer keeps: of each key the row of the last batch that is written whole."""
    done, key = _state(spark, path)
    rows = spark.read.parquet(f"{path}/rows").where(F.col("batch") <= done)
    return rows.groupBy(key).agg(F.max_by(F.struct(*(c for c in rows.columns if c != "batch")), "batch").alias("_r")).select("_r.*")


def read_rejected(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(f"{path}/rejected").where(F.col("batch") <= _state(spark, path)[0])


def watch(spark: SparkSession, root: str, state: str, extensions: tuple[str, ...] = EXTENSIONS) -> DataFrame:
    """(change, path, size, modified): what was created, modified or deleted under root since the last call with this
    state folder; at first, all files are new.

    Spark lists the files without reading them; the listing is kept as the next snapshot, and changes are a join of both.
    The snapshot is in place before the changes are returned as a table of their own, so that each is told once, and a
    call that fails before leaves the last snapshot to be compared again.
    """
    glob = "*.{" + ",".join(x for e in extensions for x in (e, e.upper())) + "}"
    raw = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", glob).load(root)
    listing = raw.select("path", F.col("length").alias("size"), F.col("modificationTime").alias("modified"))
    kept = "path string, size long, modified timestamp, number long"
    last = spark.read.schema(kept).parquet(f"{state}/snapshots").agg(F.max("number")).first()[0] if _exists(spark, f"{state}/snapshots") else None
    number = 0 if last is None else last + 1
    # a row without path marks the snapshot of an empty folder
    mark = spark.range(1).select(F.lit(None).cast("string").alias("path"), F.lit(None).cast("long").alias("size"), F.lit(None).cast("timestamp").alias("modified"))
    pending = f"{state}/changes/number={number}"
    listing = cut(listing)
    old = spark.read.schema(kept).parquet(f"{state}/snapshots/number={last}").where("path is not null").drop("number") if last is not None else listing.limit(0)
    old = old.select(F.col("path").alias("_p"), F.col("size").alias("_s"), F.col("modified").alias("_m"))
    both = listing.join(old, F.col("path") == F.col("_p"), "full_outer")
    same = F.col("size").eqNullSafe(F.col("_s")) & F.col("modified").eqNullSafe(F.col("_m"))
    change = F.when(F.col("_p").isNull(), "create").when(F.col("path").isNull(), "delete").when(~same, "modify")
    both = both.select(change.alias("change"), F.coalesce("path", "_p").alias("path"), F.coalesce("size", "_s").alias("size"), F.coalesce("modified", "_m").alias("modified"))
    both.where("change is not null").write.mode("overwrite").parquet(pending)
    listing.unionByName(mark).write.mode("overwrite").parquet(f"{state}/snapshots/number={number}")
    return spark.read.schema("change string, path string, size long, modified timestamp").parquet(pending)
