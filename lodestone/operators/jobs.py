"""The work queue as queries over its state or its log of transitions. `now` is always given."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lodestone.functions.predicates import json_flag


def histogram(jobs: DataFrame, status: str = "status") -> DataFrame:
    return jobs.groupBy(status).agg(F.count("*").alias("n"))


def phase_sums(jobs: DataFrame, flags: str, phases: list[str]) -> DataFrame:
    """One row: jobs that aren't failed or cancelled, by phase done."""
    live = jobs.where(~F.col("status").isin("failed", "cancelled"))
    return live.agg(F.count("*").alias("live"), *(F.count_if(json_flag(F.col(flags), f"$.{p}")).alias(p) for p in phases))


def within(ts: str, now: Column, seconds: int) -> Column:
    return (F.col(ts) > now - F.expr(f"interval {seconds} seconds")) & (F.col(ts) <= now)


def throughput(done: DataFrame, ts: str, now: Column, by: list[str] | None = None) -> DataFrame:
    """Per minute: the last minute's count, or if that is 0 a fifth of the last five minutes', to one place."""
    g = done.where(within(ts, now, 300)).groupBy(*(by or [])).agg(F.count_if(within(ts, now, 60)).alias("m1"), F.count("*").alias("m5"))
    return g.withColumn("per_minute", F.when(F.col("m1") > 0, F.col("m1").cast("double")).otherwise(F.bround(F.col("m5") / 5.0, 1)))


def eta_seconds(remaining: Column, per_minute: Column) -> Column:
    return F.when((remaining > 0) & (per_minute > 0), F.bround(remaining / per_minute * 60).cast("long"))


def claim(jobs: DataFrame, n: int, parsed: Column | None = None) -> DataFrame:
    """The n pending jobs to hand out, by priority, age and id; before these by whether they are parsed, if that is given."""
    tier = F.lit(0) if parsed is None else F.when(parsed, 0).otherwise(1)
    return jobs.where("status = 'pending'").withColumn("tier", tier).orderBy("tier", F.desc("priority"), "created_at", "id").limit(n)


def claim_size(asked: int, pressure: str) -> int:
    """critical takes none, danger one, warning half."""
    return {"critical": 0, "danger": min(1, asked), "warning": max(1, asked // 2)}.get(pressure, asked)


def after_failure(jobs: DataFrame, failed: DataFrame) -> DataFrame:
    """Failed jobs go back to pending while they have retries left; the count rises either way."""
    hit = jobs.join(failed.select("id").distinct().withColumn("_f", F.lit(True)), "id", "left")
    status = F.when(F.col("_f") & (F.col("retry_count") < F.col("max_retries")), "pending").when(F.col("_f"), "failed").otherwise(F.col("status"))
    return hit.withColumn("status", status).withColumn("retry_count", F.col("retry_count") + F.when(F.col("_f"), 1).otherwise(0)).drop("_f")


def reclaim_stale(jobs: DataFrame, now: Column, minutes: int = 30) -> DataFrame:
    stale = F.col("status").isin("assigned", "processing") & (F.col("assigned_at") < now - F.expr(f"interval {minutes} minutes"))
    return jobs.withColumn("status", F.when(stale, "pending").otherwise(F.col("status"))).withColumn("assigned_at", F.when(~stale | F.col("assigned_at").isNull(), F.col("assigned_at")))


def fold(log: DataFrame, key: str, ts: str, tiebreak: str, last: list[str], first: list[str] = ()) -> DataFrame:
    """The state that a log leads to: of each column the last value, or the first for those first written wins."""
    order = F.struct(ts, tiebreak)
    return log.groupBy(key).agg(*(F.max_by(c, order).alias(c) for c in last), *(F.min_by(c, order).alias(f"first_{c}") for c in first))


def missing_structure(files: DataFrame, vv: DataFrame, structure: DataFrame, active: DataFrame) -> DataFrame:
    """Files with a visual vector, without a structure vector and without an active job."""
    return files.join(vv.select("id"), "id", "left_semi").join(structure.select("id"), "id", "left_anti").join(active.select("id"), "id", "left_anti")


def or_else(a: Column, b: Column) -> Column:
    """a unless it is null or 0, else b, else 0."""
    return F.when(a > 0, a).otherwise(F.coalesce(b, F.lit(0)))


def timed_out(sessions: DataFrame, now: Column, minutes: int = 3) -> DataFrame:
    return sessions.where((F.col("status") == "online") & (F.col("last_heartbeat") < now - F.expr(f"interval {minutes} minutes")))


def pool_mode(workers: DataFrame, mode: str = "mode", general: str = "full", auto: bool = True, by: list[str] | None = None) -> DataFrame:
    """One row (or one for each group): the mode that the pools work in for the online workers.

    A worker without a mode of its own works in the general one. One mc_only worker decides, else one embed_only worker,
    else the general mode holds. Without workers it is auto, unless that is switched off.
    """
    own = F.coalesce(F.nullif(F.col(mode), F.lit("")), F.lit(general))
    has = lambda m: F.coalesce(F.bool_or(own == m), F.lit(False))
    pool = F.when(F.count("*") == 0, "auto" if auto else general).when(has("mc_only"), "mc_only").when(has("embed_only"), "embed_only").otherwise(general)
    return workers.groupBy(*(by or [])).agg(pool.alias("pool"))


def demand(claims: DataFrame, now: Column, seconds: int = 120) -> DataFrame:
    """One row: the sum of each session's last claim of the last seconds."""
    last = claims.where(within("ts", now, seconds)).groupBy("session").agg(F.max_by("count", F.struct("ts", "id")).alias("last"))
    return last.agg(F.coalesce(F.sum("last"), F.lit(0)).alias("demand"))


def rate_limited(requests: DataFrame, key: str, ts: str, tiebreak: str, most: int = 5, seconds: int = 60) -> DataFrame:
    """Adds in_window (requests of the key in the seconds up to this one) and limited (more than most)."""
    w = Window.partitionBy(key).orderBy(F.unix_micros(F.col(ts).cast("timestamp"))).rangeBetween(-seconds * 1_000_000 + 1, 0)
    return requests.withColumn("in_window", F.count("*").over(w)).withColumn("limited", F.col("in_window") > most)


def sliding_counts(done: DataFrame, ts: str = "ts", size: str = "5 minutes", slide: str = "1 minute", by: list[str] | None = None) -> DataFrame:
    """Counts by sliding window; the same columns work on a stream."""
    g = done.groupBy(F.window(ts, size, slide), *(by or [])).agg(F.count("*").alias("n"))
    return g.select(F.col("window.start").alias("window_start"), F.col("window.end").alias("window_end"), *(by or []), "n")


def unchanged(verify_hash: bool = False) -> Column:
    """Whether a found file (path, size, mtime, hash) is as the catalog knows it (_size, _mtime, _hash).

    Times are compared with a space for T. What the catalog doesn't know (null, or an empty time) isn't compared, so
    that files of old catalogs aren't processed again; a file that it doesn't know at all is changed. Hashes, if asked
    for and known, must agree.
    """
    same = F.coalesce(F.col("size") == F.col("_size"), F.col("_size").isNull())
    time = F.replace("mtime", F.lit("T"), F.lit(" ")) == F.replace("_mtime", F.lit("T"), F.lit(" "))
    same = same & (F.coalesce(time, F.lit(False)) | (F.coalesce("_mtime", F.lit("")) == ""))
    if verify_hash:
        same = same & F.coalesce(F.col("hash") == F.col("_hash"), F.lit(True))
    return F.coalesce(F.col("_path").isNotNull() & same, F.lit(False))


def _known(found: DataFrame, known: DataFrame) -> DataFrame:
    k = known.select(*(F.col(c).alias(f"_{c}") for c in known.columns))
    return found.join(k, F.col("path") == F.col("_path"), "left")


def skip_flags(found: DataFrame, known: DataFrame, models: dict[str, str] | None = None, verify_hash: bool = False) -> DataFrame:
    """Adds skip_caption, skip_vv, skip_mv to found (path, size, mtime): unchanged, the output there, of the same model.

    known: path, size, mtime, caption, has_vv, has_structure, has_mv, and caption_model, vv_model, mv_model for those
    models that are given. A visual vector is made anew with the structure vector, so both must be there.
    """
    rows, same = _known(found, known), unchanged(verify_hash)
    model = lambda k: F.coalesce(F.col(f"_{k}_model") == models[k], F.lit(False)) if models and k in models else F.lit(True)
    has = lambda c: F.coalesce(F.col(f"_has_{c}"), F.lit(False))
    caption = F.coalesce(F.trim("_caption"), F.lit("")) != ""
    return rows.select(*found.columns, (same & caption & model("caption")).alias("skip_caption"), (same & has("vv") & has("structure") & model("vv")).alias("skip_vv"), (same & has("mv") & model("mv")).alias("skip_mv"))


def skip_file(found: DataFrame, known: DataFrame, verify_hash: bool = False) -> DataFrame:
    """Adds skip to found: unchanged, with a relative path, and every output there."""
    rows = _known(found, known)
    done = unchanged(verify_hash) & (F.coalesce(F.trim("_caption"), F.lit("")) != "") & (F.coalesce(F.trim("_relative_path"), F.lit("")) != "")
    for c in ("_has_vv", "_has_mv", "_has_structure"):
        done = done & F.coalesce(F.col(c), F.lit(False))
    return rows.select(*found.columns, done.alias("skip"))


def create(jobs: DataFrame, wanted: DataFrame) -> DataFrame:
    """The rows of wanted (file_path, ...), once each, for which no job waits or runs."""
    active = jobs.where(F.col("status").isin("pending", "assigned", "processing")).select("file_path").distinct()
    return wanted.dropDuplicates(["file_path"]).join(active, "file_path", "left_anti")


def claimable(mode: str, flags: str = "phase_completed") -> Column:
    """What a worker of this mode may claim: mc_only parsed jobs, embed_only those with a caption and no vectors, others
    all whose parse isn't under way."""
    if mode == "mc_only":
        return F.coalesce(F.col("parse_status") == "parsed", F.lit(False))
    if mode == "embed_only":
        return json_flag(F.col(flags), "$.vision") & not_embedded(flags)
    return F.col("parse_status").isNull() | F.col("parse_status").isin("parsed", "pending", "failed")


def not_embedded(flags: str = "phase_completed", strict: bool = False) -> Column:
    """Whether the embed flag is off: missing counts as off, but for the strict form."""
    off = F.get_json_object(flags, "$.embed").isin("false", "0")
    return F.coalesce(off, F.lit(not strict))


def route(jobs: DataFrame, asked: int, mode: str, override: str | None = None, pressure: str = "normal") -> DataFrame:
    """The jobs for one worker: its own mode goes before the general one, and load cuts the number.

    Parsed jobs go first in the full mode; in the others priority alone decides.
    """
    mode = override or mode
    parsed = None if mode in ("mc_only", "embed_only") else F.coalesce(F.col("parse_status") == "parsed", F.lit(False))
    return claim(jobs.where(claimable(mode)), claim_size(asked, pressure), parsed)


def reclaim_session(jobs: DataFrame, session: int) -> DataFrame:
    """What a session held is pending again; phase flags stay."""
    held = F.col("status").isin("assigned", "processing") & (F.col("worker_session_id") == session)
    held = F.coalesce(held, F.lit(False))
    return jobs.withColumn("status", F.when(held, "pending").otherwise(F.col("status"))).withColumn("worker_session_id", F.when(~held, F.col("worker_session_id")))


def cancel(jobs: DataFrame, ids: DataFrame) -> DataFrame:
    """Pending, assigned and failed ones of ids are cancelled."""
    hit = jobs.join(ids.select("id").distinct().withColumn("_c", F.lit(True)), "id", "left")
    gone = F.col("_c") & F.col("status").isin("pending", "assigned", "failed")
    return hit.withColumn("status", F.when(gone, "cancelled").otherwise(F.col("status"))).drop("_c")


def retry_failed(jobs: DataFrame) -> DataFrame:
    """Failed jobs are pending again with no retries used; a failed parse may be tried again."""
    failed = F.col("status") == "failed"
    parse = F.when(~(failed & F.coalesce(F.col("parse_status") == "failed", F.lit(False))), F.col("parse_status"))
    return jobs.withColumn("parse_status", parse).withColumn("retry_count", F.when(failed, 0).otherwise(F.col("retry_count"))).withColumn("status", F.when(failed, "pending").otherwise(F.col("status")))


def clear_completed(jobs: DataFrame) -> DataFrame:
    return jobs.where(~F.coalesce(F.col("status") == "completed", F.lit(False)))


def startup(jobs: DataFrame, now: Column, minutes: int = 30) -> DataFrame:
    """Stale jobs are pending again, parses that were under way are undone."""
    return reclaim_stale(jobs, now, minutes).withColumn("parse_status", F.when(~F.coalesce(F.col("parse_status") == "parsing", F.lit(False)), F.col("parse_status")))


def startup_sessions(sessions: DataFrame) -> DataFrame:
    return sessions.withColumn("status", F.when(F.col("status") == "online", "offline").otherwise(F.col("status")))


def parse_deficit(jobs: DataFrame, target: Column) -> DataFrame:
    """One row: how many jobs to parse ahead so that `target` of the pending ones are parsed."""
    parsed = F.count_if((F.col("status") == "pending") & (F.col("parse_status") == "parsed"))
    return jobs.agg(parsed.alias("parsed")).select("parsed", F.greatest(F.lit(0), target - F.col("parsed")).alias("deficit"))


def worker_state(active_hours: Column, jobs_held: Column) -> Column:
    """resting outside of its hours, else active with work and idle without."""
    return F.when(~active_hours, "resting").when(jobs_held > 0, "active").otherwise("idle")


def override(sessions: DataFrame, heartbeats: DataFrame) -> DataFrame:
    """Sessions (session, pending_command, mode) after heartbeats (session, ts, id): a command is handed out once.

    handed: the pending command for the first heartbeat of a session, which also clears it.
    """
    beat = heartbeats.select("session").distinct().withColumn("_b", F.lit(True))
    rows = sessions.join(beat, "session", "left")
    return rows.withColumn("handed", F.when(F.col("_b"), F.col("pending_command"))).withColumn("pending_command", F.when(F.col("_b").isNull(), F.col("pending_command"))).drop("_b")


def batch_growth(steps: DataFrame, drop: float = 0.05) -> DataFrame:
    """Adds previous, best and verdict to (run, step, rate): grow while the rate doesn't fall by `drop` of the one before."""
    w = Window.partitionBy("run").orderBy("step")
    out = steps.withColumn("previous", F.lag("rate").over(w)).withColumn("best", F.max("rate").over(w.rowsBetween(Window.unboundedPreceding, Window.currentRow)))
    return out.withColumn("verdict", F.when(F.col("previous").isNull(), "start").when(F.col("rate") < F.col("previous") * (1 - drop), "refine").otherwise("grow"))


# The loads from which on each metric is a warning, a danger, critical; percentages, and degrees.
LIMITS = {"gpu_memory": (70, 85, 95), "cpu": (80, 90, 95), "memory": (75, 85, 95), "gpu_temp": (75, 85, 90)}
LEVELS = ("normal", "warning", "danger", "critical")


def load_level(metrics: dict[str, Column], limits: dict[str, tuple[float, float, float]] = LIMITS) -> Column:
    """The name of the worst level of the metrics, each by its own limits; a missing one counts as normal."""
    ordinal = lambda c, x: F.when(c >= x[2], 3).when(c >= x[1], 2).when(c >= x[0], 1).otherwise(0)
    worst = [ordinal(c, limits[k]) for k, c in metrics.items()]
    return F.element_at(F.array(*map(F.lit, LEVELS)), (F.greatest(*worst) if len(worst) > 1 else worst[0]) + 1)


def worst_level(metrics: list[Column], warn: float, danger: float, critical: float) -> Column:
    """load_level of metrics that share their limits."""
    return load_level(dict(enumerate(metrics)), {i: (warn, danger, critical) for i in range(len(metrics))})
