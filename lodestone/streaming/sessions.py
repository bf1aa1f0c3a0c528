"""Worker sessions as a stateful stream: heartbeats, commands, phases and timeouts; and the same of a finished log.

Events are rows (session, ts, id, kind, value). A `command` waits for the session's next `heartbeat`, which it is handed
to; a later command replaces one that waits. A session whose heartbeats stop for longer than `silence` times out once,
at the end of that time, and is back with its next heartbeat. Of `phase` events of one value the first counts.

The stream keeps events until the watermark has passed them and takes them in order of (ts, id, kind, value), nulls
first, so that its rows don't depend on the order in which events arrive, as long as none is later than the watermark
allows. A command without value takes the place of one that waits, and nothing is handed. Watermarks are whole
milliseconds: event times are rounded for them (whole_ms), so that a last event beyond half a millisecond counts.
"""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import Column, DataFrame, Row, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from lodestone.streaming import monitor

SILENCE_US = 180_000_000
#: State with timers needs it.
ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
#: From year 1 to 1970. Spark's watermarks begin at 1970, so the stream's event times and timers are so much later.
SHIFT_MS = 62_135_596_800_000

#: Events that stand in one entry of the state.
PACK = 1 << 12


def _packed(events: list[tuple]) -> list[tuple]:
    """Events (us, id, kind, value) as entries of the state, a list of each field: an entry costs as much as many events."""
    return [tuple(map(list, zip(*events[i : i + PACK], strict=True))) for i in range(0, len(events), PACK)]


def _in_order(e: tuple) -> tuple:
    """What events (us, id, kind, value) are sorted by, nulls first."""
    return tuple((x is not None, x) if x is not None else (False,) for x in e)


def whole_ms(us: str | Column) -> Column:
    """Microseconds rounded to whole milliseconds, halves away from zero."""
    return F.round(us, -3)


def _ms(us: int) -> int:
    """The first millisecond that isn't before a microsecond, as timers have it."""
    return -(-us // 1000) + SHIFT_MS


class Sessions(StatefulProcessor):
    """A session's state: events that wait for the watermark, the last heartbeat (null after a timeout), the command that
    waits, its timer, and the phases that are known. Times are microseconds, timers are milliseconds, SHIFT_MS later.

    A session has one timer, for the first of what waits and the end of the silence; each call sets the next."""

    def __init__(self, silence_us: int = SILENCE_US):
        self.silence = silence_us

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.waiting = handle.getListState("waiting", "us array<long>, id array<long>, kind array<string>, value array<string>")
        self.now = handle.getValueState("now", "last long, command string, timer long")
        self.phases = handle.getMapState("phases", "phase string", "id long")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[Row]:
        new = [(r["us"], r["id"], r["kind"], r["value"]) for r in rows]
        self.waiting.appendList(_packed(new))
        last, command, timer = self.now.get() or (None, None, None)
        at = _ms(min(e[0] for e in new))
        if timer is None or at < timer:
            if timer is not None:
                self.handle.deleteTimer(timer)
            self.handle.registerTimer(at)
            self.now.update((last, command, at))
        return iter(())

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:
        # all that the watermark has passed
        until = (timerValues.getCurrentWatermarkInMs() - SHIFT_MS) * 1000
        events = sorted((e for entry in self.waiting.get() for e in zip(*entry, strict=True)), key=_in_order)
        due = [e for e in events if e[0] <= until]
        last, command, _ = self.now.get()
        out, known = [], set()
        for us, i, kind, value in [*due, (until, None, "", None)]:
            if last is not None and last + self.silence < us:
                out.append((last + self.silence, "timeout", None))
                last = None
            if kind == "heartbeat":
                if command is not None:
                    out.append((us, "handed", command))
                last, command = us, None
            elif kind == "command":
                command = value
            elif kind == "phase" and value not in known:
                known.add(value)
                if not self.phases.containsKey((value,)):
                    self.phases.updateValue((value,), (i,))
                    out.append((us, "phase", value))
        ahead = [_ms(e[0]) for e in events[len(due) : len(due) + 1]]
        if last is not None:
            ahead.append(_ms(last + self.silence + 1))
        timer = min(ahead, default=None)
        if timer is not None:
            self.handle.registerTimer(timer)
        if len(due) < len(events):
            self.waiting.put(_packed(events[len(due) :]))
        elif due:
            self.waiting.clear()
        self.now.update((last, command, timer))
        return iter([Row(session=key[0], us=us, what=what, value=value) for us, what, value in out])


def live_sessions_log(events: DataFrame, silence_us: int = SILENCE_US, late: str = "10 minutes") -> DataFrame:
    """(session, ts, what, value) of a stream of events; what is handed, timeout or phase. Null sessions and times go."""
    rows = events.where("session is not null and ts is not null").withColumn("us", F.unix_micros("ts"))
    rows = rows.select("session", F.timestamp_micros(whole_ms("us") + 1000 * SHIFT_MS).alias("ts"), "us", "id", "kind", "value")
    kind = events.schema["session"].dataType.simpleString()
    out = rows.withWatermark("ts", late).groupBy("session").transformWithState(Sessions(silence_us), f"session {kind}, us long, what string, value string", "append", "eventtime")
    return out.select("session", F.timestamp_micros("us").alias("ts"), "what", "value")


def drain_sessions(events: DataFrame, folder: str, silence_us: int = SILENCE_US, late: str = "10 minutes") -> DataFrame:
    """live_sessions_log of what there is, with its state in RocksDB."""
    spark, name = events.sparkSession, "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(name, None)
    spark.conf.set(name, ROCKSDB)
    try:
        return monitor.drain(live_sessions_log(events, silence_us, late), folder, "append")
    finally:
        spark.conf.set(name, before) if before else spark.conf.unset(name)


def sessions_log(events: DataFrame, until_us: int, silence_us: int = SILENCE_US) -> DataFrame:
    """The rows that the stream gives once its watermark is at until_us (a whole millisecond), of a finished log."""
    e = events.where("session is not null and ts is not null").withColumn("us", F.unix_micros("ts")).where(F.col("us") <= until_us)
    w = Window.partitionBy("session").orderBy("us", "id", "kind", "value")
    before = w.rowsBetween(Window.unboundedPreceding, -1)
    e = e.withColumn("_n", F.row_number().over(w))
    beat, command = F.when(F.col("kind") == "heartbeat", F.col("_n")), F.when(F.col("kind") == "command", F.struct("_n", "value"))
    e = e.withColumns({"_b": F.last(beat, True).over(before), "_c": F.last(command, True).over(before)})
    handed = e.where("kind = 'heartbeat' and _c is not null and (_b is null or _c._n > _b)").select("session", "us", F.lit("handed").alias("what"), F.col("_c.value").alias("value"))
    beats = e.where("kind = 'heartbeat'").withColumn("_next", F.lead("us").over(w))
    end = F.col("us") + silence_us
    silent = beats.where(end < F.least(F.coalesce("_next", F.lit(until_us)), F.lit(until_us))).select("session", end.alias("us"), F.lit("timeout").alias("what"), F.lit(None).cast("string").alias("value"))
    phases = e.where("kind = 'phase'").groupBy("session", "value").agg(F.min("us").alias("us")).select("session", "us", F.lit("phase").alias("what"), "value")
    return handed.where("value is not null").unionByName(silent).unionByName(phases).select("session", F.timestamp_micros("us").alias("ts"), "what", "value")
