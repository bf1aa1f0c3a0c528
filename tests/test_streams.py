"""Stateful streams against the finished log, whatever the order in which files arrive."""

import datetime as dt
import random

from pyspark.sql import functions as F

from lodestone.streaming import monitor, sessions

SCHEMA = "session long, ts timestamp, id long, kind string, value string"


def write(spark, folder, k, rows):
    spark.createDataFrame(rows, SCHEMA).coalesce(1).write.parquet(f"{folder}/{k:02d}")


def events(rng):
    start = dt.datetime(2024, 1, 1)
    rows = []
    for i in range(160):
        kind = rng.choice(["heartbeat"] * 5 + ["command", "phase"])
        rows.append((rng.randrange(4), start + dt.timedelta(microseconds=rng.randrange(2_400_000_000)), i, kind, None if kind == "heartbeat" else f"{kind}{rng.randrange(3)}"))
    return rows


def test_sessions_do_not_depend_on_the_order_of_arrival(spark, tmp_path):
    rows = events(random.Random(2))
    # the last event sets the watermark to a time after all others
    end = dt.datetime(2024, 1, 1, 2)
    late = 3 * 3600
    want = None
    for order in range(3):
        folder = tmp_path / str(order)
        mixed = sorted(rows, key=lambda r: r[1]) if order == 0 else random.Random(order).sample(rows, len(rows))
        for k in range(2):
            write(spark, folder, k, mixed[80 * k : 80 * k + 80])
        write(spark, folder, 9, [(99, end + dt.timedelta(seconds=late), 1000, "phase", "end")])
        stream = spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).parquet(f"{folder}/*")
        got = sorted(map(tuple, sessions.drain_sessions(stream, str(tmp_path / f"out{order}"), late=f"{late} seconds").collect()), key=str)
        log = sessions.sessions_log(spark.createDataFrame(rows, SCHEMA), int(end.timestamp()) * 1_000_000)
        want = sorted(map(tuple, log.collect()), key=str)
        assert got == want
    kinds = [r[2] for r in want]
    assert kinds.count("timeout") > 4 and kinds.count("handed") > 8 and kinds.count("phase") == 12


def test_a_session_has_one_timer():
    """However many events wait: a call for each of them is what takes the time."""

    class Handle:
        timers, value = set(), None
        getListState = getValueState = getMapState = lambda self, *_: self
        appendList = lambda self, _: None
        registerTimer, deleteTimer = timers.add, timers.discard

        def get(self):
            return self.value

        def update(self, value):
            self.value = value

    state = sessions.Sessions()
    state.init(Handle())
    for first in (5_000, 9_000, 2_000):
        rows = [{"us": 1000 * k, "id": k, "kind": "heartbeat", "value": None} for k in range(first, first + 500)]
        assert list(state.handleInputRows((1,), iter(rows), None)) == []
    assert Handle.timers == {2_000 + sessions.SHIFT_MS}


def test_writer_replays_and_rejects(spark, tmp_path):
    out = str(tmp_path / "table")
    write_one = monitor.Writer(out, "id", {"name": F.col("name").isNotNull(), "size": F.col("size") >= 0})
    batch = spark.createDataFrame([(1, "a", 5), (2, None, 6), (3, "c", -1), (1, "b", 7), (None, "x", 1)], "id long, name string, size long")
    write_one(batch, 0)
    state = lambda: (sorted(map(tuple, monitor.read_written(spark, out).collect())), sorted((r.id or 0, r.reason) for r in monitor.read_rejected(spark, out).collect()))
    first = state()
    assert first == ([(1, "b", 7)], [(0, "id"), (2, "name"), (3, "size")])
    write_one(batch, 0)
    assert state() == first
    write_one(spark.createDataFrame([(1, "z", 0), (4, "d", 2)], "id long, name string, size long"), 1)
    write_one(batch, 0)  # a replay of an old batch doesn't undo a later one
    assert state()[0] == [(1, "z", 0), (4, "d", 2)]


def test_watch_sees_each_change_once(spark, tmp_path):
    folder, state = tmp_path / "in", str(tmp_path / "state")
    (folder / "a").mkdir(parents=True)
    (folder / "a/x.png").write_bytes(b"1")
    (folder / "y.jpg").write_bytes(b"22")
    (folder / "n.txt").write_bytes(b"3")
    changes = lambda: sorted((r["change"], r["path"].rsplit("/", 1)[1]) for r in monitor.watch(spark, str(folder), state).collect())
    assert changes() == [("create", "x.png"), ("create", "y.jpg")] and changes() == []
    (folder / "a/x.png").write_bytes(b"11")
    (folder / "y.jpg").unlink()
    (folder / "z.psd").write_bytes(b"4")
    assert changes() == [("create", "z.psd"), ("delete", "y.jpg"), ("modify", "x.png")] and changes() == []
