"""Path chunks with typed state and timers: out of order, after a restart, and after a key has been idle."""

from __future__ import annotations

import datetime
import math

from plumbline.streaming import windows

SCHEMA = "k string, id long, ts timestamp, x double, z double, ok boolean"


def plain(rows, reach, upto):
    found = {}
    for k in {r[0] for r in rows}:
        length, last, good = 0.0, None, (None, None)
        for _, ident, ts, x, z, ok in sorted((r for r in rows if r[0] == k), key=lambda r: (r[2], r[1])):
            length += math.hypot(x - last[0], z - last[1]) if last else 0.0
            last = (x, z)
            good = last if ok else good
            if ts <= upto:
                found[k, ident] = (int(length // reach), round(length, 9), *good)
    return found


def test_chunks_go_on_after_a_restart(spark, tmp_path):
    start = datetime.datetime(2024, 1, 1, tzinfo=datetime.timezone.utc)
    at = lambda minutes: start + datetime.timedelta(minutes=minutes)
    rows = [("a", i, at(i), i * 0.5, float(i % 3), i % 4 != 0) for i in range(40)] + [("b", 100 + i, at(2 * i), -float(i), 0.0, i > 3) for i in range(20)] + [("c", 300, at(5), 1.0, 1.0, None)]
    first = [r for r in rows if r[1] % 5 != 3 and r[2] < at(25)]  # some come late, in the second part
    second = [r for r in rows if r not in first]
    assert any(r[2] < at(25) for r in second)
    folder, base = f"{tmp_path}/in", f"file://{tmp_path}/run"
    with windows.rocksdb_state(spark):
        for part in (first, second, [("a", 999, at(500), 0.0, 0.0, True)]):
            spark.createDataFrame(part, SCHEMA).coalesce(1).write.mode("append").parquet(folder)
            stream = spark.readStream.schema(SCHEMA).parquet(folder)
            out = windows.run_once(windows.streaming_chunks(stream, "k", "ts", "id", ("x", "z"), "ok", 3.0, late="25 minutes", idle="2 hours"), base=base)
    got = {(r["k"], r["id"]): (r["chunk"], round(r["length"], 9), r["lx"], r["lz"]) for r in out.collect()}
    assert got == plain(rows, 3.0, at(400)) and out.count() == len(rows)
    with windows.rocksdb_state(spark):  # after two hours without a row the path begins anew
        spark.createDataFrame([("b", 1000, at(520), 7.0, 7.0, False), ("b", 1001, at(900), 0.0, 0.0, True)], SCHEMA).coalesce(1).write.mode("append").parquet(folder)
        out = windows.run_once(windows.streaming_chunks(spark.readStream.schema(SCHEMA).parquet(folder), "k", "ts", "id", ("x", "z"), "ok", 3.0, late="25 minutes", idle="2 hours"), base=base)
    last = out.where("id = 1000").first()
    assert (last["chunk"], last["length"], last["lx"]) == (0, 0.0, None)


def test_a_key_keeps_few_timers(spark, tmp_path):
    from pyspark.sql.streaming.listener import StreamingQueryListener

    class Seen(StreamingQueryListener):
        timers = 0

        def onQueryStarted(self, event): ...
        def onQueryTerminated(self, event): ...
        def onQueryIdle(self, event): ...
        def onQueryProgress(self, event):
            Seen.timers += sum(int(s.customMetrics.get("numRegisteredTimers", 0)) for s in event.progress.stateOperators)

    start = datetime.datetime(2024, 1, 1, tzinfo=datetime.timezone.utc)
    rows = [(k, i, start + datetime.timedelta(minutes=i), i * 0.5, float(i % 3), i % 4 != 0) for k in "abc" for i in range(60)]
    spark.createDataFrame(rows, SCHEMA).coalesce(1).write.parquet(f"{tmp_path}/in")
    listener = Seen()
    spark.streams.addListener(listener)
    try:
        with windows.rocksdb_state(spark):
            out = windows.run_once(windows.streaming_chunks(spark.readStream.schema(SCHEMA).parquet(f"{tmp_path}/in"), "k", "ts", "id", ("x", "z"), "ok", 3.0, late="10 minutes", idle="2 hours"), base=f"file://{tmp_path}/run")
            assert {(r["k"], r["id"]): (r["chunk"], round(r["length"], 9), r["lx"], r["lz"]) for r in out.collect()} == plain(rows, 3.0, start + datetime.timedelta(minutes=49))
        spark.sparkContext._jsc.sc().listenerBus().waitUntilEmpty()
    finally:
        spark.streams.removeListener(listener)
    assert 0 < Seen.timers <= 9  # not one for each of 180 rows
