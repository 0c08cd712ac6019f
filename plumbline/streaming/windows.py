"""Streaming forms: event-time windows and key frames that keep the last kept row as state."""

from __future__ import annotations

import bisect
import math
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout
from pyspark.sql.types import IntegerType, StructField, StructType

from ..operators.grids import shared_dir


def stream_of(spark: SparkSession, path: str) -> DataFrame:
    """A Parquet table as a file stream; event times without a zone become UTC timestamps, as watermarks ask."""
    schema = spark.read.parquet(path).schema
    rows = spark.readStream.schema(schema).parquet(f"{path[:-1]}[{path[-1]}]")  # a pattern, as a plain path must be a folder
    return rows.withColumns({f.name: F.col(f.name).cast("timestamp") for f in schema if f.dataType.typeName() == "timestamp_ntz"})


def event_windows(rows: DataFrame, time: str, width: str, slide: str | None, late: str, keys: tuple[str, ...], value: str) -> DataFrame:
    """Count and sum by tumbling or sliding windows; rows later than `late` are dropped and their windows' state with them."""
    w = F.window(time, width, slide) if slide else F.window(time, width)
    return rows.withWatermark(time, late).groupBy(w, *keys).agg(F.count(F.lit(1)).alias("n"), F.sum(value).alias("total"))


def sessions(rows: DataFrame, time: str, gap: str, late: str, keys: tuple[str, ...]) -> DataFrame:
    return rows.withWatermark(time, late).groupBy(F.session_window(time, gap), *keys).agg(F.count(F.lit(1)).alias("n"))


def streaming_keyframes(rows: DataFrame, key: str, order: str, ident: str, coords: tuple[str, str], heading: str, min_trans: float, min_rot: float, idle: str = "7 days") -> DataFrame:
    """(key, ident) of rows that moved or turned enough from the last kept row of their key, which is the state. A key without rows for `idle` of event time loses its state and starts anew."""
    bound = math.cos(math.radians(min_rot))
    wait = int(pd.Timedelta(idle).total_seconds() * 1000)

    def keep(group: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        kept = []
        if state.hasTimedOut:
            state.remove()
        else:
            last = state.get if state.exists else None
            whole = pd.concat(list(batches)).sort_values([order, ident])
            for r in whole[[ident, *coords, heading]].itertuples(index=False, name=None):
                if last is None or math.dist(last[:2], r[1:3]) > min_trans or math.cos(r[3] - last[2]) < bound:
                    last = tuple(map(float, r[1:4]))
                    kept.append(r[0])
            if last is not None:
                state.update(last)
                seen = int(whole[order].max().timestamp() * 1000)
                state.setTimeoutTimestamp(max(seen, state.getCurrentWatermarkMs()) + wait)
        yield pd.DataFrame({key: [group[0]] * len(kept), ident: kept})

    types = dict(rows.dtypes)
    late = rows.withWatermark(order, idle)
    return late.groupBy(key).applyInPandasWithState(keep, f"{key} {types[key]}, {ident} {types[ident]}", "x double, z double, turn double", "append", GroupStateTimeout.EventTimeTimeout)


@contextmanager
def rocksdb_state(spark: SparkSession) -> Iterator[None]:
    """For streams started inside, state in RocksDB, which typed state and timers ask for; the session's own setting comes back."""
    name = "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(name)
    spark.conf.set(name, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    try:
        yield
    finally:
        spark.conf.set(name, before)


def run_once(result: DataFrame, mode: str = "append", keys: list[str] | None = None, base: str | None = None) -> DataFrame:
    """Everything at hand run through a stream, batch by batch, into Parquet in the shared folder, or under `base`, where a later call goes on from what this one left.

    In update mode only changed groups are written, and each group of `keys` is read as its last batch
    left it, so state behind the watermark goes; in complete mode (sessions) the last batch stays.
    """
    spark = result.sparkSession
    base = base or f"{shared_dir(spark)}/stream-{uuid.uuid4().hex}"

    def put(batch: DataFrame, number: int) -> None:
        batch.withColumn("_batch", F.lit(number)).write.mode("overwrite" if mode == "complete" else "append").parquet(f"{base}/out")

    query = result.writeStream.outputMode(mode).option("checkpointLocation", f"{base}/state").trigger(availableNow=True).foreachBatch(put).start()
    query.awaitTermination()
    out = spark.read.schema(StructType([*result.schema, StructField("_batch", IntegerType())])).parquet(f"{base}/out")
    if mode != "update":
        return out.drop("_batch")
    others = [c for c in result.columns if c not in keys]
    return out.groupBy(*keys).agg(F.max_by(F.struct(*others), "_batch").alias("_m")).select(*keys, "_m.*")


def streaming_chunks(rows: DataFrame, key: str, order: str, ident: str, coords: tuple[str, str], trusted: str, reach: float, late: str = "10 minutes", idle: str = "1 day") -> DataFrame:
    """(key, ident, chunk, length, lx, lz) of each row once the watermark has passed it: its chunk of walked path, and the last trusted position up to it.

    Rows of a key are taken in event-time order, whatever order they come in: a row waits in a list
    state until the watermark passes it, when a timer of its key, set at the first row that waits, lets
    go all that have been passed. A value state holds the key's walked length, last position and last trusted position, so a row whose `trusted` is false
    has the position of the last good one (null before the first). A new chunk begins each `reach` of
    length. State is removed after `idle` of event time without a row. Rows later than `late` are
    dropped, as in all windows here.
    """
    from pyspark.sql.streaming.stateful_processor import StatefulProcessor

    types = dict(rows.dtypes)
    wait = int(pd.Timedelta(idle).total_seconds() * 1000)

    class Chunks(StatefulProcessor):
        def init(self, handle) -> None:
            self.handle = handle
            self.path = handle.getValueState("path", "length double, x double, z double, lx double, lz double, idle long, wake long")
            self.held = handle.getListState("held", f"at long, ident {types[ident]}, x double, z double, ok boolean")

        def _released(self, name, rows_held: list[tuple], upto: int) -> pd.DataFrame:
            """Rows that the watermark has passed, in order; the others wait on, with a timer at the first of them."""
            rows_held.sort()
            n = bisect.bisect_right(rows_held, upto, key=lambda r: r[0])
            length, x, z, lx, lz, idle_at, wake = self.path.get()
            out = []
            for _, row, px, pz, ok in rows_held[:n]:
                length += 0.0 if x is None else math.hypot(px - x, pz - z)
                x, z = px, pz
                lx, lz = (px, pz) if ok else (lx, lz)
                out.append((name, row, int(length // reach), length, lx, lz))
            later = rows_held[n:]
            if later:
                self.held.put(later)
            elif self.held.exists():
                self.held.clear()
            first = later[0][0] if later else 0
            if first != wake:
                if wake > upto:
                    self.handle.deleteTimer(wake)
                if first and first != idle_at:
                    self.handle.registerTimer(first)
            self.path.update((length, x, z, lx, lz, idle_at, first if first != idle_at else 0))
            return pd.DataFrame(out, columns=[key, ident, "chunk", "length", "lx", "lz"])

        def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
            new = pd.concat(list(rows))
            at = (new[order].dt.as_unit("ms").astype("int64")).tolist()
            waiting = [tuple(r) for r in self.held.get()] if self.held.exists() else []
            waiting += zip(at, new[ident].tolist(), new[coords[0]].astype(float).tolist(), new[coords[1]].astype(float).tolist(), [x is not None and bool(x) for x in new[trusted].tolist()], strict=True)
            *path, idle_at, wake = self.path.get() if self.path.exists() else (0.0, None, None, None, None, 0, 0)
            if max(at) + wait > idle_at:  # the state outlives its last row by `idle`
                if idle_at:
                    self.handle.deleteTimer(idle_at)
                idle_at = max(at) + wait
                self.handle.registerTimer(idle_at)
                self.path.update((*path, idle_at, wake))
            yield self._released(key[0], waiting, timerValues.getCurrentWatermarkInMs())

        def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
            if self.path.exists():
                if self.held.exists():
                    yield self._released(key[0], [tuple(r) for r in self.held.get()], timerValues.getCurrentWatermarkInMs())
                if expiredTimerInfo.getExpiryTimeInMs() >= self.path.get()[-2]:
                    self.path.clear()

        def close(self) -> None:
            pass

    form = f"{key} {types[key]}, {ident} {types[ident]}, chunk long, length double, lx double, lz double"
    late_rows = rows.withWatermark(order, late)
    return late_rows.groupBy(key).transformWithStateInPandas(statefulProcessor=Chunks(), outputStructType=form, outputMode="Append", timeMode="EventTime")
