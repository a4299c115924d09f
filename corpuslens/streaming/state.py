"""Streams: windows with late data, deduplication, idempotent append, and stateful quotas and circuit breakers.

The stateful functions are pure folds over the ordered events of a key; batch() and the streaming operators share them.
Event streams have event_id, a TIMESTAMP column ts (cast TIMESTAMP_NTZ before: watermarks need it) and a key.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout


def with_event_time(df: DataFrame, column: str = "ts") -> DataFrame:
    return df.withColumn(column, F.col(column).cast("timestamp"))


def windowed_counts(df: DataFrame, length: str, late: str = "10 minutes", slide: str | None = None, key: str = "event_type") -> DataFrame:
    """Events and sums per window and key; what is later than the watermark is dropped by streams."""
    w = F.window("ts", length, slide) if slide else F.window("ts", length)
    x = df.withWatermark("ts", late).groupBy(w, key).agg(F.count("*").alias("events"), F.sum("value").alias("total"))
    return x.select(F.col("window.start").alias("start"), F.col("window.end").alias("end"), key, "events", "total")


def session_counts(df: DataFrame, gap: str, late: str = "10 minutes", key: str = "user_id") -> DataFrame:
    x = df.withWatermark("ts", late).groupBy(F.session_window("ts", gap), key).agg(F.count("*").alias("events"))
    return x.select(F.col("session_window.start").alias("start"), F.col("session_window.end").alias("end"), key, "events")


def deduplicated(df: DataFrame, keys: list[str], late: str = "10 minutes") -> DataFrame:
    """Each key once within the watermark."""
    return df.withWatermark("ts", late).dropDuplicatesWithinWatermark(keys)


def joined(left: DataFrame, right: DataFrame, key: str, within: str, late: str = "10 minutes") -> DataFrame:
    """Pairs of a left event and a right event of the same key at most so much later."""
    a, b = left.withWatermark("ts", late).alias("a"), right.withWatermark("ts", late).alias("b")
    near = (F.col("b.ts") >= F.col("a.ts")) & (F.col("b.ts") <= F.col("a.ts") + F.expr(f"INTERVAL {within}"))
    return a.join(b, (F.col(f"a.{key}") == F.col(f"b.{key}")) & near).select(F.col(f"a.{key}").alias(key), F.col("a.event_id").alias("left_id"), F.col("b.event_id").alias("right_id"))


# ---- folds ----


def admit(times: list[int], held: list[int], limit: int, window: int) -> tuple[list[bool], list[int]]:
    """Sliding quota: an event is admitted if fewer than limit admitted ones lie in the window before it. held: admitted times."""
    out = []
    for t in times:
        held = [h for h in held if h > t - window]
        out.append(len(held) < limit)
        if out[-1]:
            held.append(t)
    return out, held


def breaker(events: list[tuple[int, bool]], state: tuple[str, int, int, int], threshold: int, window: int, open_for: int) -> tuple[list[str], tuple[str, int, int, int]]:
    """Circuit breaker over (time, failed). State: name, failures, start of the failure window, time until it is open.

    Failures count from the first of a window; threshold of them open the circuit; after open_for it is half open, where a
    success closes and a failure opens it again.
    """
    name, n, since, until = state
    out = []
    for t, failed in events:
        if name == "OPEN" and t >= until:
            name = "HALF_OPEN"
        if name == "HALF_OPEN":
            name, n, since, until = ("OPEN", n, t, t + open_for) if failed else ("CLOSED", 0, t, 0)
        elif name == "CLOSED":
            if failed:
                n, since = (1, t) if n == 0 or t - since > window else (n + 1, since)
                if n >= threshold:
                    name, until = "OPEN", t + open_for
            else:
                n = 0
        out.append(name)
    return out, (name, n, since, until)


def _micros(ts: pd.Series) -> list[int]:
    return (pd.to_datetime(ts).astype("int64") // 1000).tolist()


def quota_fold(limit: int, seconds: int):
    def fold(frame: pd.DataFrame, state: tuple | None):
        verdict, held = admit(_micros(frame["ts"]), list(state[0]) if state else [], limit, seconds * 1_000_000)
        return frame.assign(admitted=verdict), (held,)

    return fold, "admitted boolean", "held array<long>"


def breaker_fold(threshold: int, window: int, open_for: int, failed: str = "failed"):
    def fold(frame: pd.DataFrame, state: tuple | None):
        states, new = breaker(list(zip(_micros(frame["ts"]), frame[failed])), tuple(state) if state else ("CLOSED", 0, 0, 0), threshold, window * 1_000_000, open_for * 1_000_000)
        return frame.assign(circuit=states), new

    return fold, "circuit string", "name string, n long, since long, until long"


def _schema(df: DataFrame, added: str) -> str:
    return ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in df.schema) + f", {added}"


def batch(df: DataFrame, key: str, folded: tuple[Callable, str, str]) -> DataFrame:
    """The fold over all events of each key, in order of ts and event_id. A key's events pass through one task, as the fold is sequential, but in
    Arrow batches with the state carried on: they are never held at once."""
    fold, added, _ = folded

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        now, state = [], None
        for frame in frames:
            values = frame[key]
            starts = (values != values.shift()) & ~(values.isna() & values.shift().isna())
            for _, part in frame.groupby(starts.cumsum(), sort=False):
                value = part[key].iloc[0]
                same = bool(now) and (value == now[0] or (pd.isna(value) and pd.isna(now[0])))
                out, state = fold(part, state if same else None)
                now = [value]
                yield out

    return df.repartition(key).sortWithinPartitions(key, "ts", "event_id").mapInPandas(run, _schema(df, added))


def stream(df: DataFrame, key: str, folded: tuple[Callable, str, str], idle: str | None = None) -> DataFrame:
    """The fold with its state kept per key. Events of one trigger are taken in order; later triggers must not be earlier in time.
    idle (as '30 minutes' of event time; needs a watermark): state of idle keys is dropped."""
    fold, added, kept = folded
    ms = int(pd.Timedelta(idle).total_seconds() * 1000) if idle else 0

    def run(_, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        events = pd.concat(list(frames)).sort_values(["ts", "event_id"])
        out, new = fold(events, state.get if state.exists else None)
        state.update(new)
        if ms:
            state.setTimeoutTimestamp(max(int(events["ts"].max().timestamp() * 1000), state.getCurrentWatermarkMs()) + ms)
        yield out

    timeout = GroupStateTimeout.EventTimeTimeout if idle else GroupStateTimeout.NoTimeout
    return df.groupBy(key).applyInPandasWithState(run, _schema(df, added), kept, "append", timeout)


def append_stream(df: DataFrame, path: str, checkpoint: str, key: list[str], ignore: list[str]):
    """A stream into a Parquet table, each key once; a known key with other content fails the batch. Single writer."""
    from corpuslens.operators.records import append_once

    def write(rows: DataFrame, _: int) -> None:
        spark = rows.sparkSession
        hadoop = spark._jvm.org.apache.hadoop.fs.Path(path)
        store = spark.read.parquet(path) if hadoop.getFileSystem(spark._jsc.hadoopConfiguration()).exists(hadoop) else rows.limit(0)
        fresh, clash = append_once(store, rows, key, ignore)
        if clash.limit(1).count():
            raise ValueError("a known key has other content")
        fresh.write.mode("append").parquet(path)

    return df.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint)


def run_once(df: DataFrame, checkpoint: str, name: str, mode: str = "append") -> DataFrame:
    """All that is there of a stream into a memory table, for tests and backfills of small results."""
    df.writeStream.format("memory").queryName(name).outputMode(mode).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()
    return df.sparkSession.table(name)
