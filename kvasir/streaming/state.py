"""Time-driven state: limiters, and windows over event time (batch and streaming)."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def _in_order(events: DataFrame, key: str, *order: str) -> DataFrame:
    """Rows by key and then in order, for a fold that holds one key's state and never a key's rows."""
    return events.where(F.col(key).isNotNull()).repartition(key).sortWithinPartitions(key, *order)


def fixed_window_limit(events: DataFrame, key: str, at: str, *, most: int = 30, seconds: float = 60) -> DataFrame:
    """``event_id, <key>, window_no, n, allowed``: a limiter whose window begins with the first event after the last one's end.

    The state of a key is its window's beginning and count, folded over its events in order of time, then id. Events
    without a key or time are no events.
    """
    span = pd.Timedelta(seconds=seconds)

    def fold(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        who, begin, number, n = None, None, 0, 0
        for p in parts:
            rows = []
            for k, t in zip(p[key], p[at]):
                if k != who:
                    who, begin, number = k, None, 0
                if begin is None or t - begin >= span:
                    begin, number, n = t, number + 1, 0
                n += 1
                rows.append((number, n, n <= most))
            out = p[["event_id", key]].reset_index(drop=True)
            out[["window_no", "n", "allowed"]] = pd.DataFrame(rows, columns=["window_no", "n", "allowed"])
            yield out

    types = dict(events.dtypes)
    schema = f"event_id {types['event_id']}, `{key}` {types[key]}, window_no bigint, n bigint, allowed boolean"
    return _in_order(events.select("event_id", key, at).where(F.col(at).isNotNull()), key, at, "event_id").mapInPandas(fold, schema)


def lockouts(failures: DataFrame, key: str, at: str, *, most: int = 10, minutes: int = 15) -> DataFrame:
    """``<key>, locked_at``: when ``most`` failures within ``minutes`` lock a key; its history is then cleared and failures while locked don't count."""
    span = pd.Timedelta(minutes=minutes)

    def fold(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        who, recent, until = None, [], None
        for p in parts:
            found = []
            for k, t in zip(p[key], p[at]):
                if k != who:
                    who, recent, until = k, [], None
                if until is not None and t < until:
                    continue
                recent = [x for x in recent if t - x < span] + [t]
                if len(recent) >= most:
                    found.append((k, t))
                    recent, until = [], t + span
            yield pd.DataFrame({key: pd.Series([k for k, _ in found], dtype=p[key].dtype), "locked_at": pd.Series([t for _, t in found], dtype=p[at].dtype)})

    types = dict(failures.dtypes)
    rows = failures.select(key, at).where(F.col(at).isNotNull())
    return _in_order(rows, key, at).mapInPandas(fold, f"`{key}` {types[key]}, locked_at {types[at]}")


def concurrency_limit(events: DataFrame, key: str, at: str, millis: str, *, most: int = 4) -> DataFrame:
    """``event_id, <key>, allowed``: whether fewer than ``most`` allowed events of the key are under way when one begins.

    An event is under way from its time for ``millis`` milliseconds. A key's state is the ends of what is under way, at
    most ``most`` of them, folded over its events in order of time, then id.
    """

    def fold(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        who, ends = None, []
        for p in parts:
            rows = []
            for k, t, ms in zip(p[key], p[at], p[millis]):
                if k != who:
                    who, ends = k, []
                ends = [e for e in ends if e > t]
                rows.append(len(ends) < most)
                if rows[-1]:
                    ends.append(t + pd.Timedelta(milliseconds=float(ms)))
            yield p[["event_id", key]].assign(allowed=rows)

    types = dict(events.dtypes)
    rows = events.select("event_id", key, at, millis).where(F.col(at).isNotNull() & F.col(millis).isNotNull())
    return _in_order(rows, key, at, "event_id").mapInPandas(fold, f"event_id {types['event_id']}, `{key}` {types[key]}, allowed boolean")


def tumbling(events: DataFrame, at: str, width: str, *keys: str) -> DataFrame:
    """``begin, <keys>, n, total``: events and their value in windows side by side."""
    w = F.window(at, width)
    return events.groupBy(w.alias("w"), *keys).agg(F.count(F.lit(1)).alias("n"), F.sum("value").alias("total")).select(F.col("w.start").alias("begin"), *keys, "n", "total")


def sliding(events: DataFrame, at: str, width: str, step: str) -> DataFrame:
    """``begin, n``: events in overlapping windows."""
    return events.groupBy(F.window(at, width, step).alias("w")).agg(F.count(F.lit(1)).alias("n")).select(F.col("w.start").alias("begin"), "n")


def sessions(events: DataFrame, key: str, at: str, gap_seconds: int) -> DataFrame:
    """``<key>, begin, n``: runs of a key's events without a pause of ``gap_seconds``."""
    w = Window.partitionBy(key).orderBy(at, "event_id")
    first = F.when(F.timestamp_diff("SECOND", F.lag(at).over(w), F.col(at)) >= gap_seconds, 1).otherwise(0)
    rows = events.withColumn("_first", first).withColumn("_run", F.sum("_first").over(w))
    return rows.groupBy(key, "_run").agg(F.min(at).alias("begin"), F.count(F.lit(1)).alias("n")).drop("_run")


def stream_counts(stream: DataFrame, at: str, width: str, late: str) -> DataFrame:
    """A streaming count of distinct events by window and type; events later than ``late`` are dropped."""
    once = stream.withWatermark(at, late).dropDuplicatesWithinWatermark(["event_id"])
    return once.groupBy(F.window(at, width).alias("w"), "event_type").agg(F.count(F.lit(1)).alias("n")).select(F.col("w.start").alias("begin"), "event_type", "n")


def stream_fixed_limit(stream: DataFrame, key: str, at: str, *, most: int = 30, seconds: float = 60, idle_minutes: int = 60) -> DataFrame:
    """A stream of ``event_id, <key>, window_no, n, allowed``: :func:`fixed_window_limit` over a stream with a watermark on ``at``.

    A key's state is its window's beginning, number and count; it is dropped after ``idle_minutes`` of event time without
    an event, so the state holds only keys that are in use. Events of one batch are taken in order of time, then id.
    """
    span = pd.Timedelta(seconds=seconds)
    types = dict(stream.dtypes)

    def fold(who: tuple, parts: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        begin_us, number, n = state.get if state.exists else (None, 0, 0)
        begin = None if begin_us is None else pd.Timestamp(begin_us, unit="us")
        batch = pd.concat(list(parts)).sort_values([at, "event_id"], kind="stable")
        rows = []
        for event, t in zip(batch["event_id"], batch[at]):
            if begin is None or t - begin >= span:
                begin, number, n = t, number + 1, 0
            n += 1
            rows.append((event, who[0], number, n, n <= most))
        state.update((begin.value // 1000, number, n))
        state.setTimeoutTimestamp(max(state.getCurrentWatermarkMs(), int(batch[at].max().timestamp() * 1000)) + idle_minutes * 60_000)
        yield pd.DataFrame(rows, columns=["event_id", key, "window_no", "n", "allowed"])

    rows = stream.where(F.col(key).isNotNull() & F.col(at).isNotNull()).select("event_id", key, at)
    schema = f"event_id {types['event_id']}, `{key}` {types[key]}, window_no bigint, n bigint, allowed boolean"
    return rows.groupBy(key).applyInPandasWithState(fold, schema, "begin long, number long, n long", "append", "EventTimeTimeout")


def stream_sessions(stream: DataFrame, key: str, at: str, gap: str, late: str) -> DataFrame:
    """A stream of ``<key>, begin, end, n``: runs of a key's events without a pause of ``gap``, given out when the watermark has passed them."""
    runs = stream.withWatermark(at, late).groupBy(key, F.session_window(at, gap).alias("w")).agg(F.count(F.lit(1)).alias("n"))
    return runs.select(key, F.col("w.start").alias("begin"), F.col("w.end").alias("end"), "n")


def stream_upsert(stream: DataFrame, keys: list[str], order: str, path: str, checkpoint: str):
    """A query that keeps the last row of each key in a Parquet folder partitioned by ``bucket``: only the buckets that a batch has keys of are written again.

    A batch that is run a second time after a failure gives the same rows.
    """

    def put(batch: DataFrame, _: int) -> None:
        spark = batch.sparkSession
        w = Window.partitionBy(*keys).orderBy(F.desc(order))
        fresh = batch.withColumn("bucket", F.pmod(F.xxhash64(*keys), F.lit(64)).cast("int"))
        hit = [r.bucket for r in fresh.select("bucket").distinct().collect()]  # at most 64
        if not hit:
            return
        try:
            stored = spark.read.parquet(path).where(F.col("bucket").isin(hit))
            both = stored.select(fresh.columns).unionByName(fresh)
        except AnalysisException:  # the first batch
            both = fresh
        last = both.withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_n").checkpoint()
        last.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("bucket").parquet(path)

    return stream.writeStream.outputMode("append").option("checkpointLocation", checkpoint).foreachBatch(put)
