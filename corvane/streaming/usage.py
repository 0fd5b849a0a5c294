"""The stateful operators as Structured Streaming queries."""

from __future__ import annotations

import heapq
from collections.abc import Iterator
from typing import Any

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from corvane.operators.windows import bucket_step
from corvane.session import scratch_path

EVENTS = "event_id bigint, ts timestamp_ntz, user_id bigint, event_type string, value double, props string"


def read_events(spark: SparkSession, folder: str, pattern: str = "events*.parquet") -> DataFrame:
    """The event files of a folder as a stream; their times are UTC."""
    rows = spark.readStream.schema(EVENTS).option("pathGlobFilter", pattern).parquet(folder)
    return rows.withColumn("ts", F.col("ts").cast("timestamp"))


def windowed_usage(events: DataFrame, length: str = "1 hour", slide: str | None = None, late: str = "2 hours") -> DataFrame:
    """Calls and tokens of each model in tumbling or sliding event-time windows; later rows are dropped."""
    window = F.window("ts", length, slide) if slide else F.window("ts", length)
    usage = events.withWatermark("ts", late).groupBy(window.alias("w"), F.col("event_type").alias("model"))
    out = usage.agg(F.count("*").alias("calls"), F.sum(F.floor("value")).alias("tokens"))
    return out.select(F.col("w.start").alias("start"), F.col("w.end").alias("end"), "model", "calls", "tokens")


def session_usage(events: DataFrame, gap: str = "6 hours", late: str = "2 hours") -> DataFrame:
    """Sessions of each user, closed by a pause."""
    by = events.withWatermark("ts", late).groupBy(F.session_window("ts", gap).alias("w"), "user_id")
    return by.agg(F.count("*").alias("n")).select("user_id", F.col("w.start").alias("start"), F.col("w.end").alias("end"), "n")


def alerts(usage: DataFrame, threshold: int) -> DataFrame:
    """The windows whose tokens pass a threshold; none if it is switched off with 0 or less."""
    return usage.where(F.lit(threshold > 0) & (F.col("tokens") > threshold))


def distinct_requests(events: DataFrame, late: str = "2 hours") -> DataFrame:
    """Events, each once within the watermark."""
    return events.withWatermark("ts", late).dropDuplicatesWithinWatermark(["event_id"])


#: Requests of a key that are put in order at once; older ones are then decided.
IN_ORDER = 10_000


def token_bucket(events: DataFrame, capacity: float, per_minute: float, in_order: int = IN_ORDER) -> DataFrame:
    """Each request with ``allowed``, by a token bucket kept as state for each user.

    The requests of a trigger are decided in the order of their times as long as they come no more than ``in_order``
    requests late: a heap of that many is all that is held of a user, whatever the trigger brings.
    """
    rate = per_minute / 60.0

    def step(key: tuple[Any, ...], batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        level, last = state.get if state.exists else (capacity, None)
        waiting: list[tuple[float, int, float]] = []

        def decide(most: int) -> pd.DataFrame:
            nonlocal level, last
            ids, allowed = [], []
            while len(waiting) > most:
                at, number, need = heapq.heappop(waiting)
                ok, level, _ = bucket_step(level, at if last is None else last, at, need, capacity, rate)
                last = at if last is None else max(last, at)
                ids.append(number)
                allowed.append(ok)
            return pd.DataFrame({"event_id": ids, "user_id": key[0], "allowed": allowed}).astype({"event_id": "int64", "allowed": "bool"})

        for rows in batches:
            for row in zip(rows["ts"].map(pd.Timestamp.timestamp), rows["event_id"], rows["need"]):
                heapq.heappush(waiting, row)
            if len(waiting) > in_order:
                yield decide(in_order)
        out = decide(0)
        state.update((level, last))
        yield out

    rows = events.select("event_id", "ts", "user_id", F.floor("value").cast("double").alias("need"))
    return rows.groupBy("user_id").applyInPandasWithState(
        step, "event_id bigint, user_id bigint, allowed boolean", "level double, last double", "append", GroupStateTimeout.NoTimeout
    )


def run_to_table(stream: DataFrame, mode: str, label: str) -> DataFrame:
    """Run a streaming query over all that is there now and read its result back.

    Each batch is written whole to a folder of its own, so a repeated batch
    replaces itself.  In complete mode the last batch is the result.
    """
    spark = stream.sparkSession
    path = scratch_path(spark, label)
    last: list[int] = []

    def keep(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path}/batch={number}")
        last.append(number)

    query = stream.writeStream.outputMode(mode).option("checkpointLocation", f"{path}-state").foreachBatch(keep).trigger(availableNow=True).start()
    query.awaitTermination()
    if not last:
        return spark.createDataFrame([], stream.schema)
    chosen = f"{path}/batch={last[-1]}" if mode == "complete" else path
    return spark.read.parquet(chosen).select(*stream.columns)
