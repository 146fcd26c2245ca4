"""Stateful rules over event streams, each also in a batch form with the same rows.

Streams are read with an explicit schema and run to the end of the available input; state that only needs the latest
window is kept by watermarks, and rules whose windows open at their first event use a keyed state processor.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.types import IntegerType, LongType, StructField, StructType

EVENTS = "event_id long, ts timestamp_ntz, user_id long, event_type string, value double, props string"


def read_stream(spark: SparkSession, folder: str, name: str = "events.parquet", schema: str = EVENTS) -> DataFrame:
    """A file stream of the table ``name`` (one file or a folder) below ``folder``, with ts as a timestamp."""
    rows = spark.readStream.schema(schema).option("pathGlobFilter", "*.parquet").option("recursiveFileLookup", "true").parquet(f"{folder}/{name}*")
    return rows.withColumn("ts", F.col("ts").cast("timestamp"))


def run_to_end(stream: DataFrame, out: str, checkpoint: str, mode: str = "append") -> DataFrame:
    """Processes what is there, writes it as Parquet below ``out``, and reads it back. A second run with the same
    checkpoint resumes where the first ended."""
    spark = stream.sparkSession
    query = stream.writeStream.format("parquet").outputMode(mode).option("path", out).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()
    return spark.read.schema(stream.schema).parquet(out)


def run_complete(stream: DataFrame, out: str, checkpoint: str) -> DataFrame:
    """Processes what is there in complete mode: every batch replaces the result, so windows that are still open when
    input ends are in it. State is one row for each group of the aggregation."""
    spark = stream.sparkSession
    stream.writeStream.foreachBatch(lambda rows, _: rows.write.mode("overwrite").parquet(out)).outputMode("complete").option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()
    return spark.read.schema(stream.schema).parquet(out)


def daily_budget(events: DataFrame, cap: int, keys: tuple[str, ...] = ()) -> DataFrame:
    """day, n, spent, exhausted by UTC day (and keys)."""
    day = F.to_date("ts").alias("day")
    return events.groupBy(day, *keys).agg(F.count("*").alias("n")).withColumns({"spent": F.least("n", F.lit(cap)), "exhausted": F.col("n") >= cap})


def streaming_daily_counts(stream: DataFrame, delay: str = "1 day") -> DataFrame:
    """Counts by UTC day and type. In append mode (run_to_end) a day appears once the watermark has passed it; run_complete
    also gives the days that are still open."""
    w = F.window("ts", "1 day")
    return stream.withWatermark("ts", delay).groupBy(w, "event_type").agg(F.count("*").alias("n")).select(F.to_date("window.start").alias("day"), "event_type", "n")


def dedup_key(event_type: str = "event_type", who: str = "user_id"):
    return F.sha2(F.concat_ws("|", event_type, F.col(who).cast("string"), F.date_format("ts", "yyyy-MM-dd HH")), 256)


def streaming_dedup(stream: DataFrame, delay: str = "2 hours") -> DataFrame:
    """The first event of each key within the watermark; later ones are ignored."""
    return stream.withColumn("event_key", dedup_key()).withWatermark("ts", delay).dropDuplicatesWithinWatermark(["event_key"])


def usable(status, retry_after, fetched, now: int, ttl: int):
    """ok, empty and permanent entries always, within the time to live; retryable ones until retry_after."""
    fresh = (F.lit(now) - fetched) < ttl
    return F.when(status.isin("ok", "empty", "permanent"), fresh).when(status == "retryable", F.lit(now) < retry_after).otherwise(F.lit(False))


def unknown_runs(events: DataFrame) -> DataFrame:
    """Consecutive unknown results so far: +1 on unknown, 0 on anything else."""
    w = Window.partitionBy("user_id").orderBy("ts", "event_id")
    known = F.sum((F.col("event_type") != "error").cast("int")).over(w.rowsBetween(Window.unboundedPreceding, 0))
    rows = events.select("event_id", "user_id", "ts", "event_type").withColumn("island", known)
    island = Window.partitionBy("user_id", "island").orderBy("ts", "event_id").rowsBetween(Window.unboundedPreceding, 0)
    return rows.select("event_id", F.sum((F.col("event_type") == "error").cast("int")).over(island).alias("unknowns"))


def heartbeat(age, enabled, started, idle: int):
    return F.when(~started, "not_started").when(~enabled, "paused").when(age <= 3 * idle, "running").otherwise("stale")


LIMITED = StructType([StructField("event_id", LongType()), StructField("attempt", IntegerType()), StructField("allowed", IntegerType())])


def fold_window(times: list[float], start: float | None, count: int, window: float):
    """Attempts of fixed windows that open at their first event."""
    out = []
    for t in times:
        if start is None or t - start >= window:
            start, count = t, 0
        count += 1
        out.append(count)
    return out, start, count


def rate_limit(events: DataFrame, limit: int, window: int) -> DataFrame:
    """event_id, attempt, allowed: a window opens at a user's first attempt and at the first one after it ended.

    Users are dealt to partitions and read in order as a stream of batches that carries one open window over, so no
    user's events are gathered in memory. For streams use RateLimiter, whose state is two numbers a user.
    """

    def step(batches):
        user, start, count = object(), None, 0
        for pdf in batches:
            seconds = (pdf["ts"].astype("datetime64[us]").astype("int64") / 1e6).tolist()
            attempts = []
            for u, t in zip(pdf["user_id"].tolist(), seconds, strict=True):
                if u != user:
                    user, start = u, None
                if start is None or t - start >= window:
                    start, count = t, 0
                count += 1
                attempts.append(count)
            yield pd.DataFrame({"event_id": pdf["event_id"], "attempt": attempts, "allowed": [int(a <= limit) for a in attempts]})

    rows = events.select("user_id", "event_id", F.col("ts").cast("timestamp").alias("ts"))
    return rows.repartition("user_id").sortWithinPartitions("user_id", "ts", "event_id").mapInPandas(step, LIMITED)


class RateLimiter(StatefulProcessor):
    """transformWithState form of rate_limit: the start and the count of the open window of each user."""

    def __init__(self, limit: int, window: int):
        self.limit, self.window = limit, window

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.state = handle.getValueState("window", "start double, count int")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        pdf = pd.concat(list(rows)).sort_values(["ts", "event_id"])
        start, count = self.state.get() if self.state.exists() else (None, 0)
        seconds = (pdf["ts"].astype("datetime64[us]").astype("int64") / 1e6).tolist()
        attempts, start, count = fold_window(seconds, start, count, self.window)
        self.state.update((start, count))
        yield pd.DataFrame({"event_id": pdf["event_id"], "attempt": attempts, "allowed": [int(a <= self.limit) for a in attempts]})

    def close(self) -> None:
        pass


def streaming_rate_limit(stream: DataFrame, limit: int, window: int) -> DataFrame:
    """Needs the RocksDB state store provider (spark.sql.streaming.stateStore.providerClass)."""
    return stream.select("user_id", "event_id", "ts").groupBy("user_id").transformWithStateInPandas(RateLimiter(limit, window), LIMITED, "append", "none")
