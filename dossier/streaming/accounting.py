"""Limits of requests over streams. Each gives what its batch twin gives, for events that come in order per caller."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout
from pyspark.sql.types import StructType

from dossier.operators.accounting import PER_HOUR, PER_MINUTE, QUOTA

#: Buckets are forgotten after a day without requests of their caller.
KEEP_MS = 24 * 3600 * 1000
OUT = "caller string, event_id long, ts timestamp_ntz, minute_count long, hour_count long, allowed boolean"


def events_of(spark: SparkSession, path: str, schema: StructType) -> DataFrame:
    return spark.readStream.schema(schema).parquet(path)


def run_available(stream: DataFrame, name: str) -> DataFrame:
    """Run a stream over all that is there now, and return what it wrote. Output and progress are in the folder that the
    cluster names in spark.checkpoint.dir. Where none is named, a local session (tests) takes a folder of its own, and any
    other is refused."""
    spark = stream.sparkSession
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder and not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    folder = folder or tempfile.mkdtemp(prefix="spark-stream-")
    where = f"{folder.rstrip('/')}/{name}-{uuid.uuid4().hex}"
    run = stream.writeStream.format("parquet").option("path", f"{where}/out").option("checkpointLocation", f"{where}/progress").trigger(availableNow=True).start()
    run.awaitTermination()
    return spark.read.schema(stream.schema).parquet(f"{where}/out")


def rate_limited(events: DataFrame, per_minute: int = PER_MINUTE, per_hour: int = PER_HOUR, expire: bool = True) -> DataFrame:
    """events: caller string, event_id, ts. Counts of a caller's current minute and hour, every attempt included; state
    is keyed by caller and forgotten a day after the last request. Expiry by the clock keeps a stream running, so a run
    over what is there now goes without it."""

    def count(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        minute, n_minute, hour, n_hour = state.get if state.exists else (-1, 0, -1, 0)
        rows, out = pd.concat(list(batches)).sort_values(["ts", "event_id"]), []
        for event_id, ts in rows[["event_id", "ts"]].itertuples(index=False):
            m, h = ts.value // 60_000_000_000, ts.value // 3_600_000_000_000
            n_minute, n_hour = (n_minute + 1 if m == minute else 1), (n_hour + 1 if h == hour else 1)
            minute, hour = m, h
            out.append((key[0], event_id, ts, n_minute, n_hour, n_minute <= per_minute and n_hour <= per_hour))
        state.update((minute, n_minute, hour, n_hour))
        if expire:
            state.setTimeoutDuration(KEEP_MS)
        yield pd.DataFrame(out, columns=["caller", "event_id", "ts", "minute_count", "hour_count", "allowed"])

    kept = "minute long, n_minute long, hour long, n_hour long"
    return events.groupBy("caller").applyInPandasWithState(count, OUT, kept, "append", GroupStateTimeout.ProcessingTimeTimeout if expire else GroupStateTimeout.NoTimeout)


def windowed_counts(events: DataFrame, *, caller: str = "caller", ts: str = "ts", late: str = "24 hours") -> DataFrame:
    """Requests of each caller by minute; a window closes once the watermark has passed it."""
    timed = events.withColumn("ts", F.col(ts).cast("timestamp")).withWatermark("ts", late)
    counts = timed.groupBy(F.window("ts", "1 minute"), caller).agg(F.count(F.lit(1)).alias("request_count"))
    return counts.select(caller, F.col("window.start").cast("timestamp_ntz").alias("bucket_start"), "request_count")


def within_quota(events: DataFrame, quota: int = QUOTA) -> DataFrame:
    """events: visitor string, event_id, ts, consumes. Questions that a visitor has used up, for life, without refunded
    ones. The outcome comes with its request; there is no late refund."""

    def count(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        used, out = (state.get[0] if state.exists else 0), []
        for event_id, consumes in pd.concat(list(batches)).sort_values(["ts", "event_id"])[["event_id", "consumes"]].itertuples(index=False):
            out.append((key[0], event_id, used, used < quota))
            used += int(bool(consumes) and used < quota)
        state.update((used,))
        yield pd.DataFrame(out, columns=["visitor", "event_id", "used", "reserved"])

    shape = "visitor string, event_id long, used long, reserved boolean"
    return events.groupBy("visitor").applyInPandasWithState(count, shape, "used long", "append", GroupStateTimeout.NoTimeout)
