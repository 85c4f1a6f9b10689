"""Live sessions as Structured Streaming: windows with a watermark, and a state per session.

Late rows are kept while they are within the watermark and dropped after it; a batch run over the
same files has no such limit.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

#: Minutes without a call after which a session is idle, and the calls that patterns look back on.
IDLE_MINUTES, LAST_CALLS = 15, 20

STATE = "calls long, errors long, last_us long, tools string"
STATUS = "user_id long, calls long, errors long, retries long, last_us long, state string"


def event_stream(spark: SparkSession, folder: str, files_per_trigger: int | None = None) -> DataFrame:
    """The event table as a stream of the Parquet files that arrive in a folder."""
    schema = "event_id long, ts timestamp_ntz, user_id long, event_type string, value double, props string"
    reader = spark.readStream.schema(schema)
    if files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", files_per_trigger)
    return reader.parquet(folder).withColumn("ts", F.col("ts").cast("timestamp"))


def windowed(events: DataFrame, width: str = "1 day", slide: str | None = None, late: str = "2 days") -> DataFrame:
    """Calls and spend by window and type; tumbling, or sliding where slide is given."""
    w = F.window("ts", width, slide) if slide else F.window("ts", width)
    rows = events.withWatermark("ts", late).groupBy(w.alias("w"), "event_type").agg(F.count(F.lit(1)).alias("calls"), F.sum("value").alias("spend"))
    return rows.select(F.col("w.start").alias("began"), "event_type", "calls", "spend")


def visits(events: DataFrame, gap: str = f"{IDLE_MINUTES} minutes", late: str = "1 hour") -> DataFrame:
    """Visits of a session, which end after a gap without a call."""
    rows = events.withWatermark("ts", late).groupBy(F.session_window("ts", gap).alias("w"), "user_id").agg(F.count(F.lit(1)).alias("calls"))
    return rows.select("user_id", F.col("w.start").alias("began"), F.col("w.end").alias("ended"), "calls")


def _fold(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
    """Counts and the last calls of a session; its longest run of one tool at the end is what a retry looks like."""
    if state.hasTimedOut:
        calls, errors, last, tools = state.get
        state.remove()
        yield pd.DataFrame([[key[0], calls, errors, 0, last, "idle"]], columns=["user_id", "calls", "errors", "retries", "last_us", "state"])
        return
    calls, errors, last, tools = state.get if state.exists else (0, 0, 0, "")
    recent = tools.split(",") if tools else []
    rows = pd.concat(list(batches)).sort_values(["us", "event_id"])
    calls, errors = calls + len(rows), errors + int((rows["event_type"] == "error").sum())
    last = max(last, int(rows["us"].max()))
    recent = (recent + list(rows["event_type"]))[-LAST_CALLS:]
    run = 0
    for tool in reversed(recent):
        if tool != recent[-1]:
            break
        run += 1
    state.update((calls, errors, last, ",".join(recent)))
    state.setTimeoutTimestamp(max(last // 1000 + IDLE_MINUTES * 60_000, state.getCurrentWatermarkMs() + 1))
    yield pd.DataFrame([[key[0], calls, errors, run, last, "active"]], columns=["user_id", "calls", "errors", "retries", "last_us", "state"])


def live_sessions(events: DataFrame, late: str = "1 hour") -> DataFrame:
    """A status row whenever a session has new calls, and one when it goes idle by the stream's own clock, the watermark.

    Event time, so that a run over what is there ends: a processing-time timeout would keep it waiting.
    """
    rows = events.withWatermark("ts", late).select("user_id", "event_id", "event_type", "ts", F.unix_micros("ts").alias("us"))
    return rows.groupBy("user_id").applyInPandasWithState(_fold, STATUS, STATE, "update", GroupStateTimeout.EventTimeTimeout)


def append_sink(stream: DataFrame, path: str, checkpoint: str, mode: str = "append"):
    """A started query into Parquet that ends when what is there is read."""
    return stream.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).outputMode(mode).trigger(availableNow=True).start()


def latest_status(stream: DataFrame, path: str, checkpoint: str):
    """Keep one status row a session: each batch replaces the rows of the sessions that it has.

    A batch writes a new version beside the last one, so a batch that runs again gives the same table.
    """

    def merge(batch: DataFrame, batch_id: int) -> None:
        new = batch.groupBy("user_id").agg(F.max_by(F.struct(*batch.columns), F.struct("calls", "last_us")).alias("r")).select("r.*")
        if batch_id:
            old = batch.sparkSession.read.parquet(f"{path}/v{batch_id - 1}")
            new = new.unionByName(old.join(new.select("user_id"), "user_id", "left_anti"))
        new.write.mode("overwrite").parquet(f"{path}/v{batch_id}")

    return stream.writeStream.foreachBatch(merge).option("checkpointLocation", checkpoint).outputMode("update").trigger(availableNow=True).start()
