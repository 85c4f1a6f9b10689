"""Live sessions with `transformWithState`: what each session is doing now, and whether it has gone idle.

State of a session: its totals, and its last `PATTERN_CALLS` calls as a list state, in which two patterns are
looked for: a retry storm (calls of one tool back to back within `RETRY_GAP_S` seconds) and a re-read loop
(one file read `REREADS` times). The last calls by time are kept however late a call comes, since the last of
a union are the last of the last of its parts; so a replay in any order ends in the same state as a batch run
over all calls. A timer `IDLE_MINUTES` after the newest call makes a session idle by the stream's watermark.

Needs the RocksDB state store: `spark.sql.streaming.stateStore.providerClass`.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

#: Calls that patterns look at, seconds between retries, reads of one file, and minutes to idleness.
PATTERN_CALLS, RETRY_GAP_S, REREADS, IDLE_MINUTES = 40, 60, 3, 15
PROVIDER = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"

STATUS = "session_id string, calls long, errors long, last_us long, retry_storm boolean, reread_loop boolean, state string"
CALL = "us long, call_id long, tool string, file string"


def patterns(calls: list[tuple]) -> tuple[bool, bool]:
    """Retry storm and re-read loop among calls (us, call_id, tool, file; file of reads only) in their order."""
    storm = any(a[2] == b[2] and b[0] - a[0] <= RETRY_GAP_S * 1_000_000 for a, b in zip(calls, calls[1:]))
    reads = Counter(c[3] for c in calls if c[3] is not None)
    return storm, any(n >= REREADS for n in reads.values())


class LiveSession(StatefulProcessor):
    """Folds a session's calls as they come; see the module."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.totals = handle.getValueState("totals", "calls long, errors long, last_us long")
        self.recent = handle.getListState("recent", CALL)

    def _status(self, key: tuple, totals: tuple, calls: list[tuple], state: str) -> pd.DataFrame:
        return pd.DataFrame([[key[0], *totals, *patterns(calls), state]], columns=[c.split()[0] for c in STATUS.split(", ")])

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        calls, errors, last = self.totals.get() if self.totals.exists() else (0, 0, 0)
        kept = [tuple(c) for c in self.recent.get()] if self.recent.exists() else []
        for batch in rows:
            calls, errors, last = calls + len(batch), errors + int(batch["is_error"].sum()), max(last, int(batch["us"].max()))
            newest = batch.sort_values(["us", "call_id"]).tail(PATTERN_CALLS)  # no more of a batch can count
            kept = sorted([*kept, *((int(u), int(i), t, None if pd.isna(f) else f) for u, i, t, f in zip(newest["us"], newest["call_id"], newest["tool"], newest["file"]))], key=lambda c: c[:2])[-PATTERN_CALLS:]
        self.totals.update((calls, errors, last))
        self.recent.put(kept)
        for old in list(self.handle.listTimers()):
            self.handle.deleteTimer(old)
        self.handle.registerTimer(max(last // 1000 + IDLE_MINUTES * 60_000, timerValues.getCurrentWatermarkInMs() + 1))
        yield self._status(key, (calls, errors, last), kept, "active")

    def handleExpiredTimer(self, key: tuple, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        """Idle; the state stays, so a session that goes on counts on."""
        yield self._status(key, tuple(self.totals.get()), [tuple(c) for c in self.recent.get()], "idle")

    def close(self) -> None:
        pass


def calls_of(events: DataFrame) -> DataFrame:
    """The event table as calls: session_id, us, call_id, tool, file (of views), is_error, and ts for the watermark."""
    read = F.col("event_type") == "view"
    return events.select(
        F.col("user_id").cast("string").alias("session_id"), "ts", F.unix_micros(F.col("ts").cast("timestamp")).alias("us"), F.col("event_id").alias("call_id"), F.col("event_type").alias("tool"),
        F.when(read, F.get_json_object("props", "$.k")).alias("file"), (F.col("event_type") == "error").alias("is_error"),
    )


def live_sessions(calls: DataFrame, late: str = "1 hour") -> DataFrame:
    """A status row whenever a session has new calls, and one when it goes idle by the stream's own clock."""
    if calls.sparkSession.conf.get("spark.sql.streaming.stateStore.providerClass", "") != PROVIDER:
        raise ValueError(f"set spark.sql.streaming.stateStore.providerClass to {PROVIDER}")
    rows = calls.withWatermark("ts", late).groupBy("session_id")
    return rows.transformWithStateInPandas(LiveSession(), STATUS, "Update", "EventTime")


def session_status(calls: DataFrame) -> DataFrame:
    """The same status of a batch of calls: session_id, calls, errors, last_us, retry_storm, reread_loop; windows only."""
    order = Window.partitionBy("session_id").orderBy("us", "call_id")
    back = Window.partitionBy("session_id").orderBy(F.desc("us"), F.desc("call_id"))
    rows = calls.withColumn("place", F.row_number().over(back)).withColumn("gap", F.when(F.lag("tool").over(order) == F.col("tool"), F.col("us") - F.lag("us").over(order)))
    recent = F.col("place") <= PATTERN_CALLS
    storm = recent & (F.col("place") < PATTERN_CALLS) & (F.col("gap") <= RETRY_GAP_S * 1_000_000)  # the first of the last calls has none before it
    reads = rows.filter(recent & F.col("file").isNotNull()).groupBy("session_id", "file").agg(F.count(F.lit(1)).alias("n")).groupBy("session_id").agg((F.max("n") >= REREADS).alias("loop"))
    g = rows.groupBy("session_id").agg(F.count(F.lit(1)).alias("calls"), F.count_if("is_error").alias("errors"), F.max("us").alias("last_us"), F.coalesce(F.bool_or(storm), F.lit(False)).alias("retry_storm"))
    return g.join(reads, "session_id", "left").select("session_id", "calls", "errors", "last_us", "retry_storm", F.coalesce("loop", F.lit(False)).alias("reread_loop"))
