import datetime as dt

from pyspark.sql import functions as F

from tracemill.streaming import live, sessions

EVENTS = "/root/testdata/sf0.001/events.parquet"


def landing(spark, path, parts=3):
    for k in range(parts):
        spark.read.parquet(EVENTS).filter(F.col("event_id") % parts == k).coalesce(1).write.parquet(f"{path}/{k}")
    return f"{path}/*"


def test_windows_equal_batch(spark, tmp_path):
    stream = live.windowed(live.event_stream(spark, landing(spark, str(tmp_path / "in"))), late="60 days")
    q = stream.writeStream.format("memory").queryName("w").outputMode("complete").trigger(availableNow=True).start()
    q.awaitTermination()
    batch = spark.read.parquet(EVENTS).groupBy(F.window("ts", "1 day").alias("w"), "event_type").agg(F.count(F.lit(1)).alias("calls"))
    want = {(str(r["b"]), r["event_type"], r["calls"]) for r in batch.select(F.col("w.start").alias("b"), "event_type", "calls").collect()}
    assert {(str(r["began"]), r["event_type"], r["calls"]) for r in spark.table("w").collect()} == want


def test_live_sessions_keep_state_over_batches(spark, tmp_path):
    stream = live.live_sessions(live.event_stream(spark, landing(spark, str(tmp_path / "in")), files_per_trigger=1), late="60 days")
    q = live.latest_status(stream, str(tmp_path / "out"), str(tmp_path / "check"))
    q.awaitTermination()
    last = max(tmp_path.joinpath("out").iterdir(), key=lambda p: int(p.name[1:]))
    got = {r["user_id"]: (r["calls"], r["errors"]) for r in spark.read.parquet(str(last)).collect()}
    want = spark.read.parquet(EVENTS).groupBy("user_id").agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("event_type") == "error").alias("e")).collect()
    assert got == {r["user_id"]: (r["n"], r["e"]) for r in want}


def test_visits(spark, tmp_path):
    stream = live.visits(live.event_stream(spark, landing(spark, str(tmp_path / "in"), 1)), "1 day", "60 days")
    q = stream.writeStream.format("memory").queryName("v").outputMode("complete").trigger(availableNow=True).start()
    q.awaitTermination()
    assert spark.table("v").agg(F.sum("calls")).first()[0] == spark.read.parquet(EVENTS).count()


def replay(spark, folder, out, check, per_trigger=1):
    """Run the live query over what is in a folder now; the last status row of each session so far, by calls."""
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", sessions.PROVIDER)
    stream = sessions.live_sessions(sessions.calls_of(live.event_stream(spark, f"{folder}/*", per_trigger)), "60 days")
    q = stream.writeStream.foreachBatch(lambda batch, n: batch.write.mode("overwrite").parquet(f"{out}/{n}")).option("checkpointLocation", check).outputMode("update").trigger(availableNow=True).start()
    q.awaitTermination()
    rows = spark.read.parquet(f"{out}/*").filter("state = 'active'")
    return {r["session_id"]: r for r in rows.groupBy("session_id").agg(F.max_by(F.struct("calls", "errors", "last_us", "retry_storm", "reread_loop"), "calls").alias("r")).select("session_id", "r.*").collect()}


def test_state_after_restart_equals_batch(spark, tmp_path):
    folder, out, check = (str(tmp_path / x) for x in ("in", "out", "check"))
    parts = 4
    put = lambda k: spark.read.parquet(EVENTS).filter(F.col("event_id") % parts == k).coalesce(1).write.parquet(f"{folder}/{k}")
    put(2)
    put(0)
    replay(spark, folder, out, check)
    put(3)
    put(1)  # earlier calls than some that were there
    got = replay(spark, folder, out, check)
    want = {r["session_id"]: r for r in sessions.session_status(sessions.calls_of(spark.read.parquet(EVENTS))).collect()}
    assert got == want and len(want) > 5
    events = spark.read.parquet(EVENTS)
    plain = {}
    for r in sessions.calls_of(events).orderBy("us", "call_id").collect():
        plain.setdefault(r["session_id"], []).append((r["us"], r["call_id"], r["tool"], r["file"]))
    assert {s: (r["retry_storm"], r["reread_loop"]) for s, r in want.items()} == {s: sessions.patterns(c[-sessions.PATTERN_CALLS :]) for s, c in plain.items()}


def test_sessions_go_idle(spark, tmp_path):
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", sessions.PROVIDER)
    folder = str(tmp_path / "in")
    schema = "event_id long, ts timestamp_ntz, user_id long, event_type string, value double, props string"
    at = lambda minute: dt.datetime(2026, 1, 1) + dt.timedelta(minutes=minute)
    rows = [(1, at(0), 1, "view", 1.0, '{"k": 1}'), (2, at(0.5), 1, "view", 1.0, '{"k": 1}'), (3, at(3), 1, "view", 1.0, '{"k": 1}'), (4, at(0), 2, "click", 1.0, "{}"), (5, at(100), 2, "click", 1.0, "{}")]
    for n, part in enumerate((rows[:4], rows[4:], [(6, at(200), 3, "error", 1.0, "{}")])):
        spark.createDataFrame(part, schema).coalesce(1).write.parquet(f"{folder}/{n}")
    stream = sessions.live_sessions(sessions.calls_of(live.event_stream(spark, f"{folder}/*", 1)), "1 minute")
    q = stream.writeStream.format("memory").queryName("idle").outputMode("update").trigger(availableNow=True).start()
    q.awaitTermination()
    seen = [tuple(r) for r in spark.table("idle").select("session_id", "calls", "state", "retry_storm", "reread_loop").collect()]
    assert ("1", 3, "active", True, True) in seen and ("1", 3, "idle", True, True) in seen
    assert ("2", 2, "active", False, False) in seen and ("2", 2, "idle", False, False) in seen  # went on before it was seen to idle
    assert ("3", 1, "active", False, False) in seen and not any(s[0] == "3" and s[2] == "idle" for s in seen)
