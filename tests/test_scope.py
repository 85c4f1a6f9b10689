import datetime as dt

from pyspark.sql import functions as F

from tracemill.operators import scope


def test_presets_count_back_from_the_data(spark):
    t = dt.datetime(2020, 1, 31)
    df = spark.createDataFrame([(k, t - dt.timedelta(hours=h)) for k, h in enumerate((0, 24, 25, 168, 169, 1000))], "k int, ts timestamp")
    count = lambda p: scope.within(df, "ts", p).count()
    assert [count(p) for p in ("24h", "7d", "30d", "all")] == [2, 4, 5, 6]


def test_overlap_route_and_sessions(spark):
    df = spark.createDataFrame([("a", 1, 5, 999), ("b", 6, 9, 1000), ("c", 2, 2, 1001)], "session_id string, s int, e int, latency_ms int")
    assert [r[0] for r in scope.overlapping(df, "s", "e", F.lit(2), F.lit(5)).orderBy("session_id").collect()] == ["a", "c"]
    assert [r[0] for r in scope.route(df, latency_gt_ms=999, latency_lte_ms=1000, tool="x", session_id=None).collect()] == ["b"]
    assert scope.of_sessions(df, df.filter("session_id = 'c'")).count() == 1
    assert [r[0] for r in scope.unlisted(df, df.filter("s > 1"), ["session_id"]).collect()] == ["a"]
    assert [r[0] for r in scope.page(df, [F.desc("s")], 1, 1).collect()] == ["c"]
