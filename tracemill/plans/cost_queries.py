"""Context, cache and compaction queries: an order is a session, its line items in order its messages.

Quantity stands for fresh input, price for context, discount and tax for cache shares.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .registry import Tables, query

ORDER = ["l_shipdate", "l_linenumber", "l_partkey", "l_suppkey"]
W = "PARTITION BY l_orderkey ORDER BY l_shipdate, l_linenumber, l_partkey, l_suppkey"
S = f"s AS (SELECT *, row_number() OVER ({W}) AS seq, lag(l_extendedprice) OVER ({W}) AS before, lag(l_shipdate) OVER ({W}) AS before_ts FROM lineitem)"


def _messages(t: Tables) -> DataFrame:
    w = Window.partitionBy("l_orderkey").orderBy(*ORDER)
    return t.lineitem.select(
        "*", F.row_number().over(w).alias("seq"), F.lag("l_extendedprice").over(w).alias("before"), F.lag("l_shipdate").over(w).alias("before_ts")
    )


@query(f"""WITH {S} SELECT l_orderkey AS session, seq, round(before, 2) AS before, round(l_extendedprice, 2) AS after, round(100 * (1 - l_extendedprice / before), 2) AS reduction
  FROM s WHERE l_extendedprice < 0.7 * before AND l_shipdate <= before_ts + INTERVAL 120 DAY""")
def compaction_events(t: Tables) -> DataFrame:
    """Context that falls below 0.7 of the message before, soon after it."""
    m = _messages(t).filter("l_extendedprice < 0.7D * before AND l_shipdate <= before_ts + INTERVAL 120 DAYS")
    return m.select(F.col("l_orderkey").alias("session"), "seq", F.round("before", 2).alias("before"), F.round("l_extendedprice", 2).alias("after"),
                    F.round(100 * (1 - F.col("l_extendedprice") / F.col("before")), 2).alias("reduction"))


@query(f"""WITH {S}, g AS (SELECT l_orderkey AS session, arg_min(l_extendedprice, seq) AS first, arg_max(l_extendedprice, seq) AS last, max(l_extendedprice) AS peak, count(*) AS n FROM s GROUP BY 1)
  SELECT session, round(first, 2) AS first, round(last, 2) AS last, round(peak, 2) AS peak, CASE WHEN n > 1 THEN round((last - first) / (n - 1), 6) END AS growth FROM g""")
def context_growth(t: Tables) -> DataFrame:
    """First, last and peak context of a session, and its growth a message."""
    g = _messages(t).groupBy(F.col("l_orderkey").alias("session")).agg(
        F.min_by("l_extendedprice", "seq").alias("a"), F.max_by("l_extendedprice", "seq").alias("b"), F.max("l_extendedprice").alias("p"), F.count(F.lit(1)).alias("n")
    )
    growth = F.when(F.col("n") > 1, F.round((F.col("b") - F.col("a")) / (F.col("n") - 1), 6))
    return g.select("session", F.round("a", 2).alias("first"), F.round("b", 2).alias("last"), F.round("p", 2).alias("peak"), growth.alias("growth"))


@query("""SELECT l_returnflag AS kind, round(sum(l_discount) / (sum(l_discount) + sum(l_tax)), 6) AS hit_rate, count(*) FILTER (l_discount > l_tax) AS good, count(*) AS n FROM lineitem GROUP BY 1""")
def cache_efficiency(t: Tables) -> DataFrame:
    """Cache read over read and written."""
    return t.lineitem.groupBy(F.col("l_returnflag").alias("kind")).agg(
        F.round(F.sum("l_discount") / (F.sum("l_discount") + F.sum("l_tax")), 6).alias("hit_rate"), F.count_if(F.col("l_discount") > F.col("l_tax")).alias("good"), F.count(F.lit(1)).alias("n")
    )


@query(f"""WITH {S}, h AS (SELECT l_orderkey AS session, sum(l_discount) / nullif(sum(l_discount) + sum(l_tax), 0) AS hit, max(l_extendedprice) AS peak,
    count(*) FILTER (l_extendedprice < 0.7 * before) AS compactions FROM s GROUP BY 1)
  SELECT session, greatest(0, 100 - CASE WHEN hit < 0.5 THEN 20 ELSE 0 END - least(30, 10 * compactions) - CASE WHEN peak > 80000 THEN 20 ELSE 0 END - CASE WHEN peak > 100000 THEN 20 ELSE 0 END)::BIGINT AS score FROM h""")
def health_score(t: Tables) -> DataFrame:
    """A session's context health: 100 less fixed penalties, not below 0."""
    h = _messages(t).groupBy(F.col("l_orderkey").alias("session")).agg(
        F.try_divide(F.sum("l_discount"), F.sum("l_discount") + F.sum("l_tax")).alias("hit"), F.max("l_extendedprice").alias("peak"), F.count_if(F.expr("l_extendedprice < 0.7D * before")).alias("c")
    )
    lost = F.when(F.col("hit") < 0.5, 20).otherwise(0) + F.least(F.lit(30), 10 * F.col("c")) + F.when(F.col("peak") > 80000, 20).otherwise(0) + F.when(F.col("peak") > 100000, 20).otherwise(0)
    return h.select("session", F.greatest(F.lit(0), 100 - lost).cast("bigint").alias("score"))


@query(f"""WITH {S}, r AS (SELECT l_orderkey AS session, 100 * max(l_extendedprice) / 105000 AS peak, max(greatest(0, l_extendedprice - before)) AS growth, avg((l_quantity > 40)::INT) AS big, count(*) FILTER (l_extendedprice < 0.7 * before) AS c FROM s GROUP BY 1),
  p AS (SELECT session, CASE WHEN peak >= 80 THEN 40 WHEN peak >= 50 THEN 20 + 20 * (peak - 50) / 30 ELSE 20 * peak / 50 END AS a, CASE WHEN growth >= 15000 THEN 25 WHEN growth >= 5000 THEN 12 + 13 * (growth - 5000) / 10000 ELSE 12 * coalesce(growth, 0) / 5000 END AS b,
    CASE WHEN big >= 0.25 THEN 20 WHEN big >= 0.1 THEN 10 + 10 * (big - 0.1) / 0.15 ELSE 10 * big / 0.1 END AS d, least(15, 7 * c) AS e FROM r)
  SELECT session, round(a + b + d + e, 4) AS risk, CASE WHEN a + b + d + e >= 60 THEN 'high' WHEN a + b + d + e >= 30 THEN 'medium' ELSE 'low' END AS band FROM p""")
def compaction_risk(t: Tables) -> DataFrame:
    """A score of capped, piecewise-linear parts: peak, growth, large outputs, compactions."""

    def piece(x, low: float, high: float, mid: float, top: float):
        return F.when(x >= high, top).when(x >= low, mid + (top - mid) * (x - low) / (high - low)).otherwise(mid * x / low)

    r = _messages(t).groupBy(F.col("l_orderkey").alias("session")).agg(
        (100 * F.max("l_extendedprice") / 105000).alias("peak"), F.coalesce(F.max(F.greatest(F.lit(0.0), F.col("l_extendedprice") - F.col("before"))), F.lit(0.0)).alias("growth"),
        F.avg((F.col("l_quantity") > 40).cast("int")).alias("big"), F.count_if(F.expr("l_extendedprice < 0.7D * before")).alias("c"),
    )
    score = piece(F.col("peak"), 50, 80, 20, 40) + piece(F.col("growth"), 5000, 15000, 12, 25) + piece(F.col("big"), 0.1, 0.25, 10, 20) + F.least(F.lit(15), 7 * F.col("c"))
    r = r.withColumn("s", score)
    return r.select("session", F.round("s", 4).alias("risk"), F.when(F.col("s") >= 60, "high").when(F.col("s") >= 30, "medium").otherwise("low").alias("band"))


@query(f"""WITH {S}, c AS (SELECT l_orderkey, l_returnflag, seq, sum(l_quantity) OVER (PARTITION BY l_orderkey ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS carried FROM s)
  SELECT l_orderkey AS session, seq, round(coalesce(carried, 0), 2) AS carried FROM c WHERE l_returnflag = 'R'""")
def context_history(t: Tables) -> DataFrame:
    """What a session had used before each message: the message itself not counted."""
    w = Window.partitionBy("l_orderkey").orderBy("seq").rowsBetween(Window.unboundedPreceding, -1)
    m = _messages(t).withColumn("carried", F.sum("l_quantity").over(w)).filter("l_returnflag = 'R'")
    return m.select(F.col("l_orderkey").alias("session"), "seq", F.round(F.coalesce("carried", F.lit(0.0)), 2).alias("carried"))


@query(f"""WITH {S}, m AS (SELECT l_orderkey AS session, l_linenumber AS message, max(l_quantity) AS used, sum(l_tax) AS visible, list_sort(list_distinct(list(l_suppkey))) AS tools, arg_min(l_shipmode_, seq) AS first_flag FROM (SELECT *, l_returnflag AS l_shipmode_ FROM s) GROUP BY ALL)
  SELECT session, message, used, round(visible, 4) AS visible, tools, first_flag FROM m""")
def message_merge(t: Tables) -> DataFrame:
    """Lines repeated for a message: counters by maximum, visible parts by sum, tool ids as a set, the rest from the first line."""
    return _messages(t).groupBy(F.col("l_orderkey").alias("session"), F.col("l_linenumber").alias("message")).agg(
        F.max("l_quantity").alias("used"), F.round(F.sum("l_tax"), 4).alias("visible"), F.array_sort(F.collect_set("l_suppkey")).alias("tools"), F.min_by("l_returnflag", "seq").alias("first_flag")
    )
