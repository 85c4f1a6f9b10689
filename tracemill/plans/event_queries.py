"""Queries over the event stream: a user stands for a session, an event type for a tool."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..operators import deceit as D
from ..operators import quantiles as N
from ..operators import scope
from ..operators import rollups as R
from ..operators import sequences as S
from ..operators import trajectories as J
from ..session import materialized
from .registry import Tables, query

GAP = 6 * 3600 * 1_000_000
HOUR = 3600 * 1_000_000


def _events(t: Tables) -> DataFrame:
    """Events with microseconds, day, an error flag and the token count of their properties."""
    return t.events.select(
        "event_id", "ts", "user_id", "event_type", "value", S.micros("ts").alias("us"), F.to_date("ts").alias("day"),
        (F.col("event_type") == "error").alias("is_error"), F.get_json_object("props", "$.k").cast("bigint").alias("k"),
    )


E = """e AS (SELECT event_id, ts, user_id, event_type, value, epoch_us(ts) AS us, ts::DATE AS day, event_type = 'error' AS is_error,
  (props->>'$.k')::BIGINT AS k FROM events)"""


@query(f"WITH {E} SELECT event_type AS tool, count(*) AS calls, count(DISTINCT user_id) AS sessions, round(sum(value), 4) AS bytes, "
       "count(*) FILTER (value > 100) AS errors, round(100.0 * count(*) FILTER (value > 100) / count(*), 4) AS error_rate FROM e GROUP BY 1")
def tool_usage_agg(t: Tables) -> DataFrame:
    """Calls, sessions, bytes and error rate in percent by tool."""
    bad = F.count_if(F.col("value") > 100)
    return _events(t).groupBy(F.col("event_type").alias("tool")).agg(
        F.count(F.lit(1)).alias("calls"), F.count_distinct("user_id").alias("sessions"), F.round(F.sum("value"), 4).alias("bytes"),
        bad.alias("errors"), F.round(100.0 * bad / F.count(F.lit(1)), 4).alias("error_rate"),
    )


@query(f"WITH {E} SELECT event_type AS tool, count(*) FILTER (value > 100) AS errors, count(*) AS calls, round(count(*) FILTER (value > 100) / count(*), 6) AS rate "
       "FROM e GROUP BY 1 HAVING count(*) FILTER (value > 100) > 0 ORDER BY errors DESC, tool")
def tool_error_rates(t: Tables) -> DataFrame:
    """Tools with errors, most first; the rate is a fraction here."""
    bad = F.count_if(F.col("value") > 100)
    rows = _events(t).groupBy(F.col("event_type").alias("tool")).agg(bad.alias("errors"), F.count(F.lit(1)).alias("calls"), F.round(bad / F.count(F.lit(1)), 6).alias("rate"))
    return rows.filter("errors > 0").orderBy(F.desc("errors"), "tool")


@query(f"""WITH {E}, b AS (SELECT *, CASE WHEN lag(event_type) OVER w = event_type AND us - lag(us) OVER w <= {GAP} THEN 0 ELSE 1 END AS begins
  FROM e WINDOW w AS (PARTITION BY user_id ORDER BY us, event_id)),
  i AS (SELECT *, sum(begins) OVER (PARTITION BY user_id ORDER BY us, event_id ROWS UNBOUNDED PRECEDING) AS island FROM b)
  SELECT user_id, event_type AS tool, count(*) AS calls, count(*) FILTER (is_error) AS errors, (max(us) - min(us)) // 1000000 AS seconds, min(us) AS began_us
  FROM i GROUP BY user_id, island, event_type HAVING count(*) >= 2""")
def retry_groups(t: Tables) -> DataFrame:
    """Runs of two and more calls of one tool without a longer gap."""
    runs = S.islands(_events(t), ["user_id"], ["us", "event_id"], ["event_type"], "us", GAP)
    return runs.groupBy("user_id", "island", F.col("event_type").alias("tool")).agg(
        F.count(F.lit(1)).alias("calls"), F.count_if("is_error").alias("errors"),
        F.floor((F.max("us") - F.min("us")) / 1_000_000).alias("seconds"), F.min("us").alias("began_us"),
    ).filter("calls >= 2").drop("island")


@query(f"""WITH {E}, n AS (SELECT *, lead(event_type) OVER w AS next_type, lead(us) OVER w - us AS wait FROM e WINDOW w AS (PARTITION BY user_id ORDER BY us, event_id))
  SELECT next_type AS next_tool, count(*) AS times, count(DISTINCT user_id) AS sessions, round(median(wait) / 1000000.0, 3) AS median_wait_s
  FROM n WHERE is_error AND next_type IS NOT NULL GROUP BY 1""")
def error_retry_sequences(t: Tables) -> DataFrame:
    """What follows an error, how often and how soon."""
    w = Window.partitionBy("user_id").orderBy("us", "event_id")
    rows = _events(t).withColumn("next_tool", F.lead("event_type").over(w)).withColumn("wait", F.lead("us").over(w) - F.col("us"))
    rows = rows.filter(F.col("is_error") & F.col("next_tool").isNotNull()).select("user_id", "next_tool", "wait")
    waits = N.exact_quantiles(rows, ["next_tool"], "wait", [0.5])
    counts = rows.groupBy("next_tool").agg(F.count(F.lit(1)).alias("times"), F.count_distinct("user_id").alias("sessions"))
    return counts.join(waits, "next_tool").select("next_tool", "times", "sessions", F.round(F.col("q")[0] / 1e6, 3).alias("median_wait_s"))


@query(f"WITH {E} SELECT user_id, count(*) AS entries, min(us) AS started_us, max(us) AS ended_us, max(us) - min(us) AS duration_us, arg_min(event_type, (us, event_id)) AS opener FROM e GROUP BY 1")
def group_sessions(t: Tables) -> DataFrame:
    """A row a session: entries, start, end, duration and first tool."""
    return _events(t).groupBy("user_id").agg(
        F.count(F.lit(1)).alias("entries"), F.min("us").alias("started_us"), F.max("us").alias("ended_us"),
        (F.max("us") - F.min("us")).alias("duration_us"), F.min_by("event_type", F.struct("us", "event_id")).alias("opener"),
    )


@query(f"""WITH {E}, n AS (SELECT user_id, day, count(*) AS n FROM e GROUP BY ALL)
  SELECT date_trunc('week', day)::DATE AS week, round(sum(value), 4) AS spend, count(*) AS calls, count(DISTINCT user_id) AS sessions FROM e GROUP BY 1""")
def weekly_totals(t: Tables) -> DataFrame:
    """Totals by ISO week, which begins on Monday."""
    return _events(t).groupBy(F.date_trunc("week", "day").cast("date").alias("week")).agg(
        F.round(F.sum("value"), 4).alias("spend"), F.count(F.lit(1)).alias("calls"), F.count_distinct("user_id").alias("sessions")
    )


@query(f"""WITH {E}, w AS (SELECT date_trunc('week', day)::DATE AS week, event_type AS tool, sum(value) AS spend FROM e GROUP BY ALL),
  m AS (SELECT max(week) AS last FROM w)
  SELECT coalesce(a.tool, b.tool) AS tool, round(coalesce(a.spend, 0), 4) AS current, round(coalesce(b.spend, 0), 4) AS prior,
    round(coalesce(a.spend, 0) - coalesce(b.spend, 0), 4) AS delta
  FROM (SELECT * FROM w WHERE week = (SELECT last FROM m)) a FULL JOIN (SELECT * FROM w WHERE week = (SELECT last - 7 FROM m)) b ON a.tool = b.tool""")
def weekly_delta(t: Tables) -> DataFrame:
    """The last week against the one before, by tool, over the union of both weeks' tools."""
    weeks = _events(t).groupBy(F.date_trunc("week", "day").cast("date").alias("week"), F.col("event_type").alias("tool")).agg(F.sum("value").alias("spend"))
    last = weeks.agg(F.max("week").alias("last"))
    both = weeks.join(F.broadcast(last), F.col("week") >= F.date_sub("last", 7))  # one row
    now, before = (F.coalesce(F.sum(F.when(c, F.col("spend"))), F.lit(0.0)) for c in (F.col("week") == F.col("last"), F.col("week") == F.date_sub("last", 7)))
    return both.groupBy("tool").agg(F.round(now, 4).alias("current"), F.round(before, 4).alias("prior"), F.round(now - before, 4).alias("delta"))


@query(f"""WITH {E}, d AS (SELECT day, sum(value) AS spend FROM e GROUP BY 1), r AS (SELECT *, row_number() OVER (ORDER BY day DESC) AS r FROM d)
  SELECT round(sum(spend) FILTER (r <= 7), 4) AS current, round(sum(spend) FILTER (r BETWEEN 8 AND 14), 4) AS prior,
    round((sum(spend) FILTER (r <= 7) - sum(spend) FILTER (r BETWEEN 8 AND 14)) / sum(spend) FILTER (r BETWEEN 8 AND 14), 6) AS change FROM r""")
def activity_wow(t: Tables) -> DataFrame:
    """The last seven active days against the seven before."""
    days = _events(t).groupBy("day").agg(F.sum("value").alias("spend"))
    return R.versus_prior(days, "day", "spend", 7).select(F.round("current", 4).alias("current"), F.round("prior", 4).alias("prior"), F.round("change", 6).alias("change"))


@query(f"""WITH {E}, d AS (SELECT day, sum(value) AS spend FROM e GROUP BY 1),
  s AS (SELECT unnest(generate_series((SELECT min(day) FROM d), (SELECT max(day) FROM d), INTERVAL 1 DAY))::DATE AS day)
  SELECT day, round(coalesce(spend, 0), 4) AS spend,
    round(avg(coalesce(spend, 0)) OVER (ORDER BY day ROWS BETWEEN 6 PRECEDING AND CURRENT ROW), 4) AS trailing_7d FROM s LEFT JOIN d USING (day)""")
def cost_trend_7d(t: Tables) -> DataFrame:
    """Spend by day without gaps and its trailing seven-day mean. The window runs over one row a day."""
    days = _events(t).groupBy("day").agg(F.sum("value").alias("spend"))
    filled = S.calendar(days, "day").join(days, "day", "left").withColumn("spend", F.coalesce("spend", F.lit(0.0)))
    w = Window.orderBy("day").rowsBetween(-6, 0)
    return filled.select("day", F.round("spend", 4).alias("spend"), F.round(F.avg("spend").over(w), 4).alias("trailing_7d"))


@query(f"""WITH {E}, d AS (SELECT day, sum(value) AS spend FROM e GROUP BY 1), m AS (SELECT max(day) AS last FROM d)
  SELECT round(sum(spend) / 7 * day(last_day(any_value(last))), 4) AS month_projection, round(sum(spend), 4) AS last_7d
  FROM d, m WHERE d.day > m.last - 7""")
def burn_projection(t: Tables) -> DataFrame:
    """The month's spend if every day were like the mean of the last seven calendar days."""
    days = _events(t).groupBy("day").agg(F.sum("value").alias("spend"))
    last = days.agg(F.max("day").alias("last"))
    recent = days.join(F.broadcast(last), F.col("day") > F.date_sub("last", 7))  # one row
    return recent.agg((F.sum("spend") / 7 * F.dayofmonth(F.last_day(F.max("last")))).alias("p"), F.sum("spend").alias("s")).select(
        F.round("p", 4).alias("month_projection"), F.round("s", 4).alias("last_7d")
    )


@query("""WITH h AS (SELECT (dayofweek(ts) + 6) % 7 AS weekday, hour(ts) AS hour, count(*) AS n FROM events GROUP BY ALL)
  SELECT d.weekday, x.hour, coalesce(n, 0)::BIGINT AS n FROM (SELECT unnest(range(7)) AS weekday) d CROSS JOIN (SELECT unnest(range(24)) AS hour) x
  LEFT JOIN h ON h.weekday = d.weekday AND h.hour = x.hour""")
def hour_heatmap(t: Tables) -> DataFrame:
    """Calls by weekday (0 is Monday) and hour, with the empty cells of the week."""
    counts = t.events.groupBy(F.weekday("ts").cast("bigint").alias("weekday"), F.hour("ts").cast("bigint").alias("hour")).agg(F.count(F.lit(1)).alias("n"))
    spine = t.spark.range(168).select(F.floor(F.col("id") / 24).alias("weekday"), (F.col("id") % 24).alias("hour"))
    return spine.join(counts, ["weekday", "hour"], "left").select("weekday", "hour", F.coalesce("n", F.lit(0)).alias("n"))


@query(f"""WITH {E}, g AS (SELECT event_type AS tool, us - lag(us) OVER (PARTITION BY user_id ORDER BY us, event_id) AS gap FROM e)
  SELECT tool, count(*) AS n, round(quantile_cont(gap, 0.5) / 1e6, 3) AS p50, round(quantile_cont(gap, 0.9) / 1e6, 3) AS p90, round(quantile_cont(gap, 0.95) / 1e6, 3) AS p95
  FROM g WHERE gap IS NOT NULL GROUP BY 1""")
def turn_latency_quantiles(t: Tables) -> DataFrame:
    """Exact interpolated quantiles of the time since the session's previous call."""
    w = Window.partitionBy("user_id").orderBy("us", "event_id")
    gaps = _events(t).select(F.col("event_type").alias("tool"), (F.col("us") - F.lag("us").over(w)).alias("gap")).filter("gap IS NOT NULL")
    rows = N.exact_quantiles(gaps, ["tool"], "gap", [0.5, 0.9, 0.95])
    return rows.select("tool", "n", *[F.round(F.col("q")[i] / 1e6, 3).alias(c) for i, c in enumerate(("p50", "p90", "p95"))])


@query(f"""WITH {E}, g AS (SELECT us - lag(us) OVER (PARTITION BY user_id ORDER BY us, event_id) AS gap FROM e),
  b AS (SELECT ((gap > {HOUR})::INT + (gap > {6 * HOUR})::INT + (gap > {24 * HOUR})::INT + (gap > {72 * HOUR})::INT + (gap > {2400 * HOUR})::INT) AS bucket FROM g WHERE gap IS NOT NULL)
  SELECT s.bucket, count(b.bucket) AS n FROM (SELECT unnest(range(6))::INT AS bucket) s LEFT JOIN b ON b.bucket = s.bucket GROUP BY 1""")
def latency_histogram(t: Tables) -> DataFrame:
    """Gaps in fixed buckets that include their upper edge, empty buckets too."""
    w = Window.partitionBy("user_id").orderBy("us", "event_id")
    gaps = _events(t).select((F.col("us") - F.lag("us").over(w)).alias("gap"))
    return R.histogram(gaps, F.col("gap"), [HOUR, 6 * HOUR, 24 * HOUR, 72 * HOUR, 2400 * HOUR])


def _task_cost(t: Tables, inclusive: bool) -> DataFrame:
    spans = S.span_index(_events(t), ["user_id"], ["us", "event_id"], F.col("event_type") == "purchase", inclusive, "task")
    costs = materialized(spans.groupBy("user_id", "task").agg(F.sum("value").alias("cost"), F.count(F.lit(1)).alias("calls")))
    q = N.exact_quantiles(costs, [], "cost", [0.5, 0.9])
    whole = costs.agg(F.count(F.lit(1)).alias("tasks"), F.round(F.avg("cost"), 4).alias("mean_cost"), F.max("calls").alias("most_calls"))
    return whole.join(F.broadcast(q), F.lit(True), "left").select("tasks", "mean_cost", F.round(F.col("q")[0], 4).alias("p50"), F.round(F.col("q")[1], 4).alias("p90"), "most_calls")  # one row each


def _task_sql(frame: str) -> str:
    return f"""WITH {E}, s AS (SELECT *, coalesce(sum((event_type = 'purchase')::INT) OVER (PARTITION BY user_id ORDER BY us, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND {frame}), 0) AS task FROM e),
  c AS (SELECT user_id, task, sum(value) AS cost, count(*) AS calls FROM s GROUP BY ALL)
  SELECT count(*) AS tasks, round(avg(cost), 4) AS mean_cost, round(quantile_cont(cost, 0.5), 4) AS p50, round(quantile_cont(cost, 0.9), 4) AS p90, max(calls) AS most_calls FROM c"""


@query(_task_sql("1 PRECEDING"))
def per_task_cost(t: Tables) -> DataFrame:
    """Cost of tasks, each closed by its boundary event (the first one at or after)."""
    return _task_cost(t, False)


@query(_task_sql("CURRENT ROW"))
def task_spans_opened(t: Tables) -> DataFrame:
    """The other edge rule: a boundary event opens a task (the last one at or before)."""
    return _task_cost(t, True)


@query(f"""WITH {E} SELECT x.event_id, p.ts AS purchase_ts FROM e x ASOF JOIN (SELECT user_id, ts FROM e WHERE event_type = 'purchase') p
  ON x.user_id = p.user_id AND p.ts <= x.ts WHERE x.is_error""")
def asof_last_purchase(t: Tables) -> DataFrame:
    """For each error the session's latest purchase before it."""
    e = _events(t)
    bought = e.filter("event_type = 'purchase'").select("user_id", F.col("us").alias("p_us"), F.col("ts").alias("p_ts"))
    found = S.asof(e.filter("is_error"), bought, ["user_id"], "us", "p_us", "p_ts", out="purchase_ts")
    return found.filter("purchase_ts IS NOT NULL").select("event_id", "purchase_ts")


@query(f"""WITH {E}, p AS (SELECT user_id, us FROM e WHERE event_type = 'purchase')
  SELECT x.event_id, min(p.us) - x.us AS wait_us FROM e x JOIN p ON x.user_id = p.user_id AND p.us >= x.us WHERE x.event_type = 'view' GROUP BY x.event_id, x.us""")
def next_boundary(t: Tables) -> DataFrame:
    """For each view the time until the session's next purchase."""
    e = _events(t)
    bought = e.filter("event_type = 'purchase'").select("user_id", F.col("us").alias("p_us"), F.col("event_id").alias("p_id"))
    found = S.asof(e.filter("event_type = 'view'"), bought, ["user_id"], "us", "p_us", "p_id", forward=True, out="p")
    return found.filter("p IS NOT NULL").select("event_id", (F.col("p_time") - F.col("us")).alias("wait_us"))


@query(f"""WITH {E}, l AS (SELECT event_type, count(*) OVER w AS seen, count(*) FILTER (is_error) OVER w AS bad FROM e
  WINDOW w AS (PARTITION BY user_id ORDER BY us, event_id ROWS BETWEEN 1 FOLLOWING AND 3 FOLLOWING))
  SELECT event_type AS tool, count(*) AS calls, count(*) FILTER (bad = 0) AS clean, round((count(*) FILTER (bad = 0) + 1) / (count(*) + 2), 6) AS effectiveness
  FROM l WHERE seen > 0 GROUP BY 1""")
def tool_effectiveness(t: Tables) -> DataFrame:
    """The smoothed chance that none of the next three calls is an error."""
    e = S.look_ahead(_events(t), ["user_id"], ["us", "event_id"], 3, F.count(F.lit(1)), "seen")
    e = S.look_ahead(e, ["user_id"], ["us", "event_id"], 3, F.count_if("is_error"), "bad").filter("seen > 0")
    clean = F.count_if(F.col("bad") == 0)
    return e.groupBy(F.col("event_type").alias("tool")).agg(
        F.count(F.lit(1)).alias("calls"), clean.alias("clean"), F.round((clean + 1) / (F.count(F.lit(1)) + 2), 6).alias("effectiveness")
    )


@query(f"""WITH {E}, l AS (SELECT *, lead(us) OVER w - us AS wait, lead(is_error) OVER w AS failed FROM e WINDOW w AS (PARTITION BY user_id ORDER BY us, event_id))
  SELECT event_type AS agent, count(*) AS runs, count(*) FILTER (wait <= {GAP} AND NOT failed) AS followed, round(median(wait) / 1e6, 3) AS median_follow_s FROM l GROUP BY 1""")
def agent_effectiveness(t: Tables) -> DataFrame:
    """Runs that a successful call follows in time, and the median time to the next call."""
    w = Window.partitionBy("user_id").orderBy("us", "event_id")
    e = _events(t).withColumn("wait", F.lead("us").over(w) - F.col("us")).withColumn("failed", F.lead("is_error").over(w))
    e = e.select(F.col("event_type").alias("agent"), "wait", "failed")
    counts = e.groupBy("agent").agg(F.count(F.lit(1)).alias("runs"), F.count_if((F.col("wait") <= GAP) & ~F.col("failed")).alias("followed"))
    return counts.join(N.exact_quantiles(e, ["agent"], "wait", [0.5]), "agent", "left").select("agent", "runs", "followed", F.round(F.col("q")[0] / 1e6, 3).alias("median_follow_s"))


@query(f"""WITH {E}, g AS (SELECT user_id, event_type || '>' || lead(event_type) OVER w AS g2,
    event_type || '>' || lead(event_type) OVER w || '>' || lead(event_type, 2) OVER w AS g3 FROM e WINDOW w AS (PARTITION BY user_id ORDER BY us, event_id)),
  u AS (SELECT user_id, g2 AS gram FROM g UNION ALL SELECT user_id, g3 FROM g)
  SELECT gram, count(*) AS times, count(DISTINCT user_id) AS sessions FROM u WHERE gram IS NOT NULL GROUP BY 1 HAVING count(*) >= 3 AND count(DISTINCT user_id) >= 2""")
def ngram_sequences(t: Tables) -> DataFrame:
    """Recurring runs of two and three tools."""
    grams = S.ngrams(_events(t), ["user_id"], ["us", "event_id"], "event_type", range(2, 4), "gram")
    return grams.groupBy("gram").agg(F.count(F.lit(1)).alias("times"), F.count_distinct("user_id").alias("sessions")).filter("times >= 3 AND sessions >= 2")


@query(f"""WITH {E}, n AS (SELECT user_id, event_type, row_number() OVER (PARTITION BY user_id ORDER BY us, event_id) AS ord, us FROM e)
  SELECT a.user_id, a.ord AS failed_ord, min(b.ord) AS fixed_ord FROM n a JOIN n b ON a.user_id = b.user_id AND b.ord BETWEEN a.ord + 1 AND a.ord + 6 AND b.event_type = 'purchase'
  WHERE a.event_type = 'error' GROUP BY ALL""")
def correction_pairs(t: Tables) -> DataFrame:
    """Errors that a purchase corrects within the next six calls, by position."""
    w = Window.partitionBy("user_id").orderBy("us", "event_id")
    n = _events(t).withColumn("ord", F.row_number().over(w))
    fixed = F.min(F.when(F.col("event_type") == "purchase", F.col("ord"))).over(w.rowsBetween(1, 6))
    return n.withColumn("fixed_ord", fixed).filter("is_error AND fixed_ord IS NOT NULL").select("user_id", F.col("ord").alias("failed_ord"), "fixed_ord")


@query(f"""WITH {E}, l AS (SELECT *, lag(event_type) OVER (PARTITION BY user_id ORDER BY us, event_id) AS was FROM e)
  SELECT was AS from_mode, event_type AS to_mode, count(*) AS changes, count(DISTINCT user_id) AS sessions FROM l WHERE was <> event_type GROUP BY ALL""")
def permission_changes(t: Tables) -> DataFrame:
    """Changes of mode from one line to the next."""
    was = F.lag("event_type").over(Window.partitionBy("user_id").orderBy("us", "event_id"))
    e = _events(t).withColumn("from_mode", was).filter("from_mode <> event_type")
    return e.groupBy("from_mode", F.col("event_type").alias("to_mode")).agg(F.count(F.lit(1)).alias("changes"), F.count_distinct("user_id").alias("sessions"))


@query(f"WITH {E} SELECT event_type AS mode, count(*) AS lines, round(100.0 * count(*) / sum(count(*)) OVER (), 6) AS share FROM e GROUP BY 1")
def mode_stats(t: Tables) -> DataFrame:
    """Lines by mode and their share in percent."""
    modes = _events(t).groupBy(F.col("event_type").alias("mode")).agg(F.count(F.lit(1)).alias("lines"))
    return modes.withColumn("share", F.round(R.share("lines"), 6))


@query(f"""WITH {E} SELECT user_id, count(*) AS calls FROM e WHERE user_id IN (SELECT user_id FROM e WHERE event_type = 'signup')
  AND user_id NOT IN (SELECT user_id FROM e WHERE is_error AND value > 150) GROUP BY 1""")
def prompt_prone(t: Tables) -> DataFrame:
    """Sessions that signed up (semi-join) and had no costly error (anti-join)."""
    e = _events(t)
    kept = e.join(e.filter("event_type = 'signup'").select("user_id"), "user_id", "left_semi").join(e.filter("is_error AND value > 150").select("user_id"), "user_id", "left_anti")
    return kept.groupBy("user_id").agg(F.count(F.lit(1)).alias("calls"))


@query(f"""WITH {E}, r AS (SELECT event_type, day, k >= 50 AS heavy, value FROM e)
  SELECT event_type, heavy, grouping(event_type)::INT AS all_types, grouping(heavy)::INT AS all_loads, count(*) AS attempts, round(avg(value), 4) AS mean_value
  FROM r GROUP BY GROUPING SETS ((), (event_type), (heavy), (event_type, heavy))""")
def reliability_grouping_sets(t: Tables) -> DataFrame:
    """Attempts overall, by type, by load and by both, in one pass."""
    e = _events(t).withColumn("heavy", F.col("k") >= 50)
    rows = e.groupingSets([[], ["event_type"], ["heavy"], ["event_type", "heavy"]], "event_type", "heavy").agg(
        F.grouping("event_type").cast("int").alias("all_types"), F.grouping("heavy").cast("int").alias("all_loads"),
        F.count(F.lit(1)).alias("attempts"), F.round(F.avg("value"), 4).alias("mean_value"),
    )
    return rows


@query(f"""WITH {E}, m AS (SELECT max(ts) AS last FROM e) SELECT event_type, count(*) AS calls, round(sum(value), 4) AS spend FROM e, m WHERE ts BETWEEN last - INTERVAL 7 DAY AND last GROUP BY 1""")
def time_filter(t: Tables) -> DataFrame:
    """The last seven days, counted back from the data's own end."""
    rows = scope.within(t.events, "ts", "7d")
    return rows.groupBy("event_type").agg(F.count(F.lit(1)).alias("calls"), F.round(F.sum("value"), 4).alias("spend"))


@query(f"""WITH {E}, s AS (SELECT user_id, least(count(*) // 10, 9) AS size, (count(*) FILTER (is_error) > 12)::INT AS bad, count(DISTINCT event_type) AS kinds, sum(value) AS v FROM e GROUP BY 1),
  c AS (SELECT size, bad, kinds, count(*) AS sessions, avg(v) AS mean_value FROM s GROUP BY ALL)
  SELECT size, bad, kinds, sessions, round(mean_value, 4) AS mean_value,
    round(CASE WHEN max(mean_value) OVER () > min(mean_value) OVER () THEN (mean_value - min(mean_value) OVER ()) / (max(mean_value) OVER () - min(mean_value) OVER ()) ELSE 0 END, 6) AS score FROM c""")
def shape_clusters(t: Tables) -> DataFrame:
    """Sessions by shape (size bucket, errors, kinds), and the shapes' values scaled to 0..1."""
    s = _events(t).groupBy("user_id").agg(
        F.least(F.floor(F.count(F.lit(1)) / 10), F.lit(9)).alias("size"), (F.count_if("is_error") > 12).cast("int").alias("bad"),
        F.count_distinct("event_type").alias("kinds"), F.sum("value").alias("v"),
    )
    c = s.groupBy("size", "bad", "kinds").agg(F.count(F.lit(1)).alias("sessions"), F.avg("v").alias("m"))
    return c.select("size", "bad", "kinds", "sessions", F.round("m", 4).alias("mean_value"), F.round(R.min_max("m"), 6).alias("score"))


@query(f"""WITH {E}, s AS (SELECT user_id, (count(*) FILTER (event_type = 'signup') > 0) AS habit, avg(value) AS outcome FROM e GROUP BY 1)
  SELECT round(avg(outcome) FILTER (habit), 4) AS with_habit, round(avg(outcome) FILTER (NOT habit), 4) AS without_habit, count(*) FILTER (habit) AS n_with, count(*) FILTER (NOT habit) AS n_without,
    CASE WHEN count(*) FILTER (habit) < 3 OR count(*) FILTER (NOT habit) < 3 THEN 'unclear' WHEN avg(outcome) FILTER (habit) - avg(outcome) FILTER (NOT habit) > 0.1 THEN 'helps'
      WHEN avg(outcome) FILTER (habit) - avg(outcome) FILTER (NOT habit) < -0.1 THEN 'hurts' ELSE 'neutral' END AS verdict FROM s""")
def habit_impact(t: Tables) -> DataFrame:
    """Mean outcome of sessions with and without a habit, and the verdict, which needs three of each."""
    s = _events(t).groupBy("user_id").agg((F.count_if(F.col("event_type") == "signup") > 0).alias("habit"), F.avg("value").alias("outcome"))
    r = s.agg(
        F.avg(F.when(F.col("habit"), F.col("outcome"))).alias("a"), F.avg(F.when(~F.col("habit"), F.col("outcome"))).alias("b"),
        F.count_if("habit").alias("n_with"), F.count_if(~F.col("habit")).alias("n_without"),
    )
    verdict = F.when((F.col("n_with") < 3) | (F.col("n_without") < 3), "unclear").when(F.col("a") - F.col("b") > 0.1, "helps").when(F.col("a") - F.col("b") < -0.1, "hurts").otherwise("neutral")
    return r.select(F.round("a", 4).alias("with_habit"), F.round("b", 4).alias("without_habit"), "n_with", "n_without", verdict.alias("verdict"))


@query(f"""WITH {E}, t AS (SELECT user_id, us AS start_us, lead(us) OVER (PARTITION BY user_id ORDER BY us, event_id) AS end_us, event_id FROM e WHERE event_type IN ('view', 'purchase'))
  SELECT t.event_id AS turn_id, count(e.event_id) AS calls, round(coalesce(sum(e.value), 0), 4) AS spend FROM t LEFT JOIN e ON e.user_id = t.user_id AND e.us >= t.start_us AND (t.end_us IS NULL OR e.us < t.end_us)
  GROUP BY 1""")
def model_routing_turns(t: Tables) -> DataFrame:
    """What falls in each turn window [start, next start): an interval join as a running turn number."""
    e = _events(t).withColumn("opens", F.col("event_type").isin("view", "purchase"))
    w = Window.partitionBy("user_id").orderBy("us", F.desc("opens"), "event_id").rowsBetween(Window.unboundedPreceding, 0)
    turn = F.last(F.when(F.col("opens"), F.col("event_id")), ignorenulls=True).over(w)
    rows = e.withColumn("turn_id", turn).filter("turn_id IS NOT NULL")
    return rows.groupBy("turn_id").agg(F.count(F.lit(1)).alias("calls"), F.round(F.sum("value"), 4).alias("spend"))


@query(f"""WITH {E}, n AS (SELECT user_id, us, event_id, sum((us - lag_us > {24 * HOUR} OR lag_us IS NULL)::INT) OVER (PARTITION BY user_id ORDER BY us, event_id ROWS UNBOUNDED PRECEDING) AS s
    FROM (SELECT *, lag(us) OVER (PARTITION BY user_id ORDER BY us, event_id) AS lag_us FROM e))
  SELECT user_id, s AS visit, count(*) AS calls, min(us) AS began_us FROM n GROUP BY ALL""")
def session_windows(t: Tables) -> DataFrame:
    """Visits separated by a day without a call."""
    runs = S.islands(_events(t), ["user_id"], ["us", "event_id"], [], "us", 24 * HOUR, "visit")
    return runs.groupBy("user_id", "visit").agg(F.count(F.lit(1)).alias("calls"), F.min("us").alias("began_us"))


@query("""SELECT time_bucket(INTERVAL 1 DAY, ts) AS began, event_type, count(*) AS calls, round(sum(value), 4) AS spend FROM events GROUP BY ALL""")
def tumbling_days(t: Tables) -> DataFrame:
    """Tumbling one-day windows; the same plan serves the stream."""
    rows = t.events.groupBy(F.window("ts", "1 day").alias("w"), "event_type").agg(F.count(F.lit(1)).alias("calls"), F.round(F.sum("value"), 4).alias("spend"))
    return rows.select(F.col("w.start").alias("began"), "event_type", "calls", "spend")


@query("""SELECT b AS began, count(*) AS calls FROM (SELECT unnest(generate_series(time_bucket(INTERVAL 1 DAY, ts) - INTERVAL 6 DAY, time_bucket(INTERVAL 1 DAY, ts), INTERVAL 1 DAY)) AS b FROM events) GROUP BY 1""")
def sliding_weeks(t: Tables) -> DataFrame:
    """Seven-day windows that slide by a day."""
    rows = t.events.groupBy(F.window("ts", "7 days", "1 day").alias("w")).agg(F.count(F.lit(1)).alias("calls"))
    return rows.select(F.col("w.start").alias("began"), "calls")


@query(f"""WITH {E}, f AS (SELECT user_id, day, event_type, dense_rank() OVER (PARTITION BY user_id ORDER BY day DESC) AS r FROM e)
  SELECT event_type, count(*) FILTER (r <= 3) AS recent, count(*) FILTER (r > 3) AS earlier FROM f GROUP BY 1""")
def last_n_runs_audit(t: Tables) -> DataFrame:
    """A tool's calls on each session's last three active days against those before."""
    r = F.dense_rank().over(Window.partitionBy("user_id").orderBy(F.desc("day")))
    return _events(t).withColumn("r", r).groupBy("event_type").agg(F.count_if(F.col("r") <= 3).alias("recent"), F.count_if(F.col("r") > 3).alias("earlier"))


@query(f"""WITH {E}, o AS (SELECT user_id, event_type, us, event_id, row_number() OVER (PARTITION BY user_id ORDER BY us, event_id) AS n FROM e)
  SELECT user_id, CASE WHEN bool_or(event_type = 'purchase') THEN CASE WHEN arg_max(event_type, n) = 'error' THEN 'lapsed' ELSE 'adopted' END
    WHEN bool_or(event_type = 'signup') THEN 'trying' ELSE 'offered' END AS state, max(n) AS steps FROM o GROUP BY 1""")
def adoption_lifecycle(t: Tables) -> DataFrame:
    """The state an ordered fold of a session's events ends in: offered, trying, adopted, lapsed."""
    last = F.max_by("event_type", F.struct("us", "event_id"))
    s = _events(t).groupBy("user_id").agg(
        F.bool_or(F.col("event_type") == "purchase").alias("bought"), F.bool_or(F.col("event_type") == "signup").alias("tried"), last.alias("last"), F.count(F.lit(1)).alias("steps")
    )
    state = F.when(F.col("bought"), F.when(F.col("last") == "error", "lapsed").otherwise("adopted")).when(F.col("tried"), "trying").otherwise("offered")
    return s.select("user_id", state.alias("state"), "steps")


@query(f"""WITH {E}, x AS (SELECT user_id, us, event_id, event_type, count(*) OVER (PARTITION BY user_id ORDER BY us, event_id ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING) AS tail FROM e)
  SELECT event_type, round(sum(least(tail, 40)), 4)::BIGINT AS carried, max(tail) AS longest FROM x GROUP BY 1""")
def cache_tail(t: Tables) -> DataFrame:
    """How many later calls carry a call's output, at most forty each."""
    w = S.following(["user_id"], ["us", "event_id"])
    x = _events(t).withColumn("tail", F.count(F.lit(1)).over(w))
    return x.groupBy("event_type").agg(F.sum(F.least("tail", F.lit(40))).alias("carried"), F.max("tail").alias("longest"))


@query(f"""WITH {E}, b AS (SELECT user_id, us, event_id, event_type, max(us) FILTER (event_type = 'purchase') OVER (PARTITION BY user_id ORDER BY us, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS done FROM e)
  SELECT event_type, count(*) FILTER (us - done <= {14 * 24 * HOUR}) AS recurred, count(*) AS calls FROM b GROUP BY 1""")
def recurrence_window(t: Tables) -> DataFrame:
    """Calls within fourteen days of the session's latest completed task."""
    w = Window.partitionBy("user_id").orderBy("us", "event_id").rowsBetween(Window.unboundedPreceding, -1)
    b = _events(t).withColumn("done", F.max(F.when(F.col("event_type") == "purchase", F.col("us"))).over(w))
    return b.groupBy("event_type").agg(F.count_if(F.col("us") - F.col("done") <= 14 * 24 * HOUR).alias("recurred"), F.count(F.lit(1)).alias("calls"))


@query(f"""WITH {E}, n AS (SELECT user_id, CASE event_type WHEN 'view' THEN 'shown' WHEN 'click' THEN 'applied' WHEN 'purchase' THEN 'verified' WHEN 'error' THEN 'reverted' ELSE 'other' END AS e, row_number() OVER (PARTITION BY user_id ORDER BY us, event_id) AS n FROM e),
  o AS (SELECT *, coalesce(max(n) FILTER (e = 'applied') OVER w, 0) > coalesce(max(n) FILTER (e = 'reverted') OVER w, 0) AS live FROM n WINDOW w AS (PARTITION BY user_id ORDER BY n ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
  k AS (SELECT * FROM o WHERE e IN ('shown', 'applied') OR (e IN ('verified', 'reverted') AND live))
  SELECT user_id, count(*) FILTER (e = 'shown') AS shown, count(*) FILTER (e = 'applied') AS applied, count(*) FILTER (e = 'verified') AS verified, count(*) FILTER (e = 'reverted') AS reverted, arg_max(e, n) FILTER (e <> 'shown' OR NOT live) AS state FROM k GROUP BY 1 HAVING state IS NOT NULL""")
def lifecycle_fold(t: Tables) -> DataFrame:
    """Where a user's events end up, as a fold that depends on their order."""
    kind = F.when(F.col("event_type") == "view", "shown").when(F.col("event_type") == "click", "applied").when(F.col("event_type") == "purchase", "verified").when(F.col("event_type") == "error", "reverted").otherwise("other")
    return S.lifecycle(_events(t).withColumn("e", kind), ["user_id"], ["us", "event_id"], "e")


@query(f"""WITH {E}, o AS (SELECT user_id FROM e GROUP BY 1 HAVING 4 * count(*) FILTER (is_error) < count(*)), g AS (SELECT user_id, event_type AS a, lead(event_type, 1) OVER w AS b, lead(event_type, 2) OVER w AS c, lead(event_type, 3) OVER w AS d, lead(event_type, 4) OVER w AS f
    FROM e WHERE user_id IN (SELECT user_id FROM o) WINDOW w AS (PARTITION BY user_id ORDER BY us, event_id)),
  u AS (SELECT user_id, [a, b, c] AS r FROM g WHERE c IS NOT NULL UNION ALL SELECT user_id, [a, b, c, d] FROM g WHERE d IS NOT NULL UNION ALL SELECT user_id, [a, b, c, d, f] FROM g WHERE f IS NOT NULL),
  s AS (SELECT r, count(DISTINCT user_id) AS sessions, count(*) AS occurrences FROM u WHERE len(list_distinct(r)) > 1 GROUP BY 1 HAVING count(DISTINCT user_id) >= 2)
  SELECT array_to_string(r, ' -> ') AS signature, len(r)::INT AS length, sessions, occurrences, NOT EXISTS (SELECT 1 FROM s l WHERE len(l.r) = len(s.r) + 1 AND (l.r[:-2] = s.r OR l.r[2:] = s.r) AND l.sessions = s.sessions AND l.occurrences = s.occurrences) AS closed FROM s""")
def successful_trajectories(t: Tables) -> DataFrame:
    """Runs of tools that recur in sessions with few errors, and whether a longer one of equal support contains them."""
    e = _events(t)
    good = e.groupBy(F.col("user_id").alias("session_id")).agg((4 * F.count_if("is_error") < F.count(F.lit(1))).alias("good"))
    order = F.row_number().over(Window.partitionBy("user_id").orderBy("us", "event_id"))
    return J.recurring_runs(e.select(F.col("user_id").alias("session_id"), order.alias("ord"), F.col("event_type").alias("tool")), good)


@query(f"""WITH {E}, c AS (SELECT user_id AS session_id, us, event_id, event_type = 'view' AS turn, event_type = 'view' AND value > 20 AS action, event_type = 'view' AND value < 60 AS success, CASE WHEN event_type = 'purchase' AND value > 30 THEN value > 45 END AS failed FROM e),
  w AS (SELECT *, last_value(failed IGNORE NULLS) OVER (PARTITION BY session_id ORDER BY us, event_id) AS latest, count(failed) OVER (PARTITION BY session_id) > 0 AS runs FROM c)
  SELECT session_id, count(*) AS turns, count(*) FILTER (action AND runs) AS backed, count(*) FILTER (action AND NOT runs) AS unbacked, count(*) FILTER (success AND latest) AS contradicted FROM w WHERE turn GROUP BY 1""")
def unborne_claims(t: Tables) -> DataFrame:
    """Claims against the record: views are turns with claims by value, some purchases are verification runs."""
    kind, value = F.col("event_type"), F.col("value")
    e = t.events.select(F.col("user_id").alias("session_id"), F.struct(S.micros("ts").alias("us"), "event_id").alias("seq"), kind, value)
    turns = e.filter(kind == "view").select("session_id", "seq", (value > 20).alias("action"), (value < 60).alias("success"), F.lit("").alias("text"))
    runs = e.filter((kind == "purchase") & (value > 30)).select("session_id", "seq", F.lit(0).alias("pos"), (value > 45).alias("failed"))
    return D.unborne_claims(turns, runs).drop("snippets")
