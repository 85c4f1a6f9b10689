"""Scores and verdicts over sessions, projects and findings, from tables of a row a session or finding.

The numbers are fixed values: they must agree with what users of these scores know. Each axis starts
at a score and loses points by rules; where the data behind an axis are missing it stays at 50 and
says so by its confidence.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Fixed values of the session scorecard.
NEUTRAL, MEDIUM_SHARE = 50, 0.4
CONTEXT_WARN_SHARE, HIGH_GROWTH_PER_HOUR = 0.5, 50_000
CACHE_MISS_POINTS, SURE_CALLS = 12, 2
FILE_TOOLS = ("Read", "Edit", "MultiEdit", "Write", "NotebookEdit")
HARNESS_TOOLS = ("Skill", "Task", "Agent", "TaskCreate", "TaskUpdate", "TaskGet", "TaskList", "TaskStop", "AskUserQuestion")
COST_STEPS = ((10, 35), (3, 25), (1, 12))
PACE_STEPS = ((2, 95), (10, 82), (30, 62))
SLOWEST_PACE = 42
#: Fixed values of the report card: points of the drag score with their thresholds, and its buckets.
STORM_ATTEMPT, STORM_PCT, WORST_ATTEMPT, STORM_POINTS = 4, 25, 8, 40
FIRST_BYTE_MS, FIRST_BYTE_POINTS = 5000, 25
DEAD_MS, DEAD_POINTS = 60_000, 15
FAST_MODE_POINTS = 10
DRAG, HEAVY = 20, 45
COMMITTED_SHARE, LOW_SIGNAL = 0.7, 2


def _capped(count: Column, each: int, most: int) -> Column:
    """Points lost for a count, each so many and at most so many in all."""
    return F.least(F.lit(most), F.coalesce(count, F.lit(0)) * each)


def _whole(x: Column) -> Column:
    """0 to 100, halves rounded up."""
    return F.greatest(F.lit(0), F.least(F.lit(100), F.floor(x + 0.5))).cast("int")


def _floored(score: Column, confidence: Column) -> Column:
    """What a score above neutral is worth at a confidence."""
    s = _whole(score)
    share = F.when(confidence == "high", 1.0).when(confidence == "medium", MEDIUM_SHARE).otherwise(0.0)
    return F.when(s <= NEUTRAL, s.cast("double")).otherwise(NEUTRAL + (s - NEUTRAL) * share)


def _cost(c) -> tuple[Column, Column, Column]:
    lost = F.lit(0)
    for least, points in reversed(COST_STEPS):
        lost = F.when(c("cost") > least, points).otherwise(lost)
    known = c("window").isNotNull()
    crowd = F.when(known & (c("peak") > c("window")), 30).when(known & (c("peak") > c("window") * CONTEXT_WARN_SHARE), 18).otherwise(0)
    cached = c("cache_read") + c("cache_made")
    misses = F.when(cached > 0, (1 - c("cache_read") / cached) * CACHE_MISS_POINTS).otherwise(0.0)
    growth = F.when(c("growth_per_hour") > HIGH_GROWTH_PER_HOUR, 10).otherwise(0)
    score = 100 - lost - crowd - _capped(c("compactions"), 10, 30) - growth - misses - F.when(c("unknown_model"), 5).otherwise(0)
    return c("has_tokens"), score, F.lit("high")


def _outcome(c) -> tuple[Column, Column, Column]:
    errors = c("tool_errors") + c("api_errors")
    clean = (errors == 0).cast("int") + (c("compactions") == 0).cast("int") + (c("cost").isNull() | (c("cost") <= 1)).cast("int")
    label = F.when(c("labelled"), F.when(c("good"), 6).otherwise(-6)).otherwise(0)
    score = F.when(c("good"), 64).otherwise(34) + 10 * clean + label - _capped(errors, 3, 12) - _capped(c("compactions"), 5, 10)
    return c("good").isNotNull(), score, F.when(c("labelled"), "high").otherwise("medium")


def _speed(c) -> tuple[Column, Column, Column]:
    pace, score = c("minutes") / F.greatest(F.lit(1), c("user_turns")), F.lit(SLOWEST_PACE)
    for most, points in reversed(PACE_STEPS):
        score = F.when(pace <= most, points).otherwise(score)
    return c("has_timeline"), score - _capped(c("api_retries"), 5, 25), F.lit("medium")


def _security(c) -> tuple[Column, Column, Column]:
    sure = F.when(c("dangerous_medium") > 0, "medium").when(c("permission_rows") > 0, "high").otherwise("medium")
    score = 100 - F.when(c("bypass"), 30).otherwise(0) - _capped(c("dangerous_high"), 30, 60) - _capped(c("dangerous_medium"), 10, 30)
    return c("has_tools") | (c("permission_rows") > 0), _floored(score, sure), sure


def _portability(c) -> tuple[Column, Column, Column]:
    sure = F.when(c("calls") >= SURE_CALLS, "high").otherwise("medium")
    score = 100 - _capped(c("harness_calls"), 8, 40) - _capped(c("mcp_calls"), 10, 30) - _capped(c("harness_paths"), 15, 30)
    return c("calls") > 0, _floored(score, sure), sure


def _reliability(c) -> tuple[Column, Column, Column]:
    rate = F.coalesce(F.try_divide(c("tool_errors"), c("calls")), F.lit(0.0))
    lost = F.when(c("tool_errors") > 0, F.least(F.lit(45), F.floor(rate * 100 + 0.5))).otherwise(0)
    sure = F.when(c("has_tools") | c("has_runtime"), "high").otherwise("medium")
    score = 100 - lost - _capped(c("api_errors") - c("api_recovered"), 10, 40) - _capped(c("api_recovered"), 4, 20) - _capped(c("hook_errors"), 8, 24)
    return c("has_tools") | (c("api_errors") > 0) | (c("hooks") > 0), _floored(score, sure), sure


def _focus(c) -> tuple[Column, Column, Column]:
    known = c("window").isNotNull()
    crowd = F.when(known & (c("peak") > c("window")), 30).when(known & (c("peak") > c("window") * CONTEXT_WARN_SHARE), 15).otherwise(0)
    growth = F.when(c("growth_per_hour") > HIGH_GROWTH_PER_HOUR, 10).otherwise(0)
    spread = F.when(c("has_tokens"), crowd + _capped(c("compactions"), 8, 25) + growth).otherwise(0)
    busy = F.when((c("user_turns") > 0) & (c("calls") > 20 * c("user_turns")), 20).otherwise(0)
    score = 100 - spread - busy - F.when(c("files") > 20, 15).otherwise(0) - _capped(c("repeats"), 4, 20) - _capped(F.greatest(F.lit(0), c("task_spans") - 1), 6, 24)
    sure = F.when(c("has_tokens") & c("has_tools"), "high").otherwise("medium")
    return c("has_tokens") | c("has_tools") | c("has_timeline"), _floored(score, sure), sure


AXES = {"cost": _cost, "outcome": _outcome, "speed": _speed, "security": _security, "portability": _portability, "reliability": _reliability, "focus": _focus}
FLAGS = ("has_tokens", "has_tools", "has_timeline", "has_runtime", "unknown_model", "labelled", "bypass")
COUNTS = (
    "growth_per_hour", "compactions", "cache_read", "cache_made", "user_turns", "api_errors", "api_retries", "api_recovered", "permission_rows", "calls", "tool_errors", "dangerous_high",
    "dangerous_medium", "harness_calls", "mcp_calls", "harness_paths", "files", "repeats", "hooks", "hook_errors", "task_spans",
)


def session_scorecard(features: DataFrame) -> DataFrame:
    """session_id, axis, score (0 to 100) and confidence of the seven axes of every session.

    features: session_id, `FLAGS`, `COUNTS`, and cost, peak, window (null unless the model is known), good
    (null without an outcome), minutes. What is missing or null counts as false or 0; one pass, no exchange.
    """
    there = set(features.columns)

    def c(name: str) -> Column:
        column = F.col(name) if name in there else F.lit(None).cast("boolean" if name in (*FLAGS, "good") else "double")
        return F.coalesce(column, F.lit(False) if name in FLAGS else F.lit(0)) if name in FLAGS or name in COUNTS else column

    rows = []
    for axis, of in AXES.items():
        known, score, confidence = of(c)
        rows.append(F.struct(F.lit(axis).alias("axis"), F.when(known, _whole(score)).otherwise(NEUTRAL).alias("score"), F.when(known, confidence).otherwise("low").alias("confidence")))
    return features.select("session_id", F.explode(F.array(*rows)).alias("a")).select("session_id", "a.*")


def attribution(sessions: DataFrame) -> DataFrame:
    """cwd: sessions, the entrypoint that most of them use (ties: the first by name), its share, and committed, split or low-signal."""
    each = sessions.groupBy("cwd", "entrypoint").agg(F.count(F.lit(1)).alias("n"))
    g = each.groupBy("cwd").agg(F.sum("n").alias("sessions"), F.min(F.struct((-F.col("n")).alias("less"), "entrypoint")).alias("top"))
    share = -F.col("top.less") / F.col("sessions")
    bucket = F.when(F.col("sessions") <= LOW_SIGNAL, "low-signal").when(share >= COMMITTED_SHARE, "committed").otherwise("split")
    return g.select("cwd", "sessions", F.col("top.entrypoint").alias("entrypoint"), share.alias("share"), bucket.alias("attribution"))


def report_card(registry: DataFrame, telemetry: DataFrame, debug: DataFrame, context: DataFrame | None = None) -> DataFrame:
    """cwd with its attribution, drag score and bucket (OK, DRAG, HEAVY) and verdict (KEEP, FLAG, MOVE).

    registry: session_id, cwd, entrypoint. telemetry: session_id, attempt, wasted_ms of failed calls. debug:
    session_id, max_attempt, ttfb_p90_ms, fast_mode_lost. context (session_id, cwd, entrypoint) places sessions
    with such signals that the registry has lost. Signals are summed by session before they meet projects.
    """
    storms = telemetry.groupBy("session_id").agg(
        F.count(F.lit(1)).alias("events"), F.count_if(F.col("attempt") >= STORM_ATTEMPT).alias("storms"), F.max("attempt").alias("attempt"), F.sum("wasted_ms").alias("wasted_ms")
    )
    logs = debug.groupBy("session_id").agg(F.max("max_attempt").alias("log_attempt"), F.max("ttfb_p90_ms").alias("ttfb"), F.sum("fast_mode_lost").alias("lost"))
    signals = storms.join(logs, "session_id", "full")
    mine = registry.select("session_id", "cwd", "entrypoint")
    if context is not None:
        placed = context.filter("cwd IS NOT NULL AND cwd <> ''").groupBy("session_id").agg(F.min(F.struct("cwd", F.coalesce("entrypoint", F.lit("unknown")).alias("entrypoint"))).alias("p"))
        found = signals.join(mine, "session_id", "left_anti").join(placed, "session_id").select("session_id", "p.cwd", "p.entrypoint")
        mine = mine.unionByName(found)
    zero = lambda x, name: F.coalesce(x, F.lit(0)).alias(name)
    joined = mine.join(signals.withColumn("signal", F.lit(1)), "session_id", "left").groupBy("cwd").agg(
        zero(F.sum("events"), "events"), zero(F.sum("storms"), "storms"), zero(F.greatest(F.max("attempt"), F.max("log_attempt")), "max_attempt"), zero(F.sum("wasted_ms"), "wasted_ms"),
        zero(F.max("ttfb"), "ttfb_p90_ms"), zero(F.sum("lost"), "fast_mode_lost"), zero(F.sum("signal"), "signals"),
    )
    g = attribution(mine).join(joined, "cwd").withColumn("storm_pct", F.floor(F.coalesce(F.try_divide(100 * F.col("storms"), F.col("events")), F.lit(0.0)) + 0.5).cast("int"))
    points = lambda when, n: F.when(when, n).otherwise(0)
    drag = points((F.col("storm_pct") >= STORM_PCT) | (F.col("max_attempt") >= WORST_ATTEMPT), STORM_POINTS) + points(F.col("ttfb_p90_ms") >= FIRST_BYTE_MS, FIRST_BYTE_POINTS)
    drag = drag + points(F.col("wasted_ms") >= DEAD_MS, DEAD_POINTS) + points((F.col("fast_mode_lost") > 0) & F.coalesce(F.col("entrypoint").startswith("sdk-"), F.lit(False)), FAST_MODE_POINTS)
    g = g.withColumn("drag_score", drag).withColumn("drag", F.when(F.col("drag_score") >= HEAVY, "HEAVY").when(F.col("drag_score") >= DRAG, "DRAG").otherwise("OK"))
    measured = F.when(F.col("signals") == 0, "FLAG").when(F.col("drag") == "OK", "KEEP").when(F.col("drag") == "DRAG", "FLAG").otherwise("MOVE")
    return g.withColumn("verdict", F.when(F.col("attribution") == "low-signal", "MOVE").when(F.col("attribution") == "split", "FLAG").otherwise(measured))


#: What can be seen of a domain by its coverage.
LEVELS = {"PROVE": "healthy", "INFER": "sparse", "CANNOT_SEE": "blind-spot"}


def level(status: Column) -> Column:
    """healthy, sparse or blind-spot; a domain of which nothing is known is a blind spot."""
    out = F.lit(LEVELS["CANNOT_SEE"])
    for s, name in LEVELS.items():
        out = F.when(status == s, name).otherwise(out)
    return out


def digest_domains(findings: DataFrame, coverage: DataFrame, domains: DataFrame) -> DataFrame:
    """Every domain with the id of its first finding (null: none), what can be seen of it, and its empty state.

    findings: id, domain, rank (their order); coverage: domain, status, stale_note; domains: domain.
    """
    first = findings.groupBy("domain").agg(F.min_by("id", "rank").alias("id"))
    rows = domains.join(first, "domain", "left").join(coverage.select("domain", "status", "stale_note"), "domain", "left").withColumn("level", level(F.col("status")))
    empty = F.when(F.col("id").isNotNull(), F.lit(None)).when(F.col("level") == "blind-spot", "uninstrumented").when(F.coalesce("stale_note", F.lit("")) != "", "stale").when(F.col("level") == "sparse", "uninstrumented").otherwise("clean")
    return rows.select("domain", "id", "level", empty.alias("empty_state"))


def digest_verdict(findings: DataFrame, coverage: DataFrame) -> DataFrame:
    """One row: the tone (unknown, ok, attention, critical), the finding it names, and the counts it rests on.

    Coverage decides first: without a domain that can be seen there is no verdict. findings: id, category,
    severity, rank. A critical safety finding leads; else the first finding that isn't about safety is named.
    """
    critical = F.col("severity") == "critical"
    safety = F.col("category") == "safety"
    f = findings.agg(
        F.count(F.lit(1)).alias("findings"), F.count_if(critical).alias("critical"), F.min_by("id", F.when(critical & safety, F.col("rank"))).alias("_lead"), F.count_if(critical & safety).alias("_leads"),
        F.min_by("id", F.when(~safety, F.col("rank"))).alias("_other"), F.count_if(~safety).alias("_others"), F.min_by("id", "rank").alias("_first"),
    )
    seen = coverage.agg(F.count_if(level(F.col("status")) != "blind-spot").alias("observed"), F.count_if(level(F.col("status")) == "blind-spot").alias("blind"))
    r = f.crossJoin(F.broadcast(seen))  # one row each
    none, quiet = F.col("observed") == 0, F.col("findings") == 0
    tone = F.when(none, "unknown").when(quiet, "ok").when(F.col("_leads") > 0, "critical").otherwise("attention")
    named = F.when(none | quiet, F.lit(None)).when(F.col("_leads") > 0, F.col("_lead")).when(F.col("_others") > 0, F.col("_other")).otherwise(F.col("_first"))
    return r.select(tone.alias("tone"), named.alias("named"), "findings", "critical", "observed", "blind")
