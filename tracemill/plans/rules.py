"""The catalogue of threshold rules: each turns the session tables into at most a few recommendations.

A rule is a function of the tables and a fixed `now`; it returns rows of RECOMMENDATION or None
where a table that it needs is not available (it is dark then, which is not the same as quiet).
Rules only aggregate; `recommend` adds the fixed columns, and `build` runs them all and ranks what
they say. What several rules need is written once: tool calls in order, and a row a session with
every total of its messages, so that the large tables are scanned once and not by every rule.
"""

from __future__ import annotations

import datetime as dt
from collections.abc import Callable
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.cost import context_tokens, entry_cost
from ..operators import sequences as S
from ..operators import stats as X
from ..operators.quantiles import exact_quantiles
from ..session import materialized
from ..sources.settings import answered

RECOMMENDATION = (
    "id string, category string, severity string, severity_rank int, title string, est_savings_usd double, est_minutes double, affected bigint, evidence array<string>, emit_order int"
)
#: Ranks of severities and the thresholds that several rules share.
RANK = {"critical": 3, "warning": 2, "info": 1}
MIN_USD, MIN_BYPASS, MIN_ERROR_RATE, MIN_CALLS, MIN_RETRIES, MIN_CHURN = 0.05, 10, 0.20, 5, 4, 15
STALE_WEEKS, MIN_SESSIONS, MIN_TURNS, MAX_REFUSAL, RATE_LIMITS = 4, 3, 50, 0.15, (429, 529)
LOW_HIT, WINDOW, CHARS_PER_TOKEN = 0.5, 200_000, 4
EDIT_TOOLS = ("Edit", "Write", "MultiEdit", "NotebookEdit")
BYPASSED = r"^\s*(?:grep|rg|find|cat|head|tail|sed|awk|cd)\b"
#: Rules whose jobs run at a time.
SIDE_BY_SIDE = 8
RISKY = {"critical": r"\brm\s+-[a-z]*r[a-z]*f|\bgit\s+push\s+.*--force\b|\bmkfs\b|\bdd\s+if=", "warning": r"\bgit\s+reset\s+--hard\b|\bchmod\s+777\b|\bcurl\b[^|]*\|\s*(?:ba)?sh\b"}


@dataclass
class Signals:
    """The tables that rules read, each None while its source is missing.

    token_entries (with `base` price or null), tool_calls, sessions, api_errors, timeline, turns, stop_hooks,
    permission_rows, attribution, tool_inventory, plans, workflows, tasks, installed, latency, steering.
    """

    now: dt.datetime
    tables: dict[str, DataFrame] = field(default_factory=dict)
    features: dict[str, DataFrame] = field(default_factory=dict)

    def __getattr__(self, name: str) -> DataFrame | None:
        return self.__dict__.get("tables", {}).get(name)

    def has(self, *names: str) -> bool:
        return all(n in self.tables for n in names)

    def feature(self, name: str, make: Callable[[], DataFrame]) -> DataFrame:
        """A table that several rules share, made and written once."""
        if name not in self.features:
            self.features[name] = materialized(make())
        return self.features[name]

    def prepared(self) -> Signals:
        """The same signals with tool calls written once, narrow and ordered, so that no rule orders or parses them again."""
        if "tool_calls" not in self.tables:
            return self
        return Signals(self.now, {**self.tables, "tool_calls": materialized(self.tables["tool_calls"])}, self.features)

    def since(self, days: float) -> Column:
        return F.lit(self.now - dt.timedelta(days=days))


@dataclass
class Rule:
    id: str
    needs: tuple[str, ...]
    run: Callable[[Signals], DataFrame]
    order: int


RULES: list[Rule] = []


def rule(rule_id: str, *needs: str):
    """Register a rule with the tables it cannot do without."""

    def register(f: Callable[[Signals], DataFrame]) -> Callable[[Signals], DataFrame]:
        RULES.append(Rule(rule_id, needs, f, len(RULES) + 1))
        return f

    return register


def recommend(df: DataFrame, when: Column, severity: str | Column, title: str, affected: str | Column = "affected", usd: str | Column | None = None,
              minutes: str | Column | None = None, evidence: str | Column | None = None) -> DataFrame:
    """The rows of df that meet `when`, in the shape of a recommendation without its id."""
    col = lambda c: F.col(c) if isinstance(c, str) else c
    sev = F.lit(severity) if isinstance(severity, str) else severity
    return df.filter(when).select(
        sev.alias("severity"), F.lit(title).alias("title"), (F.lit(None) if usd is None else col(usd)).cast("double").alias("est_savings_usd"),
        (F.lit(None) if minutes is None else col(minutes)).cast("double").alias("est_minutes"), col(affected).cast("bigint").alias("affected"),
        (F.array().cast("array<string>") if evidence is None else F.transform(col(evidence), lambda x: x.cast("string"))).alias("evidence"),
    )


def top(label: str, value: str, n: int = 5) -> Column:
    """Of the grouped rows the n labels of largest value, for evidence; aggregated, so n rows stay small."""
    pairs = F.collect_list(F.struct((-F.col(value)).alias("v"), F.col(label).cast("string").alias("l")))
    return F.transform(F.slice(F.array_sort(pairs), 1, n), lambda p: p["l"])


def _first(df: DataFrame, value: str, n: int = 5) -> DataFrame:
    """The n rows of largest value: what evidence is gathered from, so that no long list is."""
    return df.orderBy(F.desc(value), *sorted(c for c in df.columns if c != value)).limit(n)


def with_evidence(totals: DataFrame, detail: DataFrame, label: str, value: str, n: int = 5) -> DataFrame:
    """A one-row table with the top labels of another table."""
    return totals.crossJoin(F.broadcast(_first(detail.select(label, value), value, n).agg(top(label, value, n).alias("evidence"))))  # one row each


def costs(s: Signals) -> DataFrame:
    return s.token_entries.withColumn("cost", entry_cost("base")).withColumn("context", context_tokens())


def session_costs(s: Signals) -> DataFrame:
    """A row a session: its spend, context and bounds. Every rule on sessions reads this table."""
    return s.feature("session_costs", lambda: _session_costs(s))


def _session_costs(s: Signals) -> DataFrame:
    hour = F.least("cache_creation_1h", "cache_creation")
    per = F.col("base") / 1e6
    sdk = F.coalesce(F.col("entrypoint").startswith("sdk-"), F.lit(False))
    w = Window.partitionBy("session_id").orderBy("ts", "seq")
    e = costs(s).withColumn("before", F.lag("context").over(w)).withColumn("gap", S.micros("ts") - S.micros(F.lag("ts").over(w)))
    shrank = (F.col("context") < 0.7 * F.col("before")) & (F.col("gap") <= 5 * 60 * 1_000_000)
    return e.groupBy("session_id").agg(
        F.sum("cost").alias("cost"), F.max("context").alias("peak"), F.sum("cache_read").alias("read"), F.sum("cache_creation").alias("made"), F.sum("output").alias("output"),
        F.max("ts").alias("last_ts"), F.bool_or(F.col("base").isNull()).alias("unknown"), F.max("entrypoint").alias("entrypoint"), F.count(F.lit(1)).alias("messages"),  # sdk-* sorts last: one such message makes a session unattended
        F.sum(hour * per * 0.75).alias("hour_extra"), F.count_if(F.col("cache_creation_1h") > 0).alias("hour_messages"), F.sum(per * 0.1 * F.col("cache_read")).alias("read_usd"), F.sum(per * 2 * hour).alias("hour_usd"),
        F.sum(0.01 * F.col("web_search")).alias("search_usd"), F.sum("web_search").alias("searches"), F.bool_or(F.col("service_tier") == "priority").alias("priority"),
        F.sum("thinking").alias("thought"), F.sum("visible").alias("shown"), F.sum(F.col("thinking") * per * 5 * 0.5).alias("thought_usd"),
        F.sum(F.when(sdk, F.col("input") + F.col("output"))).alias("batch_tokens"), F.sum(F.when(sdk, per * (F.col("input") + 5 * F.col("output")) * 0.5)).alias("batch_usd"),
        F.count_if(shrank).alias("shrunk"),
    )


def bash(s: Signals) -> DataFrame:
    return s.tool_calls.filter("tool_name = 'Bash' AND input.command IS NOT NULL").withColumn("command", F.col("input.command"))


# -- cost -------------------------------------------------------------------------------------


@rule("cost.cache-1h-waste", "token_entries")
def cache_1h_waste(s: Signals) -> DataFrame:
    t = session_costs(s).agg(F.sum("hour_extra").alias("usd"), F.sum("hour_messages").alias("affected"))
    return recommend(t, F.col("usd") >= MIN_USD, F.when(F.col("usd") >= 1, "warning").otherwise("info"), "Hour-long cache writes cost more than they save", usd="usd")


@rule("cost.cache-economics", "token_entries")
def cache_economics(s: Signals) -> DataFrame:
    t = session_costs(s).agg(F.sum("read_usd").alias("read_usd"), F.sum(F.when(F.col("read") == 0, F.col("hour_usd"))).alias("unread"), F.count_if((F.col("read") == 0) & (F.col("hour_usd") > 0)).alias("affected"))
    return recommend(t, (F.col("read_usd") >= 5) | (F.col("unread") >= 1), F.when(F.col("unread") >= 1, "warning").otherwise("info"), "Context is paid for and not read again", usd="unread")


@rule("cost.expensive-sessions", "token_entries")
def expensive_sessions(s: Signals) -> DataFrame:
    c = session_costs(s)
    head = _first(c.select("session_id", "cost"), "cost", 3)
    t = c.agg(F.sum("cost").alias("all"), F.count(F.lit(1)).alias("n")).crossJoin(F.broadcast(head.agg(F.sum("cost").alias("three"), top("session_id", "cost", 3).alias("evidence"))))  # one row each
    return recommend(t, (F.col("n") >= 5) & (F.col("three") >= 0.25 * F.col("all")) & (F.col("three") > 0), "info", "Three sessions make up much of the spend", F.lit(3), evidence="evidence")


@rule("cost.automation-share", "token_entries")
def automation_share(s: Signals) -> DataFrame:
    auto = F.coalesce(F.col("entrypoint").startswith("sdk-"), F.lit(False))
    t = session_costs(s).agg(F.sum("cost").alias("all"), F.sum(F.when(auto, F.col("cost"))).alias("usd"), F.count_if(auto).alias("affected"))
    return recommend(t, (F.col("usd") >= 1) & (F.col("usd") >= 0.15 * F.col("all")), "info", "Unattended runs take a large share of the spend", usd="usd")


@rule("cost.unknown-model", "token_entries")
def unknown_model(s: Signals) -> DataFrame:
    t = session_costs(s).filter("unknown").agg(F.count(F.lit(1)).alias("affected"))
    return recommend(t, F.col("affected") > 0, "info", "Sessions use a model without a known price")


@rule("cost.web-search-spend", "token_entries")
def web_search_spend(s: Signals) -> DataFrame:
    t = session_costs(s).agg(F.sum("search_usd").alias("search"), F.sum("cost").alias("all"), F.sum("searches").alias("affected"))
    return recommend(t, (F.col("search") >= 0.5) & (F.col("search") > 0.1 * F.col("all")), "info", "Web searches are a visible part of the spend", usd=0.25 * F.col("search"))


@rule("cost.priority-tier-spend", "token_entries")
def priority_tier(s: Signals) -> DataFrame:
    t = session_costs(s).agg(F.count_if("priority").alias("affected"))
    return recommend(t, F.col("affected") >= 3, "info", "Sessions run on the priority tier")


@rule("cost.disproportionate-thinking", "token_entries")
def disproportionate_thinking(s: Signals) -> DataFrame:
    t = session_costs(s).filter("thought >= 20000 AND shown >= 2000 AND thought >= 2.0D * shown").agg(F.count(F.lit(1)).alias("affected"), F.sum("thought_usd").alias("usd"))
    return recommend(t, F.col("usd") >= 0.25, "info", "Thinking outweighs what is shown", usd="usd")


@rule("cost.batchable-workload", "token_entries")
def batchable_workload(s: Signals) -> DataFrame:
    t = session_costs(s).filter("batch_tokens >= 50000").agg(F.count(F.lit(1)).alias("affected"), F.sum("batch_usd").alias("usd"))
    return recommend(t, F.col("usd") >= MIN_USD, "info", "Unattended work could run in batches at half the price", usd="usd")


@rule("cost.expensive-agent-type", "token_entries", "attribution")
def expensive_agent_type(s: Signals) -> DataFrame:
    a = s.attribution.filter("kind = 'agent'")
    total = session_costs(s).select("session_id", F.col("cost"), F.col("output").alias("all_output"))
    runs = a.join(total, "session_id").withColumn("part", F.try_divide(F.col("cost") * F.col("output_tokens"), F.col("all_output")))
    g = runs.groupBy("name").agg(F.avg("part").alias("mean"), F.count(F.lit(1)).alias("runs"), F.sum("part").alias("usd")).filter("runs >= 5 AND mean > 0.10D")
    t = g.agg(F.count(F.lit(1)).alias("affected"), F.sum("usd").alias("usd"))
    return recommend(with_evidence(t, g, "name", "mean"), F.col("affected") > 0, "info", "An agent type is expensive a run", usd="usd", evidence="evidence")


@rule("cost.idle-mcp-tools", "tool_inventory")
def idle_mcp_tools(s: Signals) -> DataFrame:
    tool = s.tool_inventory.select("session_id", F.explode("available").alias("name"), "used").filter(F.col("name").startswith("mcp__"))
    g = tool.groupBy("name").agg(F.count_if(F.array_contains("used", F.col("name"))).alias("uses"), F.count(F.lit(1)).alias("sessions")).filter("uses = 0 AND sessions >= 3")
    return recommend(with_evidence(g.agg(F.count(F.lit(1)).alias("affected")), g, "name", "sessions"), F.col("affected") > 0, "info", "Tools are offered and never used", evidence="evidence")


# -- context ----------------------------------------------------------------------------------


@rule("context.over-window", "token_entries")
def over_window(s: Signals) -> DataFrame:
    c = session_costs(s).filter(F.col("peak") > WINDOW)
    return recommend(with_evidence(c.agg(F.count(F.lit(1)).alias("affected")), c, "session_id", "peak"), F.col("affected") > 0, "warning", "Contexts outgrow the window", evidence="evidence")


@rule("context.low-health", "token_entries")
def low_health(s: Signals) -> DataFrame:
    c = session_costs(s).withColumn("n", F.col("shrunk"))
    hit = F.try_divide(F.col("read"), F.col("read") + F.col("made"))
    lost = F.when(hit < LOW_HIT, 20).otherwise(0) + F.least(F.lit(30), 10 * F.col("n")) + F.when(F.col("peak") > 100_000, 20).otherwise(0) + F.when(F.col("peak") > WINDOW, 20).otherwise(0)
    bad = c.withColumn("score", 100 - lost).filter("score < 50")
    return recommend(bad.agg(F.count(F.lit(1)).alias("affected")), F.col("affected") > 0, "warning", "Sessions are in poor context health")


@rule("context.low-cache-hit", "token_entries")
def low_cache_hit(s: Signals) -> DataFrame:
    c = session_costs(s).filter("read + made > 0").withColumn("hit", F.col("read") / (F.col("read") + F.col("made"))).filter(F.col("hit") < LOW_HIT)
    return recommend(c.agg(F.count(F.lit(1)).alias("affected")), F.col("affected") > 0, "info", "The cache is written more than read")


@rule("context.repeated-compactions", "token_entries")
def repeated_compactions(s: Signals) -> DataFrame:
    c = session_costs(s).select("session_id", F.col("shrunk").alias("n")).filter("n >= 2")
    return recommend(with_evidence(c.agg(F.count(F.lit(1)).alias("affected")), c, "session_id", "n"), F.col("affected") >= 2, "warning", "Sessions compact again and again", evidence="evidence")


@rule("context.last-n-runs-audit", "token_entries")
def last_n_runs(s: Signals) -> DataFrame:
    c = session_costs(s).select("session_id", "last_ts", "peak")
    recent = c.orderBy(F.desc("last_ts"), "session_id").limit(10).agg(F.sum("peak").alias("ten"), F.count(F.lit(1)).alias("affected"))
    every = c.agg(F.sum("peak").alias("all"), F.count(F.lit(1)).alias("sessions"))
    t = every.crossJoin(F.broadcast(recent)).withColumn("n", F.col("sessions") - F.col("affected"))  # one row each
    t = t.withColumn("now", F.try_divide("ten", "affected")).withColumn("base", F.try_divide(F.col("all") - F.col("ten"), F.col("n")))
    growth = F.try_divide(F.col("now") - F.col("base"), F.col("base"))
    return recommend(t, (F.col("n") >= 5) & (F.col("now") >= 50_000) & (growth >= 0.25), F.when(growth >= 0.5, "warning").otherwise("info"), "Recent sessions carry more context")


@rule("context.tool-call-right-sizing", "tool_calls")
def right_sizing(s: Signals) -> DataFrame:
    later = F.count(F.lit(1)).over(S.following(["session_id"], ["ord"]))
    excess = F.when((F.col("tool_name") == "Read") & (F.col("result_bytes") > 25_000), F.col("result_bytes") - 4_000).when(F.col("result_bytes") > 10_000, F.col("result_bytes") - 2_000)
    c = s.tool_calls.withColumn("tokens", excess / CHARS_PER_TOKEN * F.least(later, F.lit(40))).filter("tokens IS NOT NULL")
    t = c.agg(F.count(F.lit(1)).alias("affected"), F.sum("tokens").alias("tokens"))
    return recommend(t, (F.col("affected") >= 3) & (F.col("tokens") >= 1_000), "info", "Tool results are larger than needed and carried on")


@rule("context.cross-session-reread", "tool_calls")
def cross_session_reread(s: Signals) -> DataFrame:
    path = F.col("input.file_path")
    edited = s.tool_calls.filter(F.col("tool_name").isin(*EDIT_TOOLS)).select(path.alias("path")).distinct()
    first = s.tool_calls.filter("tool_name = 'Read'").groupBy("session_id", path.alias("path")).agg(F.min_by("result_bytes", "ord").alias("bytes")).filter("path IS NOT NULL").join(edited, "path", "left_anti")
    g = first.groupBy("path").agg(F.count(F.lit(1)).alias("sessions"), F.avg("bytes").alias("b")).filter("sessions >= 3").withColumn("tokens", F.col("b") / CHARS_PER_TOKEN * (0.8 * F.col("sessions") - 1))
    return recommend(with_evidence(g.agg(F.count(F.lit(1)).alias("affected")), g, "path", "tokens"), F.col("affected") > 0, "info", "The same documents are read anew in session after session", evidence="evidence")


# -- workflow ---------------------------------------------------------------------------------


@rule("workflow.native-bypass", "tool_calls")
def native_bypass(s: Signals) -> DataFrame:
    t = bash(s).filter(F.col("command").rlike(BYPASSED)).agg(F.count(F.lit(1)).alias("affected"))
    return recommend(t, F.col("affected") >= MIN_BYPASS, "info", "Shell commands do what a built-in tool does")


@rule("workflow.redundant-reads", "tool_calls")
def redundant_reads(s: Signals) -> DataFrame:
    g = s.tool_calls.filter("tool_name = 'Read' AND input.file_path IS NOT NULL").groupBy("session_id", F.col("input.file_path").alias("path")).agg(F.count(F.lit(1)).alias("n")).filter("n >= 3")
    return recommend(with_evidence(g.agg(F.count(F.lit(1)).alias("affected")), g, "path", "n"), F.col("affected") > 0, "info", "Files are read again in one session", evidence="evidence")


@rule("workflow.repeated-commands", "tool_calls")
def repeated_commands(s: Signals) -> DataFrame:
    g = bash(s).groupBy("session_id", "command").agg(F.count(F.lit(1)).alias("n")).filter("n >= 3").groupBy("command").agg(F.sum("n").alias("n"), F.count(F.lit(1)).alias("sessions"))
    return recommend(with_evidence(g.agg(F.count(F.lit(1)).alias("affected")), g, "command", "n"), F.col("affected") > 0, "info", "A command is run over and over", evidence="evidence")


@rule("workflow.file-churn", "tool_calls")
def file_churn(s: Signals) -> DataFrame:
    g = s.tool_calls.filter(F.col("tool_name").isin(*EDIT_TOOLS)).groupBy(F.col("input.file_path").alias("path")).agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") >= MIN_CHURN)
    return recommend(with_evidence(g.agg(F.count(F.lit(1)).alias("affected")), g, "path", "n"), F.col("affected") > 0, "info", "Files are edited again and again", evidence="evidence")


@rule("workflow.tool-undo-rate", "tool_calls")
def tool_undo_rate(s: Signals) -> DataFrame:
    w = Window.partitionBy("session_id").orderBy("ord").rowsBetween(1, 3)
    undone = F.max(F.col("input.command").rlike(r"\bgit\s+(?:checkout|restore|revert|reset)\b").cast("int")).over(w)
    t = s.tool_calls.withColumn("undone", undone).filter(F.col("tool_name").isin(*EDIT_TOOLS)).agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("undone") == 1).alias("affected"))
    return recommend(t, (F.col("n") >= 10) & (F.col("affected") >= 0.1 * F.col("n")), "warning", "Edits are undone right away")


@rule("workflow.low-tool-effectiveness", "tool_calls")
def low_tool_effectiveness(s: Signals) -> DataFrame:
    bad = F.max(F.coalesce("is_error", F.lit(False)).cast("int")).over(Window.partitionBy("session_id").orderBy("ord").rowsBetween(0, 3))
    g = s.tool_calls.withColumn("bad", bad).groupBy("tool_name").agg(F.count(F.lit(1)).alias("n"), ((F.count_if(F.col("bad") == 0) + 1) / (F.count(F.lit(1)) + 2)).alias("score")).filter("n >= 10 AND score < 0.4D")
    return recommend(with_evidence(g.agg(F.count(F.lit(1)).alias("affected")), g, "tool_name", "n"), F.col("affected") > 0, "warning", "A tool seldom helps", evidence="evidence")


@rule("workflow.correction-mining", "tool_calls")
def correction_mining(s: Signals) -> DataFrame:
    stem = F.regexp_extract("input.file_path", r"([^/]+?)(?:\.[^./]*)?$", 1)
    c = s.tool_calls.withColumn("stem", stem).filter(F.length("stem") >= 3)
    w = S.following(["session_id", "stem"], ["ord"])
    c = c.withColumn("fixed", F.min(F.when(~F.coalesce("is_error", F.lit(True)), F.col("ord"))).over(w)).filter("is_error AND fixed - ord <= 6")
    return recommend(c.agg(F.count(F.lit(1)).alias("affected")), F.col("affected") > 0, "info", "Failed paths that a later call got right")


@rule("workflow.procedural-memory", "tool_calls")
def procedural_memory(s: Signals) -> DataFrame:
    step = F.regexp_extract("command", r"^\s*([\w./-]+(?:\s+[a-z][\w-]*)?)", 1)
    grams = S.ngrams(bash(s).withColumn("step", step), ["session_id"], ["ord"], "step", range(3, 9), "gram")
    g = grams.filter(F.size(F.array_distinct(F.split("gram", ">"))) >= 2).groupBy("gram").agg(F.count_distinct("session_id").alias("sessions")).filter("sessions >= 3")
    return recommend(with_evidence(g.agg(F.count(F.lit(1)).alias("affected")), g, "gram", "sessions"), F.col("affected") > 0, "info", "A procedure recurs and could be a skill", evidence="evidence")


@rule("workflow.assistant-refusal-rate", "timeline")
def refusal_rate(s: Signals) -> DataFrame:
    refuses = F.lower("summary").rlike(r"\bi (?:can't|cannot|won't|am unable to)\b")
    t = s.timeline.filter("kind = 'assistant'").agg(F.count(F.lit(1)).alias("n"), F.count_if(refuses).alias("affected"))
    return recommend(t, (F.col("n") >= MIN_TURNS) & (F.col("affected") >= MAX_REFUSAL * F.col("n")), "warning", "The assistant often refuses")


@rule("workflow.session-restart-retype", "timeline", "sessions")
def restart_retype(s: Signals) -> DataFrame:
    """Sessions of a project that opened with nearly the words of another within a week; unattended ones re-use prompts by design."""
    from ..operators.retypes import retype_clusters

    opener = s.timeline.filter("kind = 'user'").groupBy("session_id").agg(F.min_by("summary", "ord").alias("opener"))
    rows = s.sessions.filter("NOT coalesce(unattended, false)").select("session_id", "project", S.micros("start_ts").alias("us")).join(opener, "session_id")
    g = retype_clusters(rows)
    t = with_evidence(g.agg(F.count(F.lit(1)).alias("affected")), g.groupBy("cluster").agg(F.count(F.lit(1)).alias("n")), "cluster", "n")
    return recommend(t, F.col("affected") >= 1, "info", "An opening is typed again in a new session", evidence="evidence")


@rule("workflow.mid-turn-interrupt-steering", "timeline")
def interrupts(s: Signals) -> DataFrame:
    t = s.timeline.filter("kind = 'user'").filter(F.col("summary").rlike(r"^\[Request interrupted by user")).agg(F.count(F.lit(1)).alias("affected"))
    return recommend(t, F.col("affected") >= 3, "info", "Turns are interrupted midway")


@rule("workflow.conversational-availability", "tool_calls")
def availability(s: Signals) -> DataFrame:
    blocked = (S.micros("result_ts") - S.micros("ts")) / 1e6
    c = bash(s).withColumn("s", blocked).filter((F.col("s") >= 10) & F.col("command").rlike(r"\b(?:test|build|install|deploy|lint)\b"))
    t = c.agg(F.count(F.lit(1)).alias("affected"), (F.sum("s") / 60).alias("minutes"))
    return recommend(t, F.col("affected") >= 3, F.when(F.col("minutes") >= 10, "warning").otherwise("info"), "Long commands block the conversation", minutes="minutes")


@rule("workflow.plan-missing-verification", "plans")
def plan_verification(s: Signals) -> DataFrame:
    t = s.plans.filter("NOT has_verification AND (file_refs >= 6 OR words >= 1000)").agg(F.count(F.lit(1)).alias("affected"))
    return recommend(t, F.col("affected") > 0, F.when(F.col("affected") >= 3, "warning").otherwise("info"), "Plans have no verification")


@rule("workflow.runaway-workflow-cost", "workflows")
def runaway_workflow(s: Signals) -> DataFrame:
    m = exact_quantiles(s.workflows, [], "tokens", [0.5]).select(F.col("q")[0].alias("median"), F.col("n").alias("runs"))
    t = s.workflows.join(F.broadcast(m)).filter("runs >= 4 AND tokens > 3 * median AND tokens > 200000").agg(F.count(F.lit(1)).alias("affected"))  # one row
    return recommend(t, F.col("affected") > 0, "warning", "A workflow run used far more than the others")


@rule("workflow.failed-workflow-runs", "workflows")
def failed_workflows(s: Signals) -> DataFrame:
    t = s.workflows.filter(F.lower("status").rlike("fail|error|abort")).agg(F.count(F.lit(1)).alias("affected"))
    return recommend(t, F.col("affected") > 0, "warning", "Workflow runs failed")


@rule("workflow.owner-concentration", "tasks")
def owner_concentration(s: Signals) -> DataFrame:
    g = s.tasks.filter("status <> 'completed' AND owner IS NOT NULL").groupBy("owner").agg(F.count(F.lit(1)).alias("n"))
    t = g.agg(F.sum("n").alias("all"), F.count(F.lit(1)).alias("owners"), F.max("n").alias("affected"), F.array(F.max_by("owner", F.struct("n", "owner"))).alias("evidence"))
    share = F.col("affected") / F.col("all")
    hard = (share >= 0.75) | (F.col("affected") >= 8)
    return recommend(t, (F.col("all") >= 6) & (F.col("owners") >= 2) & (F.col("affected") >= 4) & (share >= 0.6), F.when(hard, "warning").otherwise("info"), "One owner holds most open tasks", evidence="evidence")


@rule("workflow.blocked-task-pileup", "tasks")
def blocked_tasks(s: Signals) -> DataFrame:
    edges = s.tasks.filter("status <> 'completed'").select("session_id", F.explode("blocked_by").alias("root"))
    open_roots = s.tasks.filter("status <> 'completed'").select("session_id", F.col("task_id").alias("root"))
    g = edges.join(open_roots, ["session_id", "root"]).groupBy("session_id", "root").agg(F.count(F.lit(1)).alias("n")).filter("n >= 2")
    return recommend(g.agg(F.sum("n").alias("affected")), F.col("affected") >= 2, "info", "Tasks pile up behind one that is not done")


@rule("workflow.abandoned-tasks", "tasks")
def abandoned_tasks(s: Signals) -> DataFrame:
    g = s.tasks.groupBy("session_id").agg(F.max("mtime").alias("m"), F.count_if(F.col("status") != "completed").alias("n")).filter(F.col("m") <= s.since(7)).filter("n > 0")
    return recommend(g.agg(F.sum("n").alias("affected")), F.col("affected") > 0, "info", "Open tasks lie idle")


def _unused(kind: str, title: str) -> Callable[[Signals], DataFrame]:
    def run(s: Signals) -> DataFrame:
        g = s.installed.filter(F.col("kind") == kind).join(s.attribution.select("kind", "name").distinct(), ["kind", "name"], "left_anti").select("name").distinct()
        head = g.orderBy("name").limit(5).agg(F.array_sort(F.collect_list("name")).alias("evidence"))
        t = g.agg(F.count(F.lit(1)).alias("affected")).crossJoin(F.broadcast(head))  # one row each
        return recommend(t, F.col("affected") >= 3, "info", title, evidence="evidence")

    return run


for _kind, _named in (("skill", "skills"), ("agent", "subagents"), ("command", "commands"), ("plugin", "plugins")):
    rule(f"workflow.unused-installed-{_named}", "installed", "attribution")(_unused(_kind, f"Installed {_named} are not used"))


@rule("workflow.autonomy-over-steered", "steering")
def over_steered(s: Signals) -> DataFrame:
    t = s.steering.filter("success >= 0.9D").agg(F.count_if(F.col("corrections") >= 1).alias("affected"), X.pearson("corrections", "success").alias("r"))
    return recommend(t, F.col("affected") >= 3, "info", "Tasks that pass are steered all the same")


@rule("workflow.prompt-clarity", "steering")
def prompt_clarity(s: Signals) -> DataFrame:
    vague = F.col("specificity") < 0.5
    t = s.steering.agg(X.pearson(1 - F.col("specificity"), "corrections").alias("r"), (F.avg(F.when(vague, F.col("corrections"))) - F.avg(F.when(~vague, F.col("corrections")))).alias("gap"), F.count(F.lit(1)).alias("n"), F.count_if(vague).alias("affected"))
    return recommend(t, (F.col("n") >= 6) & (F.col("r") >= 0.45) & (F.col("gap") >= 1) & (F.col("affected") >= 2) & (F.col("n") - F.col("affected") >= 2), "info", "Vague prompts bring follow-ups")


# -- safety -----------------------------------------------------------------------------------


@rule("safety.dangerous-bypass", "tool_calls", "permission_rows")
def dangerous_bypass(s: Signals) -> DataFrame:
    free = s.permission_rows.filter("mode = 'bypassPermissions'").select("session_id")
    t = bash(s).filter(F.col("command").rlike(RISKY["critical"])).join(free, "session_id", "left_semi").agg(F.count(F.lit(1)).alias("affected"))
    return recommend(t, F.col("affected") > 0, "critical", "Dangerous commands run without permission checks")


@rule("safety.risky-actions", "tool_calls")
def risky_actions(s: Signals) -> DataFrame:
    kind = F.when(F.col("command").rlike(RISKY["critical"]), "critical").when(F.col("command").rlike(RISKY["warning"]), "warning")
    t = bash(s).withColumn("kind", kind).agg(F.count("kind").alias("affected"), F.count_if(F.col("kind") == "critical").alias("worst"))
    return recommend(t, F.col("affected") > 0, F.when(F.col("worst") > 0, "critical").otherwise("warning"), "Risky commands were run")


@rule("safety.prompt-friction", "tool_calls")
def prompt_friction(s: Signals) -> DataFrame:
    g = s.tool_calls.filter(F.col("tool_name").isin("Bash", *EDIT_TOOLS, "WebFetch")).groupBy("tool_name").agg(F.count(F.lit(1)).alias("n"))
    t = g.agg(F.max("n").alias("affected"), F.sum("n").alias("all"), F.array(F.max_by("tool_name", F.struct("n", "tool_name"))).alias("evidence"))
    return recommend(t, (F.col("affected") >= 20) & (F.col("affected") >= 0.25 * F.col("all")), "info", "One tool asks for permission most", evidence="evidence")


@rule("safety.continuation-blocked", "stop_hooks")
def continuation_blocked(s: Signals) -> DataFrame:
    t = s.stop_hooks.filter("preventedContinuation").filter(F.col("ts") >= s.since(7 * STALE_WEEKS)).agg(F.count(F.lit(1)).alias("affected"))
    return recommend(t, F.col("affected") >= 2, "info", "Hooks stopped sessions from going on")


@rule("safety.unattended-sessions", "tool_calls", "permission_rows", "sessions")
def unattended_sessions(s: Signals) -> DataFrame:
    free = s.sessions.filter("unattended").select("session_id").join(s.permission_rows.filter("mode = 'bypassPermissions'").select("session_id"), "session_id", "left_semi")
    t = bash(s).filter(F.col("command").rlike(RISKY["critical"])).join(free, "session_id", "left_semi").agg(F.count_distinct("session_id").alias("affected"))
    return recommend(t, F.col("affected") > 0, "critical", "Unattended sessions run dangerous commands freely")


@rule("safety.allow-rule-overlaps-deny", "permission_rules")
def allow_overlaps_deny(s: Signals) -> DataFrame:
    of = lambda kind, name: s.permission_rules.filter(F.col("kind") == kind).select(F.regexp_replace("rule", r":?\*?\)?$", "").alias(name))
    t = of("allow", "a").join(of("deny", "d"), F.col("a").startswith(F.col("d"))).agg(F.count_distinct("a").alias("affected"))
    return recommend(t, F.col("affected") > 0, "info", "Allow rules that a deny rule shadows")


@rule("safety.deny-rule-never-triggered", "permission_rules", "tool_calls")
def idle_deny_rule(s: Signals) -> DataFrame:
    deny = s.permission_rules.filter("kind = 'deny'").select(F.regexp_replace("rule", r":?\*?\)?$", "").alias("d"))
    calls = s.tool_calls.select(F.concat("tool_name", F.lit("("), F.coalesce("input.command", F.lit(""))).alias("call"))
    met = calls.join(F.broadcast(deny.distinct()), F.col("call").startswith(F.col("d"))).select("d").distinct()  # the rules a settings file denies by, a few dozen
    idle = deny.join(met, "d", "left_anti")
    kept = s.tool_calls.agg(F.count(F.lit(1)).alias("n"), F.min("ts").alias("since"))
    t = idle.agg(F.count(F.lit(1)).alias("affected")).crossJoin(F.broadcast(kept))  # one row each
    return recommend(t, (F.col("affected") > 0) & (F.col("n") >= 20) & (F.col("since") <= s.since(14)), "info", "Deny rules that nothing meets")


# -- reliability ------------------------------------------------------------------------------


@rule("reliability.tool-errors", "tool_calls")
def tool_errors(s: Signals) -> DataFrame:
    g = s.tool_calls.groupBy("tool_name").agg(F.count_if("is_error").alias("bad"), F.count(F.lit(1)).alias("n")).filter((F.col("n") >= MIN_CALLS) & (F.col("bad") >= MIN_ERROR_RATE * F.col("n")))
    return recommend(with_evidence(g.agg(F.count(F.lit(1)).alias("tools"), F.sum("bad").alias("affected")), g, "tool_name", "bad"), F.col("tools") > 0, "warning", "Tools fail often", evidence="evidence")


@rule("reliability.api-errors", "api_errors")
def api_errors(s: Signals) -> DataFrame:
    t = s.api_errors.filter(F.col("ts") >= s.since(30)).filter(~F.coalesce(F.col("status").isin(*RATE_LIMITS), F.lit(False))).groupBy("status").agg(F.count(F.lit(1)).alias("affected"))
    return recommend(t.withColumn("evidence", F.array(F.coalesce(F.col("status").cast("string"), F.lit("unknown")))), F.col("affected") > 0, "warning", "The service returned errors", evidence="evidence")


@rule("reliability.rate-limits", "api_errors")
def rate_limits(s: Signals) -> DataFrame:
    t = s.api_errors.filter(F.col("ts") >= s.since(30)).filter(F.col("status").isin(*RATE_LIMITS)).agg(F.count(F.lit(1)).alias("affected"))
    return recommend(t, F.col("affected") > 0, "warning", "Calls ran into rate limits")


@rule("reliability.retry-storms", "tool_calls")
def retry_storms(s: Signals) -> DataFrame:
    runs = S.islands(s.tool_calls.withColumn("us", S.micros("ts")), ["session_id"], ["ord"], ["tool_name"], "us", 60_000_000)
    g = runs.groupBy("session_id", "island", "tool_name").agg(F.count(F.lit(1)).alias("n"), F.count_if("is_error").alias("bad")).filter((F.col("n") >= MIN_RETRIES) & (F.col("bad") > 0))
    return recommend(with_evidence(g.agg(F.count(F.lit(1)).alias("affected")), g, "tool_name", "n"), F.col("affected") > 0, "warning", "A failing call is repeated at once", evidence="evidence")


@rule("reliability.overload-reretry", "api_errors", "token_entries")
def overload_reretry(s: Signals) -> DataFrame:
    e = s.api_errors.filter(F.col("status").isin(*RATE_LIMITS) & (F.col("retryAttempt") > 1)).select("session_id", S.micros("ts").alias("us"), F.col("seq").alias("id"))
    t = s.token_entries.select("session_id", S.micros("ts").alias("us"), "cache_read")
    first = S.asof(t, e.select("session_id", F.col("us").alias("e_us"), "id"), ["session_id"], "us", "e_us", "id", out="b")
    near = S.asof(first, e.select("session_id", F.col("us").alias("f_us"), F.col("id").alias("id2")), ["session_id"], "us", "f_us", "id2", forward=True, out="f")
    hit = near.filter((F.col("us") - F.col("b_time") <= 90_000_000) | (F.col("f_time") - F.col("us") <= 90_000_000))
    return recommend(hit.agg(F.sum("cache_read").alias("affected")), F.col("affected") > 0, "info", "Context was sent again while the service was overloaded")


@rule("reliability.hook-errors", "stop_hooks")
def hook_errors(s: Signals) -> DataFrame:
    return recommend(s.stop_hooks.filter("errors > 0").agg(F.count(F.lit(1)).alias("affected")), F.col("affected") >= 3, "warning", "Stop hooks report errors")


@rule("reliability.hook-prevented-continuation", "stop_hooks")
def hook_prevented(s: Signals) -> DataFrame:
    return recommend(s.stop_hooks.filter("preventedContinuation").agg(F.count(F.lit(1)).alias("affected")), F.col("affected") >= 5, "info", "Stop hooks often keep a session from going on")


@rule("reliability.passive-wait-stall", "timeline")
def passive_wait(s: Signals) -> DataFrame:
    w = Window.partitionBy("session_id").orderBy("ord")
    said = F.last(F.when(F.col("kind") == "assistant", F.struct("summary", "ts")), ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, -1))
    c = s.timeline.withColumn("said", said).filter("kind = 'user'").withColumn("gap", (S.micros("ts") - S.micros("said.ts")) / 1e6)
    c = c.filter((F.col("gap") >= 60) & F.lower("said.summary").rlike(r"\b(?:wait(?:ing)?|let me know when|once (?:it|that) (?:is|finishes))\b"))
    t = c.agg(F.count(F.lit(1)).alias("affected"), F.max("gap").alias("worst"), (F.sum("gap") / 60).alias("minutes"))
    return recommend(t, F.col("affected") >= 3, F.when(F.col("worst") >= 300, "warning").otherwise("info"), "Sessions stall on waiting", minutes="minutes")


@rule("reliability.stale-state-assertion", "tool_calls")
def stale_state(s: Signals) -> DataFrame:
    fetch = F.when(F.col("command").rlike(r"\bgit\s+(?:fetch|pull)\b"), S.micros("ts"))
    w = Window.partitionBy("session_id").orderBy("ord").rowsBetween(Window.unboundedPreceding, 0)
    c = bash(s).withColumn("fetched", F.last(fetch, ignorenulls=True).over(w)).filter(F.col("command").rlike(r"\borigin/(?:main|master|develop)\b"))
    t = c.filter(F.col("fetched").isNull() | (S.micros("ts") - F.col("fetched") > 30 * 60_000_000)).agg(F.count(F.lit(1)).alias("affected"))
    return recommend(t, F.col("affected") >= 3, "info", "Remote branches are read without a fresh fetch")


@rule("reliability.cwd-drift-execution", "tool_calls")
def cwd_drift(s: Signals) -> DataFrame:
    t = bash(s).select("session_id", F.explode(F.split("command", r"&&|;|\|\|")).alias("part")).filter(F.col("part").rlike(r"^\s*(?:git|gh)\s") & ~F.col("part").rlike(r"\s-C\s")).groupBy("session_id").agg(F.count(F.lit(1)).alias("n"))
    return recommend(t.agg(F.sum("n").alias("affected"), F.max("n").alias("most")), F.col("affected") >= 3, F.when(F.col("most") >= 10, "warning").otherwise("info"), "Repository commands depend on the current folder")


@rule("reliability.ghost-session", "tool_calls", "sessions")
def ghost_session(s: Signals) -> DataFrame:
    g = s.tool_calls.groupBy("session_id").agg(F.count_distinct(F.when((F.col("tool_name") == "Read") & ~F.coalesce("is_error", F.lit(True)), F.col("input.file_path"))).alias("files"), F.count_if(F.col("tool_name").isin(*EDIT_TOOLS)).alias("edits"))
    g = g.filter("files >= 5 AND edits = 0").join(s.sessions.filter(F.col("end_ts") <= s.since(1 / 48)), "session_id")
    return recommend(g.agg(F.count(F.lit(1)).alias("affected")), F.col("affected") > 0, F.when(F.col("affected") >= 3, "warning").otherwise("info"), "Sessions read much and changed nothing")


@rule("reliability.workflow-ratelimit-burst", "workflows")
def workflow_burst(s: Signals) -> DataFrame:
    t = s.workflows.agg(F.max("rate_limited").alias("affected"))
    return recommend(t, F.col("affected") >= 3, F.when(F.col("affected") >= 10, "critical").otherwise("warning"), "A workflow's agents hit rate limits together")


# -- speed and activity -----------------------------------------------------------------------


@rule("speed.hook-overhead", "stop_hooks")
def hook_overhead(s: Signals) -> DataFrame:
    t = s.stop_hooks.filter(F.col("timed_ms").isNotNull() & (F.col("ts") >= s.since(7 * STALE_WEEKS))).agg(F.avg("timed_ms").alias("mean"), F.count(F.lit(1)).alias("affected"), (F.sum("timed_ms") / 60_000).alias("minutes"))
    return recommend(t, (F.col("affected") >= 5) & (F.col("mean") >= 2_000), F.when(F.col("mean") >= 5_000, "warning").otherwise("info"), "Hooks slow every turn", minutes="minutes")


@rule("speed.model-latency", "latency")
def model_latency(s: Signals) -> DataFrame:
    g = s.latency.groupBy("model").agg((F.sum("api_ms") / F.sum("output_tokens")).alias("rate"), F.sum("output_tokens").alias("n"), F.count(F.lit(1)).alias("samples"), F.sum("api_ms").alias("ms")).filter("samples >= 2 AND n >= 500")
    g = g.withColumn("best", F.min("rate").over(Window.partitionBy())).withColumn("minutes", (F.col("rate") - F.col("best")) * F.col("n") / 60_000)
    slow = g.filter("rate >= 1.5D * best AND rate - best >= 10 AND ms >= 60000 AND minutes >= 1")
    t = slow.agg(F.count(F.lit(1)).alias("affected"), F.sum("minutes").alias("minutes"))
    return recommend(t, F.col("affected") > 0, F.when(F.col("minutes") >= 10, "warning").otherwise("info"), "A model answers slower than another", minutes="minutes")


@rule("speed.serial-tool-gap", "tool_calls")
def serial_tools(s: Signals) -> DataFrame:
    w = Window.partitionBy("session_id").orderBy("ord")
    words = F.split(F.lower(F.coalesce("input_json", F.lit(""))), "[^a-z0-9]+")
    long = F.filter(words, lambda x: (F.length(x) >= 3) & ~x.isin("file", "path", "command", "pattern"))
    c = s.tool_calls.withColumn("w", long).withColumn("reads", F.col("tool_name").isin("Read", "Grep", "Glob"))
    c = c.withColumn("was", F.lag("reads").over(w)).withColumn("v", F.lag("w").over(w)).filter(F.expr("reads AND was AND NOT arrays_overlap(w, v)"))
    return recommend(c.agg(F.count(F.lit(1)).alias("affected")), F.col("affected") >= 3, F.when(F.col("affected") >= 50, "warning").otherwise("info"), "Independent reads run one after the other")


@rule("speed.time-motion", "turns")
def time_motion(s: Signals) -> DataFrame:
    t = s.turns.filter("durationMs > 0").agg((F.sum("durationMs") / 60_000).alias("minutes"), F.count(F.lit(1)).alias("affected"))
    return recommend(t, F.col("minutes") >= 5, F.when(F.col("minutes") >= 30, "warning").otherwise("info"), "Where the wall clock goes", minutes="minutes")


@rule("activity.stale-projects", "sessions")
def stale_projects(s: Signals) -> DataFrame:
    g = s.sessions.filter("project IS NOT NULL").groupBy("project").agg(F.count(F.lit(1)).alias("n"), F.max("end_ts").alias("last")).filter((F.col("n") >= MIN_SESSIONS) & (F.col("last") < s.since(7 * STALE_WEEKS)))
    return recommend(with_evidence(g.agg(F.count(F.lit(1)).alias("affected")), g, "project", "n"), F.col("affected") > 0, "info", "Projects have gone quiet", evidence="evidence")


@rule("activity.activity-trend", "daily")
def activity_trend(s: Signals) -> DataFrame:
    from ..operators.rollups import versus_prior

    t = versus_prior(s.daily, "day", "tool_calls", 7)
    return recommend(t, F.col("change") >= 0.5, "info", "Activity rose by half within a week", F.col("current"))


@rule("security.secrets-at-rest", "timeline")
def secrets_at_rest(s: Signals) -> DataFrame:
    from ..operators.text import may_hold_secret, secret_counts

    kinds = secret_counts("summary")
    t = s.timeline.filter(may_hold_secret("summary")).select(sum(kinds[1:], kinds[0]).alias("n")).agg(F.sum("n").alias("affected"))
    return recommend(t, F.col("affected") > 0, "critical", "Secrets lie in transcripts")


# -- all together -----------------------------------------------------------------------------


def evaluate(s: Signals, rules: list[Rule] | None = None) -> DataFrame:
    """The rows of every rule whose tables are there, unranked.

    Each rule is a small job of its own over the shared tables and yields a few rows at most
    (totals, with up to five labels as evidence), so the jobs run side by side and their rows are
    put together on the driver; one plan that unites them all would be planned for longer than it runs.
    """
    chosen = [r for r in (rules if rules is not None else RULES) if s.has(*r.needs)]
    rank = F.create_map(*[F.lit(x) for kv in RANK.items() for x in kv])
    plans = [
        r.run(s).select(
            F.lit(r.id).alias("id"), F.lit(r.id.split(".")[0]).alias("category"), "severity", rank[F.col("severity")].alias("severity_rank"), "title", "est_savings_usd", "est_minutes", "affected", "evidence",
            F.lit(r.order).alias("emit_order"),
        )
        for r in chosen
    ]
    spark = next(iter(s.tables.values())).sparkSession
    with ThreadPoolExecutor(SIDE_BY_SIDE) as pool:
        found = [row for rows in pool.map(lambda p: p.collect(), plans) for row in rows]
    out = spark.createDataFrame(found, RECOMMENDATION)
    return out.join(answered(s.live_config), "id", "left_anti").select(*out.columns) if s.has("live_config") else out


def ranked(recommendations: DataFrame, rejected: DataFrame | None = None) -> DataFrame:
    """Without rejected ids; by severity, dollars, whether there are any, minutes, affected, order of the rules."""
    rows = recommendations if rejected is None else recommendations.join(rejected.select("id"), "id", "left_anti")
    return rows.orderBy(
        F.desc("severity_rank"), F.coalesce("est_savings_usd", F.lit(0.0)).desc(), F.col("est_savings_usd").isNull(), F.coalesce("est_minutes", F.lit(0.0)).desc(),
        F.coalesce("affected", F.lit(0)).desc(), "emit_order", F.array_join("evidence", ","),
    )


def coverage(s: Signals) -> list[tuple[str, str]]:
    """Each rule and whether it is on or dark."""
    return [(r.id, "on" if s.has(*r.needs) else "dark") for r in RULES]


def build(s: Signals, rejected: DataFrame | None = None, rules: list[Rule] | None = None) -> DataFrame:
    return ranked(evaluate(s.prepared(), rules), rejected)


def cascade(claims: DataFrame, bill: DataFrame) -> DataFrame:
    """Savings without double counting: claims on one scope apply in order, each to what the earlier ones left.

    claims: scope, ord, fraction (0 to 1); bill: scope, usd. The product of what earlier claims left is
    a running sum of logarithms; the marginals of a scope add up to its bill's drop.
    """
    w = Window.partitionBy("scope").orderBy("ord").rowsBetween(Window.unboundedPreceding, -1)
    safe = F.greatest(F.lit(1e-300), 1 - F.col("fraction"))
    left = F.exp(F.coalesce(F.sum(F.log(safe)).over(w), F.lit(0.0)))
    return claims.join(bill, "scope").withColumn("marginal", F.col("usd") * left * F.col("fraction"))


def paired_proof(pairs: DataFrame, min_pairs: int = 12) -> DataFrame:
    """The verdict on a paired experiment: control against treatment cost."""
    return X.signed_rank_test(pairs.withColumn("delta", F.col("treatment") - F.col("control")), "delta", min_pairs)
