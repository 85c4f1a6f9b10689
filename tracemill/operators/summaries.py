"""Summaries of session tables: files, commands, agents, errors, teams, workflow runs, windows, findings.

Inputs are the tables of `sources.transcripts` and `sources.artifacts`; every function is one
grouped aggregation (or one join of two such), so what moves is a row a group and map task.
"""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import scalars as C
from .sequences import micros

# -- files and commands -----------------------------------------------------------------------


def file_stats(calls: DataFrame, path: str = "input.file_path", reads=("Read",), edits=("Edit", "MultiEdit", "NotebookEdit"), writes=("Write",)) -> DataFrame:
    """path with its reads, edits, writes and sessions."""
    among = lambda names: F.count_if(F.col("tool_name").isin(*names))
    rows = calls.select(F.col(path).alias("path"), "tool_name", "session_id").filter(F.col("path").isNotNull() & F.col("tool_name").isin(*reads, *edits, *writes))
    return rows.groupBy("path").agg(among(reads).alias("reads"), among(edits).alias("edits"), among(writes).alias("writes"), F.count_distinct("session_id").alias("sessions"))


def dir_stats(files: DataFrame) -> DataFrame:
    """`file_stats` by folder; files without one belong to `.`."""
    folder = F.coalesce(F.nullif(C.dirname("path"), F.lit("")), F.lit("."))
    return files.groupBy(folder.alias("dir")).agg(F.count(F.lit(1)).alias("files"), *[F.sum(c).alias(c) for c in ("reads", "edits", "writes")])


def read_only_files(files: DataFrame) -> DataFrame:
    """Files that were read and never changed."""
    return files.filter("edits + writes = 0 AND reads > 0")


def fingerprint(command: str | Column) -> Column:
    """A command without what varies from call to call: quoted text, numbers, paths, white space."""
    c = C.unquoted(command)
    for pattern, mark in ((r"(?:\.{0,2}/)[\w./-]+", "<path>"), (r"\b[0-9a-f]{7,40}\b", "<id>"), (r"\b[0-9]+\b", "<n>"), (r"\s+", " ")):
        c = F.regexp_replace(c, pattern, mark)
    return F.trim(c)


def top_commands(calls: DataFrame, k: int = 10, command: str = "input.command") -> DataFrame:
    """A top-k report: the k commonest command shapes, how often and in how many sessions."""
    g = calls.filter(F.col(command).isNotNull()).groupBy(fingerprint(command).alias("command")).agg(F.count(F.lit(1)).alias("n"), F.count_distinct("session_id").alias("sessions"))
    return g.orderBy(F.desc("n"), "command").limit(k)


def by_program(calls: DataFrame, k: int = 15, command: str = "input.command") -> DataFrame:
    """A top-k report: calls by the first word of their command, with the distinct second words."""
    first, second = F.regexp_extract(command, r"^\s*(\S+)", 1), F.nullif(F.regexp_extract(command, r"^\s*\S+\s+([^\s-]\S*)", 1), F.lit(""))
    g = calls.filter(F.col(command).isNotNull()).groupBy(first.alias("program")).agg(F.count(F.lit(1)).alias("n"), F.count_distinct(second).alias("subcommands"))
    return g.orderBy(F.desc("n"), "program").limit(k)


def bypass_by_session(calls: DataFrame, bypassed: str, command: str = "input.command") -> DataFrame:
    """Sessions with shell commands that a built-in tool would do: how many, and the bytes they returned."""
    rows = calls.filter(F.col(command).rlike(bypassed))
    return rows.groupBy("session_id").agg(F.count(F.lit(1)).alias("calls"), F.coalesce(F.sum("result_bytes"), F.lit(0)).alias("bytes"))


def correction_groups(facts: DataFrame) -> DataFrame:
    """Equal corrections (category, failed, succeeded) with how often and when last."""
    return facts.groupBy("category", "failed", "succeeded").agg(F.count(F.lit(1)).alias("n"), F.count_distinct("session_id").alias("sessions"), F.max("ts").alias("last"))


# -- agents, errors, permissions --------------------------------------------------------------


def agent_invocations(calls: DataFrame, tools=("Task", "Agent"), name: str = "input.subagent_type") -> DataFrame:
    """Agent types with calls, failures and sessions; a call that names none is `(unspecified)`."""
    g = calls.filter(F.col("tool_name").isin(*tools)).groupBy(F.coalesce(F.col(name), F.lit("(unspecified)")).alias("name"))
    return g.agg(F.count(F.lit(1)).alias("calls"), F.count_if("is_error").alias("errors"), F.count_distinct("session_id").alias("sessions"))


def skill_invocations(calls: DataFrame, tool: str = "Skill", name: str = "input.skill") -> DataFrame:
    return agent_invocations(calls.filter(F.col(name).isNotNull()), (tool,), name)


def api_error_statuses(errors: DataFrame) -> DataFrame:
    """code (status, else cause, else `unknown`), whether it is an HTTP status, events and sessions."""
    code = F.coalesce(F.col("status").cast("string"), F.col("cause_code"), F.lit("unknown"))
    return errors.groupBy(code.alias("code")).agg(F.bool_or(F.col("status").isNotNull()).alias("http"), F.count(F.lit(1)).alias("n"), F.count_distinct("session_id").alias("sessions"))


def retry_pressure(errors: DataFrame) -> DataFrame:
    """One row: events that were retried, time waited, the deepest attempt and the cap."""
    rows = errors.filter("retryAttempt IS NOT NULL OR retryInMs IS NOT NULL")
    return rows.agg(F.count(F.lit(1)).alias("events"), F.coalesce(F.sum("retryInMs"), F.lit(0.0)).alias("waited_ms"), F.coalesce(F.max("retryAttempt"), F.lit(0)).alias("deepest"), F.max("maxRetries").alias("cap"))


def safety_scores(dangerous: DataFrame, permission_rows: DataFrame) -> DataFrame:
    """Sessions with dangerous calls (session_id) or a permission mode: how many, whether checks were off, the modes."""
    d = dangerous.groupBy("session_id").agg(F.count(F.lit(1)).alias("dangerous"))
    m = permission_rows.groupBy("session_id").agg(F.bool_or(F.col("mode") == "bypassPermissions").alias("bypass"), F.array_join(F.array_sort(F.collect_set("mode")), ",").alias("modes"))  # the few modes there are
    return d.join(m, "session_id", "full").select("session_id", F.coalesce("dangerous", F.lit(0)).alias("dangerous"), F.coalesce("bypass", F.lit(False)).alias("bypass"), F.coalesce("modes", F.lit("")).alias("modes"))


def policy_additions(selected: DataFrame, present: DataFrame) -> DataFrame:
    """Chosen rules (rule, action) that the settings do not have yet."""
    return selected.distinct().join(present.select("rule", "action"), ["rule", "action"], "left_anti")


# -- teams, workflow runs, steering -----------------------------------------------------------


def team_summary(assignments: DataFrame, now: dt.datetime, grace_minutes: int = 10) -> DataFrame:
    """team, agent: assignments, those unread beyond the grace time, and whether the agent is stalled (all of its are)."""
    old = F.col("at") <= F.lit(now - dt.timedelta(minutes=grace_minutes))
    g = assignments.groupBy("team", "agent").agg(F.count(F.lit(1)).alias("n"), F.count_if(~F.col("read") & old).alias("dropped"))
    return g.withColumn("stalled", F.col("n") == F.col("dropped"))


def phase_totals(agents: DataFrame) -> DataFrame:
    """run_id, phase: agents, tokens, start, end and span; an end counts where start and duration are known."""
    end = F.col("started_ms") + F.col("duration_ms")
    g = agents.groupBy("run_id", "phase").agg(F.count(F.lit(1)).alias("agents"), F.coalesce(F.sum("tokens"), F.lit(0)).alias("tokens"), F.min("started_ms").alias("start_ms"), F.max(end).alias("end_ms"))
    return g.withColumn("span_ms", F.col("end_ms") - F.col("start_ms"))


def run_bars(agents: DataFrame) -> DataFrame:
    """agents with their offset from the run's first start, their length, and the run's span (at least 1)."""
    run = Window.partitionBy("run_id")
    start, end = F.min("started_ms").over(run), F.max(F.col("started_ms") + F.coalesce("duration_ms", F.lit(0))).over(run)
    timed = F.col("started_ms").isNotNull()
    return agents.withColumn("offset_ms", F.when(timed, F.col("started_ms") - start).otherwise(F.lit(0))).withColumn("length_ms", F.when(timed, F.coalesce("duration_ms", F.lit(0))).otherwise(F.lit(0))).withColumn(
        "span_ms", F.greatest(F.lit(1), F.coalesce(end - start, F.lit(0)))
    )


def steer_totals(records: DataFrame) -> DataFrame:
    """rule: nudges delivered, accepted, declined, the share declined as misfires, and the last one."""
    g = records.groupBy("rule").agg(*[F.count_if(F.col("event") == e).alias(e) for e in ("delivered", "accepted", "declined")], F.max("ts").alias("last"))
    return g.withColumn("misfire_rate", F.try_divide("declined", F.col("delivered")))


# -- sessions ---------------------------------------------------------------------------------

#: Trailing windows in days, and the bounds of a session's type.
WINDOWS = {"day": 1, "week": 7, "fortnight": 14, "month": 30}


def trailing_windows(sessions: DataFrame, now: dt.datetime, start: str = "start_ts", windows: dict[str, int] = WINDOWS) -> DataFrame:
    """window: sessions, projects, messages, calls and spend of those that began within it. A session goes into each window it is in; the widest is filtered first."""
    age = (F.lit(now).cast("timestamp").cast("double") - F.col(start).cast("timestamp").cast("double")) / 86_400
    inside = F.filter(F.array(*[F.struct(F.lit(n).alias("window"), F.lit(d).alias("days")) for n, d in windows.items()]), lambda w: w["days"] >= F.col("_age"))
    rows = sessions.withColumn("_age", age).filter((F.col("_age") >= 0) & (F.col("_age") <= max(windows.values())))
    return rows.select("*", F.explode(inside).alias("_w")).groupBy(F.col("_w.window").alias("window")).agg(
        F.count(F.lit(1)).alias("sessions"), F.count_distinct("project").alias("projects"), F.sum("messages").alias("messages"), F.sum("cost").alias("cost")
    )


def session_type(turns: str | Column, duration_ms: str | Column, explores: str | Column, acts: str | Column, quick_ms: int = 300_000, long_ms: int = 3_600_000, many: int = 10) -> Column:
    """The shape of a session: quick_question, multi_task, exploration or single_task."""
    t, d, e, a = (F.col(c) if isinstance(c, str) else c for c in (turns, duration_ms, explores, acts))
    return F.when((t <= 1) & (d < quick_ms), "quick_question").when((t >= many) | (d >= long_ms), "multi_task").when(e > a, "exploration").otherwise("single_task")


def spend_by_type(spend: DataFrame, types: DataFrame) -> DataFrame:
    """type: sessions, tokens and dollars; sessions without a type are `uncategorized`."""
    j = spend.join(types, "session_id", "left")
    return j.groupBy(F.coalesce("type", F.lit("uncategorized")).alias("type")).agg(F.count(F.lit(1)).alias("sessions"), F.sum("tokens").alias("tokens"), F.sum("cost").alias("cost"))


def entry_shares(registry: DataFrame) -> DataFrame:
    """cwd, entrypoint: sessions, their share of the folder's, and whether the folder is thin (two at most), settled (0.7 or more) or mixed."""
    g = registry.groupBy("cwd", "entrypoint").agg(F.count(F.lit(1)).alias("n"))
    all_ = F.sum("n").over(Window.partitionBy("cwd"))
    return g.withColumn("share", F.col("n") / all_).withColumn("bucket", F.when(all_ <= 2, "thin").when(F.col("share") >= 0.7, "settled").otherwise("mixed"))


def observed_days(sessions: DataFrame, now: dt.datetime, window_days: int) -> DataFrame:
    """One row: the days that the retained sessions really cover, at most the window."""
    first = F.datediff(F.lit(now), F.min("start_ts"))
    return sessions.agg(F.least(F.lit(window_days), first).alias("days"))


def unused_resources(installed: DataFrame, used: DataFrame) -> DataFrame:
    """kind: installed resources and those never used."""
    seen = used.select("kind", "name").distinct().withColumn("_used", F.lit(True))
    j = installed.select("kind", "name").distinct().join(seen, ["kind", "name"], "left")
    return j.groupBy("kind").agg(F.count(F.lit(1)).alias("installed"), F.count_if(F.col("_used").isNull()).alias("unused"))


# -- findings ---------------------------------------------------------------------------------


def top_per_domain(findings: DataFrame) -> DataFrame:
    """The first finding of each category by severity, dollars, minutes and order."""
    w = Window.partitionBy("category").orderBy(F.desc("severity_rank"), F.coalesce("est_savings_usd", F.lit(0.0)).desc(), F.coalesce("est_minutes", F.lit(0.0)).desc(), "emit_order")
    return findings.withColumn("_n", F.row_number().over(w)).filter("_n = 1").drop("_n")


def monthly(savings: DataFrame, ts: str = "ts", usd: str = "saving_usd") -> DataFrame:
    """One row: observed savings carried to thirty days by the span they cover (a day at least)."""
    days = F.greatest(F.lit(1.0), (micros(F.max(ts)) - micros(F.min(ts))) / 86_400e6)
    return savings.agg(F.sum(usd).alias("observed"), (F.sum(usd) / days * 30).alias("monthly"))


def capability_gaps(usage: DataFrame, installed: DataFrame, least: int = 3) -> DataFrame:
    """capability: how often work asked for it (at least `least`) while nothing installed has it."""
    g = usage.groupBy("capability").agg(F.count(F.lit(1)).alias("n"), F.count_distinct("session_id").alias("sessions")).filter(F.col("n") >= least)
    return g.join(installed.select("capability").distinct(), "capability", "left_anti")


def one_hot(df: DataFrame, factors: list[str], least: int) -> tuple[DataFrame, list[str]]:
    """df with a 0/1 column for each level of the factors that at least `least` rows have, and their names; the commonest level of each is the reference and has none.

    Levels are counted in one pass each; what comes to the driver is a row a frequent level.
    """
    names, columns = [], []
    for f in factors:
        levels = df.groupBy(f).agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") >= least).orderBy(F.desc("n"), f).collect()
        for level in [r[f] for r in levels[1:] if r[f] is not None]:
            names.append(f"{f}={level}")
            columns.append((F.col(f) == F.lit(level)).cast("double").alias(f"{f}={level}"))
    return df.select("*", *columns), names


def induced_edges(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """Edges whose ends are both among the nodes."""
    ends = nodes.select("node").distinct()
    return edges.join(ends.withColumnRenamed("node", "src"), "src", "left_semi").join(ends.withColumnRenamed("node", "dst"), "dst", "left_semi")


# -- the bill, the edits, the experiments ------------------------------------------------------

#: The buckets of a bill's composition.
BUCKETS = ("prefix", "history", "payloads", "residual", "thinking", "visible")


def composition(sessions: DataFrame) -> DataFrame:
    """Each session's billed tokens in six buckets, and the dollars of each.

    sessions: session_id, messages, prefix_tokens (of the static prefix, a turn), history, payloads,
    billed_input, billed_output, thinking, input_cost, output_cost. What prefix, history and tool
    payloads make up is scaled down where it exceeds the billed input and leaves a residual where it
    falls short, so the buckets always add up to the bill; dollars follow the tokens of their side.
    """
    raw = {"prefix": F.greatest(F.lit(0.0), F.col("prefix_tokens") * F.col("messages").cast("double")), "history": F.greatest(F.lit(0.0), F.coalesce("history", F.lit(0)).cast("double")), "payloads": F.greatest(F.lit(0.0), F.coalesce("payloads", F.lit(0)).cast("double"))}
    rows = sessions.select("session_id", "billed_input", "billed_output", "input_cost", "output_cost", F.least(F.greatest(F.lit(0), F.coalesce("thinking", F.lit(0))), F.col("billed_output")).cast("double").alias("thinking"), *[c.alias(f"_{k}") for k, c in raw.items()])
    whole = F.col("_prefix") + F.col("_history") + F.col("_payloads")
    scale = F.when(whole > F.col("billed_input"), F.col("billed_input") / whole).otherwise(F.lit(1.0))
    rows = rows.select("session_id", "billed_input", "billed_output", "input_cost", "output_cost", "thinking", *[(F.col(f"_{k}") * scale).alias(k) for k in raw], F.greatest(F.lit(0.0), F.col("billed_input") - whole).alias("residual"))
    rows = rows.withColumn("visible", F.col("billed_output") - F.col("thinking"))
    side = lambda k: ("input_cost", "billed_input") if k in ("prefix", "history", "payloads", "residual") else ("output_cost", "billed_output")
    return rows.select("session_id", *BUCKETS, *[F.coalesce(F.try_divide(F.col(k) * F.col(side(k)[0]), F.col(side(k)[1])), F.lit(0.0)).alias(f"{k}_usd") for k in BUCKETS])


def churn_geometry(edits: DataFrame) -> DataFrame:
    """session_id, file: tasks, edits, gross and net lines, ranges edited again (also by a later task), and gross by net lines.

    edits: session_id, file, task, range (null where the patch is empty), gross, net.
    """
    ranges = edits.filter("range IS NOT NULL").groupBy("session_id", "file", "range").agg(F.count(F.lit(1)).alias("n"), F.count_distinct("task").alias("tasks")).filter("n >= 2")
    again = ranges.groupBy("session_id", "file").agg(F.count(F.lit(1)).alias("again"), F.count_if(F.col("tasks") > 1).alias("later"))
    g = edits.groupBy("session_id", "file").agg(F.count_distinct("task").alias("tasks"), F.count(F.lit(1)).alias("edits"), F.sum("gross").alias("gross"), F.sum("net").alias("net"))
    g = g.join(again, ["session_id", "file"], "left").withColumn("again", F.coalesce("again", F.lit(0))).withColumn("later", F.coalesce("later", F.lit(0)))
    return g.withColumn("distance", F.round(F.col("gross") / F.greatest(F.lit(1), F.abs("net")), 1))


def domain_coverage(needs: DataFrame, present: DataFrame) -> DataFrame:
    """domain: PROVE where every input is there, INFER where some are missing, CANNOT_SEE where no core one is. needs: domain, input, core; present: input."""
    j = needs.join(present.select("input").distinct().withColumn("_there", F.lit(True)), "input", "left")
    g = j.groupBy("domain").agg(F.count_if("core").alias("core"), F.count_if(F.col("core") & F.col("_there").isNotNull()).alias("core_there"), F.count_if(F.col("_there").isNull()).alias("missing"))
    return g.select("domain", "missing", F.when((F.col("core") > 0) & (F.col("core_there") == 0), "CANNOT_SEE").when(F.col("missing") > 0, "INFER").otherwise("PROVE").alias("status"))


def arm_comparison(outcomes: DataFrame) -> DataFrame:
    """task_class: runs of either arm, their pass rates, mean tokens, and the differences of arm b from arm a."""
    of = lambda arm, c: F.avg(F.when(F.col("arm") == arm, c))
    g = outcomes.groupBy("task_class").agg(
        *[F.count_if(F.col("arm") == a).alias(f"n_{a}") for a in "ab"], *[of(a, F.col("passed").cast("double")).alias(f"pass_{a}") for a in "ab"], *[of(a, F.col("tokens")).alias(f"tokens_{a}") for a in "ab"]
    )
    return g.withColumn("pass_gain", F.col("pass_b") - F.col("pass_a")).withColumn("token_change", F.try_divide(F.col("tokens_b") - F.col("tokens_a"), F.col("tokens_a")))


def daily_trend(rows: DataFrame, now: dt.datetime, max_days: int = 120, ts: str = "ts") -> DataFrame:
    """day, n: counts a day without gaps, from the first day (at most max_days back) to the last."""
    days = rows.filter(F.col(ts) >= F.lit(now - dt.timedelta(days=max_days))).groupBy(F.to_date(ts).alias("day")).agg(F.count(F.lit(1)).alias("n"))
    spine = days.agg(F.min("day").alias("a"), F.max("day").alias("b")).filter("a IS NOT NULL").select(F.explode(F.sequence("a", "b", F.expr("interval 1 day"))).alias("day"))
    return spine.join(days, "day", "left").select("day", F.coalesce("n", F.lit(0)).alias("n"))


def paired_change(pairs: DataFrame, by: list[str], a: str, b: str) -> DataFrame:
    """by: pairs with both values and the mean difference b - a; null where no pair has both."""
    d = F.col(b) - F.col(a)
    return pairs.groupBy(*by).agg(F.count(d).alias("pairs"), F.avg(d).alias("mean_change"))


def branch_deliveries(branches: DataFrame, requests: DataFrame) -> DataFrame:
    """branch with the change request that delivered it: that of the same head branch, else the latest of its issue number.

    branches: branch; requests: id, head, at. Two equi-joins; no branch meets every request.
    """
    exact = requests.groupBy(F.col("head").alias("branch")).agg(F.max_by("id", F.struct("at", "id")).alias("by_head"))
    issue = requests.withColumn("issue", C.issue_of_branch("head")).filter("issue IS NOT NULL").groupBy("issue").agg(F.max_by("id", F.struct("at", "id")).alias("by_issue"))
    rows = branches.select("branch").distinct().withColumn("issue", C.issue_of_branch("branch"))
    return rows.join(exact, "branch", "left").join(issue, "issue", "left").select("branch", F.coalesce("by_head", "by_issue").alias("id"), F.when(F.col("by_head").isNotNull(), "head").when(F.col("by_issue").isNotNull(), "issue").otherwise("none").alias("how"))


def rework_links(requests: DataFrame) -> DataFrame:
    """id with the next merged request that touches one of its files: later, files in common. requests: id, merged_at, files.

    The next one by file is a lead over the file's merges, so a busy file never meets itself in a self-join.
    """
    f = requests.filter("merged_at IS NOT NULL").select("id", "merged_at", F.explode(F.array_distinct("files")).alias("file"))
    nxt = F.lead(F.struct("merged_at", "id")).over(Window.partitionBy("file").orderBy("merged_at", "id"))
    g = f.withColumn("n", nxt).filter("n IS NOT NULL").groupBy("id", F.col("n.merged_at").alias("then"), F.col("n.id").alias("later")).agg(F.count(F.lit(1)).alias("files"))
    return g.groupBy("id").agg(F.min(F.struct("then", "later", "files")).alias("m")).select("id", "m.later", "m.files")


def run_buckets(runs: DataFrame, kept: DataFrame) -> DataFrame:
    """The kept runs by task shape: bucket (class, size of the change, how many tools), runs, first run, mean cost."""
    shape = F.concat_ws("|", "task_class", F.when(F.col("edits") == 0, "none").when(F.col("edits") <= 3, "small").when(F.col("edits") <= 10, "medium").otherwise("large"), F.least("tools", F.lit(5)))
    return runs.join(kept.select("run_id"), "run_id", "left_semi").groupBy(shape.alias("bucket")).agg(F.count(F.lit(1)).alias("runs"), F.min("run_id").alias("first"), F.avg("cost").alias("mean_cost"))


def discovery_failures(commands: DataFrame, skills: DataFrame, used: DataFrame, least: int = 3) -> DataFrame:
    """session_id, skill: installed skills that a session did by hand, told by at least `least` of a skill's keywords in its commands, and did not call.

    commands: session_id, command; skills: skill, keyword; used: session_id, skill. Words meet keywords by equality.
    """
    words = commands.select("session_id", F.explode(F.array_distinct(F.split(F.lower("command"), "[^a-z0-9]+"))).alias("keyword")).distinct()
    g = words.join(skills, "keyword").groupBy("session_id", "skill").agg(F.count_distinct("keyword").alias("n")).filter(F.col("n") >= least)
    return g.join(used.select("session_id", "skill").distinct(), ["session_id", "skill"], "left_anti")
