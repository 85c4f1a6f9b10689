"""Rules over side artifacts and configuration; importing this module registers them."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import scalars as C
from ..functions.cost import entry_cost
from ..operators import graph as G
from ..operators import sequences as S
from ..operators.quantiles import exact_quantiles
from ..session import materialized
from ..sources import artifacts as A
from .rules import CHARS_PER_TOKEN, EDIT_TOOLS, MIN_USD, RATE_LIMITS, STALE_WEEKS, Signals, bash, costs, recommend, rule, session_costs, with_evidence


@rule("cost.legacy-model-overpay", "token_entries", "model_targets")
def legacy_overpay(s: Signals) -> DataFrame:
    """Messages on a legacy model at their price and at that of the model that follows it (model, target_base)."""
    e = s.token_entries.join(s.model_targets, "model")
    t = e.agg(F.sum(entry_cost("base") - entry_cost("target_base")).alias("usd"), F.count_distinct("session_id").alias("affected"))
    return recommend(t, F.col("usd") >= 0.5, "warning", "A legacy model costs more than its successor", usd="usd")


@rule("cost.model-routing-rollup", "routable_turns")
def model_routing(s: Signals) -> DataFrame:
    """Turns that a cheaper model could take (ts, saving_usd), as a month's saving."""
    days = F.greatest(F.lit(1.0), (S.micros(F.max("ts")) - S.micros(F.min("ts"))) / 86_400e6)
    t = s.routable_turns.agg(F.count(F.lit(1)).alias("affected"), (F.sum("saving_usd") / days * 30).alias("usd"))
    return recommend(t, (F.col("affected") >= 20) & (F.col("usd") >= 1), F.when(F.col("usd") >= 10, "warning").otherwise("info"), "Turns could run on a cheaper model", usd="usd")


@rule("cost.output-verbosity", "token_entries", "timeline")
def output_verbosity(s: Signals) -> DataFrame:
    prose = s.timeline.filter("kind = 'assistant'").groupBy("session_id").agg((F.sum(F.length("summary")) / CHARS_PER_TOKEN).alias("prose"))
    c = s.token_entries.groupBy("session_id").agg(F.sum("output").alias("out"), F.max("base").alias("base")).join(prose, "session_id")
    c = c.filter("prose >= 2000 AND prose >= 0.4D * out")
    t = c.agg(F.count(F.lit(1)).alias("affected"), F.sum(F.col("prose") * 0.4 * F.col("base") * 5 / 1e6).alias("usd"))
    return recommend(t, F.col("usd") >= MIN_USD, "info", "Answers are long", usd="usd")


@rule("cost.edit-format-churn", "edit_hunks")
def format_churn(s: Signals) -> DataFrame:
    """Hunks that only change the form (session_id, file, lines, formatting_only)."""
    t = s.edit_hunks.agg(F.count_if("formatting_only").alias("affected"), F.sum(F.when(F.col("formatting_only"), F.col("lines"))).alias("lines"), F.count(F.lit(1)).alias("n"))
    return recommend(t, (F.col("affected") >= 12) & (F.col("lines") >= 120) & (F.col("affected") >= 0.25 * F.col("n")), "info", "Edits only change formatting")


@rule("context.bloated-claude-md", "instructions")
def bloated_instructions(s: Signals) -> DataFrame:
    """The largest set of instruction files that load together: the global ones and a project's (scope, project, chars)."""
    g = s.instructions.filter("scope = 'global'").agg(F.coalesce(F.sum("chars"), F.lit(0)).alias("g"))
    p = s.instructions.filter("scope = 'project'").groupBy("project").agg(F.sum("chars").alias("p")).agg(F.coalesce(F.max("p"), F.lit(0)).alias("p"))
    t = g.crossJoin(F.broadcast(p)).withColumn("affected", F.col("g") + F.col("p"))  # one row each
    return recommend(t, F.col("affected") > 40_000, "warning", "Instructions fill the context before work begins")


@rule("context.compaction-hot-sessions", "token_entries")
def hot_sessions(s: Signals) -> DataFrame:
    c = session_costs(s).withColumn("pct", 100 * F.col("peak") / 200_000)
    peak = F.when(F.col("pct") >= 80, 40).when(F.col("pct") >= 50, 20 + 20 * (F.col("pct") - 50) / 30).otherwise(20 * F.col("pct") / 50)
    growth = F.col("peak") / F.col("messages")
    score = peak + F.when(growth >= 15_000, 25).when(growth >= 5_000, 12).otherwise(0) + F.least(F.lit(15), 7 * F.col("shrunk"))
    t = c.withColumn("risk", score).agg(F.count_if(F.col("risk") >= 60).alias("affected"), F.count(F.lit(1)).alias("n"))
    return recommend(t, (F.col("affected") >= 2) | ((F.col("n") >= 5) & (F.col("affected") >= 0.4 * F.col("n"))), "warning", "Sessions run close to compaction")


@rule("context.compaction-large-tool-outputs", "tool_calls")
def large_outputs(s: Signals) -> DataFrame:
    g = s.tool_calls.groupBy("session_id").agg(F.avg((F.col("result_bytes") > 20_000).cast("int")).alias("rate")).filter("rate >= 0.25D")
    t = g.agg(F.count(F.lit(1)).alias("affected"), F.avg("rate").alias("mean"))
    return recommend(t, (F.col("affected") >= 3) & (F.col("mean") >= 0.1), "info", "Large tool results drive compaction")


@rule("context.reclaim-potential", "tool_calls", "results")
def reclaim_potential(s: Signals) -> DataFrame:
    """Results that came again in a session, or are very large (session_id, tool_use_id, digest, bytes)."""
    g = s.results.groupBy("session_id", "digest").agg(F.count(F.lit(1)).alias("n"), F.max("bytes").alias("b")).filter("n >= 2 OR b >= 20000")
    t = g.agg(F.count(F.lit(1)).alias("affected"), F.sum(F.col("b") * F.greatest(F.col("n") - 1, F.lit(1))).alias("bytes"))
    return recommend(t, F.col("affected") > 0, "info", "Results are carried twice")


@rule("workflow.shadow-axis-wins", "shadow")
def shadow_axis(s: Signals) -> DataFrame:
    g = A.shadow_wins(s.shadow)
    return recommend(with_evidence(g.agg(F.count(F.lit(1)).alias("affected")), g, "axis", "rate"), F.col("affected") > 0, "info", "A variation wins its experiment", evidence="evidence")


@rule("workflow.review-bottleneck", "reviews")
def review_bottleneck(s: Signals) -> DataFrame:
    g = A.review_bottlenecks(s.reviews, s.now).filter("stale >= 2")
    t = g.agg(F.sum("stale").alias("affected"), F.max("stale").alias("most"), F.max("oldest_hours").alias("oldest"))
    bad = (F.col("most") >= 4) | (F.col("oldest") >= 120)
    return recommend(with_evidence(t, g, "reviewer", "stale"), F.col("affected") >= 3, F.when(bad, "warning").otherwise("info"), "Reviews wait for few people", evidence="evidence")


@rule("workflow.rework-signature", "file_history")
def rework_signature(s: Signals) -> DataFrame:
    """Versions of files by session (session_id, file, version_ts): churn times bursts within ten minutes."""
    w = Window.partitionBy("session_id", "file").orderBy("version_ts")
    near = (S.micros("version_ts") - S.micros(F.lag("version_ts").over(w)) <= 600_000_000).cast("int")
    g = s.file_history.withColumn("near", near).groupBy("session_id").agg((F.count(F.lit(1)) - F.count_distinct("file")).alias("churn"), F.coalesce(F.sum("near"), F.lit(0)).alias("burst"))
    g = g.withColumn("score", F.col("churn") * (1 + F.col("burst")))
    t = g.agg(F.count(F.lit(1)).alias("n"), F.max("score").alias("affected"), F.max_by("burst", "score").alias("burst"))
    return recommend(t, (F.col("n") >= 3) & (F.col("affected") >= 10), F.when(F.col("burst") >= 3, "warning").otherwise("info"), "Files are saved and saved again")


@rule("workflow.churn-geometry", "edit_hunks")
def churn_geometry(s: Signals) -> DataFrame:
    """Lines written against lines kept, by file (session_id, file, lines, net_lines)."""
    g = s.edit_hunks.groupBy("session_id", "file").agg(F.sum("lines").alias("gross"), F.abs(F.sum("net_lines")).alias("net")).filter("gross >= 20 AND gross - net >= 8")
    return recommend(with_evidence(g.agg(F.count(F.lit(1)).alias("affected")), g, "file", "gross"), F.col("affected") > 0, "info", "Much of what is written is written over", evidence="evidence")


@rule("workflow.shared-checkout-rework", "tool_calls")
def shared_checkout(s: Signals) -> DataFrame:
    """A stash, then a switch of branch, then the stash taken back, in one session in this order."""
    git = C.git_steps(bash(s), "command")
    w = Window.partitionBy("session_id").orderBy("ord", "step").rowsBetween(Window.unboundedPreceding, -1)
    at = F.struct("ord", "step")
    saves = (F.col("sub") == "stash") & F.coalesce(F.col("arg").isin("", "push", "save") | F.col("arg").startswith("-"), F.lit(True))
    c = git.withColumn("stashed", F.max(F.when(saves, at)).over(w))
    switch = F.col("sub").isin("switch", "checkout") & (F.col("arg") != "--") & F.col("stashed").isNotNull()
    c = c.withColumn("switched", F.max(F.when(switch, at)).over(w))
    c = c.filter((F.col("sub") == "stash") & F.col("arg").isin("pop", "apply") & (F.col("switched") > F.col("stashed")))
    return recommend(c.agg(F.count_distinct("session_id").alias("affected")), F.col("affected") >= 1, F.when(F.col("affected") >= 3, "warning").otherwise("info"), "Sessions share a checkout and get in each other's way")


@rule("workflow.harmful-habit", "session_factors")
def harmful_habit(s: Signals) -> DataFrame:
    """Factors of sessions against their outcome (session_id, factor, present, good)."""
    g = s.session_factors.groupBy("factor").agg(
        F.avg(F.when(F.col("present"), F.col("good").cast("int"))).alias("a"), F.avg(F.when(~F.col("present"), F.col("good").cast("int"))).alias("b"),
        F.count_if("present").alias("n"), F.count_if(~F.col("present")).alias("m"),
    ).filter("n >= 3 AND m >= 3 AND b - a >= 0.1D").withColumn("gap", F.col("b") - F.col("a"))
    t = g.agg(F.max_by("n", "gap").alias("affected"), F.max("gap").alias("gap"), F.array(F.max_by("factor", "gap")).alias("evidence"))
    return recommend(t, F.col("gap").isNotNull(), F.when(F.col("gap") >= 0.25, "warning").otherwise("info"), "A habit goes with worse outcomes", evidence="evidence")


@rule("reliability.retry-prefix-rewaste", "tool_calls", "token_entries")
def retry_rewaste(s: Signals) -> DataFrame:
    """Context read again by messages within groups of failing repeats."""
    runs = S.islands(s.tool_calls.withColumn("us", S.micros("ts")), ["session_id"], ["ord"], ["tool_name"], "us", 60_000_000)
    g = runs.groupBy("session_id", "island").agg(F.min("us").alias("a"), F.max("us").alias("b"), F.count(F.lit(1)).alias("n"), F.count_if("is_error").alias("bad")).filter("n >= 2 AND bad > 0")
    e = S.asof(s.token_entries.select("session_id", S.micros("ts").alias("us"), "cache_read"), g.select("session_id", F.col("a").alias("a_us"), "b"), ["session_id"], "us", "a_us", "b", out="until")
    return recommend(e.filter("us <= until").agg(F.sum("cache_read").alias("affected")), F.col("affected") > 0, "info", "Failing repeats send the context again")


@rule("reliability.dropped-assignments", "assignments")
def dropped_assignments(s: Signals) -> DataFrame:
    """Messages to team members that nobody read in time (team, agent, dropped)."""
    g = s.assignments.groupBy("team", "agent").agg(F.count_if("dropped").alias("lost"), F.count(F.lit(1)).alias("n")).filter("lost > 0")
    t = g.agg(F.sum("lost").alias("affected"), F.max(F.col("lost") / F.col("n")).alias("worst"))
    return recommend(with_evidence(t, g, "agent", "lost"), F.col("affected") > 0, F.when(F.col("worst") >= 0.5, "warning").otherwise("info"), "Assignments are dropped", evidence="evidence")


@rule("reliability.self-update-health", "updates")
def update_health(s: Signals) -> DataFrame:
    codes = s.updates.groupBy(F.col("code").cast("string").alias("code")).agg(F.count(F.lit(1)).alias("n")).filter("code IS NOT NULL")
    t = with_evidence(s.updates.agg(F.count_if(F.lower("status").rlike("fail|error")).alias("affected")), codes, "code", "n")
    return recommend(t, F.col("affected") > 0, "info", "Updates failed", evidence="evidence")


@rule("reliability.config-drift", "backups")
def config_drift(s: Signals) -> DataFrame:
    c = A.changes(s.backups).filter(F.try_to_timestamp("at") >= s.since(7))
    keys = c.groupBy("key").agg(F.count(F.lit(1)).alias("n"))
    return recommend(with_evidence(c.agg(F.count(F.lit(1)).alias("affected")), keys, "key", "n"), F.col("affected") > 0, "info", "The configuration changed", evidence="evidence")


@rule("safety.policy-change", "backups")
def policy_change(s: Signals) -> DataFrame:
    """Transitions to a riskier mode that the latest snapshot still has."""
    risk = lambda c: F.when(F.col(c) == "bypassPermissions", 3).when(F.col(c) == "acceptEdits", 2).when(F.col(c) == "default", 1).otherwise(0)
    last = A.changes(s.backups.filter(F.lower("key").rlike("mode|sandbox|permission"))).groupBy("key").agg(F.max_by(F.struct("was", "value", "at"), "at").alias("c")).select("key", "c.*")
    c = last.filter((risk("value") > risk("was")) & (F.try_to_timestamp("at") >= s.since(7 * STALE_WEEKS)))
    return recommend(c.agg(F.count(F.lit(1)).alias("affected")), F.col("affected") > 0, "warning", "A policy became more permissive")


@rule("reliability.mcp-needs-auth", "mcp_auth", "attribution")
def mcp_needs_auth(s: Signals) -> DataFrame:
    """Servers that need a login, and whether anything used them (name, needs_auth)."""
    used = s.attribution.filter("kind = 'mcp_server'").groupBy("name").agg(F.sum("invocations").alias("calls"))
    g = s.mcp_auth.filter("needs_auth").join(used, "name", "left")
    g = g.withColumn("calls", F.coalesce("calls", F.lit(0)))
    t = with_evidence(g.agg(F.count(F.lit(1)).alias("affected"), F.coalesce(F.sum("calls"), F.lit(0)).alias("calls")), g, "name", "calls")
    return recommend(t, F.col("affected") > 0, F.when(F.col("calls") > 0, "critical").otherwise("info"), "Servers wait for a login", evidence="evidence")


@rule("reliability.settings-json-invalid", "settings_findings")
def settings_invalid(s: Signals) -> DataFrame:
    t = s.settings_findings.filter("severity IN ('error', 'warning')").agg(F.count(F.lit(1)).alias("affected"), F.count_if(F.col("severity") == "error").alias("errors"))
    return recommend(t, F.col("affected") > 0, F.when(F.col("errors") > 0, "warning").otherwise("info"), "Settings have faults")


@rule("reliability.discovery-freshness", "tool_calls")
def discovery_freshness(s: Signals) -> DataFrame:
    """Edits of a file that was read before the tree moved and not since."""
    moves = F.when(F.col("input.command").rlike(r"\bgit\s+(?:pull|merge|rebase|checkout|switch|reset)\b"), F.col("ord"))
    moved = F.max(moves).over(Window.partitionBy("session_id").orderBy("ord").rowsBetween(Window.unboundedPreceding, -1))
    c = s.tool_calls.withColumn("moved", moved).withColumn("path", F.col("input.file_path")).filter("path IS NOT NULL")
    read = F.max(F.when(F.col("tool_name") == "Read", F.col("ord"))).over(Window.partitionBy("session_id", "path").orderBy("ord").rowsBetween(Window.unboundedPreceding, -1))
    c = c.withColumn("read", read).filter(F.col("tool_name").isin(*EDIT_TOOLS)).filter("read < moved")
    return recommend(c.agg(F.count(F.lit(1)).alias("affected")), F.col("affected") >= 3, "info", "Files are edited from a stale reading")


@rule("reliability.post-shipment-rework", "git_outcomes")
def post_shipment(s: Signals) -> DataFrame:
    """Merged changes that a later one reverts or patches in the same files (id, merged_at, kind, files); joined on the file."""
    f = s.git_outcomes.select("id", "merged_at", "kind", F.explode("files").alias("file"))
    later = f.filter("kind IN ('revert', 'fix')").select("file", F.col("merged_at").alias("then"), F.col("id").alias("by"))
    hit = f.join(later, "file").filter((F.col("then") > F.col("merged_at")) & (F.col("id") != F.col("by")))
    return recommend(hit.agg(F.count_distinct("id").alias("affected")), F.col("affected") >= 1, "warning", "Shipped changes were reworked")


@rule("security.model-deceit", "deceit")
def model_deceit(s: Signals) -> DataFrame:
    """Claims that nothing backs or that the record contradicts (session_id, unbacked, contradicted)."""
    t = s.deceit.agg(F.count_if(F.col("unbacked") + F.col("contradicted") > 0).alias("affected"), F.sum("contradicted").alias("c"))
    return recommend(t, F.col("affected") > 0, F.when(F.col("c") > 0, "warning").otherwise("info"), "Claims of work are not borne out")


@rule("maintenance.doc-hygiene", "doc_nodes", "doc_edges")
def doc_hygiene(s: Signals) -> DataFrame:
    links = s.doc_edges.filter("kind = 'md-link'")
    lost = G.dangling(s.doc_nodes, links)
    broken = with_evidence(lost.agg(F.count(F.lit(1)).alias("broken")), lost.groupBy("dst").agg(F.count(F.lit(1)).alias("n")), "dst", "n")
    alone = G.orphans(s.doc_nodes, links).agg(F.count(F.lit(1)).alias("alone"))
    t = broken.crossJoin(F.broadcast(alone)).withColumn("affected", F.col("broken") + F.col("alone"))  # one row each
    return recommend(t, F.col("affected") > 0, F.when(F.col("broken") > 0, "warning").otherwise("info"), "Documents have broken links or none to them", evidence="evidence")


@rule("maintenance.memory-hygiene", "memory_files", "memory_links")
def memory_hygiene(s: Signals) -> DataFrame:
    """Index files too long, links to nothing, files that no index names (store, name, bytes, longest_line, is_index; store, to)."""
    f = s.memory_files
    big = f.filter("is_index AND (bytes > 24400 OR longest_line > 200)").agg(F.count(F.lit(1)).alias("a"))
    named = s.memory_links.select("store", F.col("to").alias("name"))
    lost = named.join(f.select("store", "name"), ["store", "name"], "left_anti").agg(F.count(F.lit(1)).alias("b"))
    hidden = f.filter("NOT is_index").join(named, ["store", "name"], "left_anti").agg(F.count(F.lit(1)).alias("c"))
    t = big.crossJoin(F.broadcast(lost)).crossJoin(F.broadcast(hidden)).withColumn("affected", F.col("a") + F.col("b") + F.col("c"))  # one row each
    return recommend(t, F.col("affected") > 0, "info", "The memory's index needs care")


@rule("maintenance.skill-hook-integrity", "path_refs")
def path_integrity(s: Signals) -> DataFrame:
    lost = s.path_refs.filter("state = 'missing'")
    t = with_evidence(lost.agg(F.count(F.lit(1)).alias("affected")), lost.groupBy("path").agg(F.count(F.lit(1)).alias("n")), "path", "n")
    return recommend(t, F.col("affected") > 0, "warning", "Hooks or skills point at nothing", evidence="evidence")


@rule("reliability.agent-report-card", "sessions", "api_errors", "tool_calls")
def report_card(s: Signals) -> DataFrame:
    """Projects whose sessions fail or are throttled much more than they work."""
    e = s.api_errors.groupBy("session_id").agg(F.count_if(F.col("status").isin(*RATE_LIMITS)).alias("limited"), F.count(F.lit(1)).alias("errors"))
    c = s.tool_calls.groupBy("session_id").agg(F.count(F.lit(1)).alias("calls"), F.count_if("is_error").alias("bad"))
    g = s.sessions.join(c, "session_id").join(e, "session_id", "left").groupBy("project").agg(F.sum("calls").alias("n"), F.sum("bad").alias("bad"), F.coalesce(F.sum("errors"), F.lit(0)).alias("errors"))
    verdict = F.when(F.col("bad") >= 0.4 * F.col("n"), "move").when((F.col("bad") >= 0.2 * F.col("n")) | (F.col("errors") >= 5), "flag").otherwise("keep")
    g = g.filter("n >= 5").withColumn("verdict", verdict).filter("verdict <> 'keep'")
    t = g.agg(F.count(F.lit(1)).alias("affected"), F.count_if(F.col("verdict") == "move").alias("moves"))
    return recommend(with_evidence(t, g, "project", "bad"), F.col("affected") > 0, F.when(F.col("moves") > 0, "warning").otherwise("info"), "Projects where the agent fails often", evidence="evidence")


# -- rules over catalogues, calibrations and several sessions ----------------------------------


@rule("safety.config-hygiene-rollup", "installed", "attribution")
def config_hygiene(s: Signals) -> DataFrame:
    """Servers and plugins that are installed and never used."""
    kinds = s.installed.filter("kind IN ('mcp_server', 'plugin')").select("kind", "name").distinct()
    idle = kinds.join(s.attribution.select("kind", "name").distinct(), ["kind", "name"], "left_anti").withColumn("n", F.lit(1))
    t = with_evidence(idle.agg(F.count(F.lit(1)).alias("affected")), idle, "name", "n")
    return recommend(t, F.col("affected") >= 2, F.when(F.col("affected") >= 5, "warning").otherwise("info"), "Installed servers and plugins lie idle", evidence="evidence")


@rule("workflow.shadow-prompt", "shadow_calls")
def shadow_prompt(s: Signals) -> DataFrame:
    """Variations tried on the prompt axis within a month (axis, variation, source, ts)."""
    fresh = s.shadow_calls.filter("axis = 'prompt'").filter(F.col("ts") >= s.since(30))
    g = fresh.groupBy("variation", "source").agg(F.count(F.lit(1)).alias("n"))
    return recommend(with_evidence(g.agg(F.count(F.lit(1)).alias("affected")), g, "variation", "n"), F.col("affected") > 0, "info", "A prompt variation has been tried", evidence="evidence")


@rule("workflow.uncovered-shadow-axis", "shadow", "covered_axes")
def uncovered_axis(s: Signals) -> DataFrame:
    """Axes whose variation wins and that no rule covers (axis)."""
    g = A.shadow_wins(s.shadow).join(s.covered_axes.select("axis").distinct(), "axis", "left_anti")
    return recommend(with_evidence(g.agg(F.count(F.lit(1)).alias("affected")), g, "axis", "rate"), F.col("affected") > 0, "info", "An experiment wins on an axis that no rule covers", evidence="evidence")


@rule("workflow.human-input-leverage", "token_entries", "timeline")
def input_leverage(s: Signals) -> DataFrame:
    """Spans between user turns that cost far more than usual and follow a correction or an interruption.

    A message belongs to the last user turn before it: turns and messages are stacked and the turn is carried on.
    """
    from ..sources.signals import steering_kind

    turn = s.timeline.filter("kind = 'user'").select("session_id", S.micros("ts").alias("t_us"), F.struct("ord", ((steering_kind("summary") == "corrective") | F.col("summary").startswith("[Request interrupted")).alias("steered")).alias("turn"))
    spent = s.token_entries.select("session_id", S.micros("ts").alias("us"), (F.col("input") + F.col("output")).alias("tokens"))
    spans = S.asof(spent, turn, ["session_id"], "us", "t_us", "turn", out="at").filter("at IS NOT NULL").groupBy("session_id", "at").agg(F.sum("tokens").alias("tokens"))
    spans = materialized(spans)
    m = exact_quantiles(spans, [], "tokens", [0.5]).select(F.col("q")[0].alias("median"), "n")
    t = spans.crossJoin(F.broadcast(m)).filter("n >= 4 AND at.steered AND tokens >= 3 * median AND tokens >= 50000").agg(F.count(F.lit(1)).alias("affected"))  # one row
    return recommend(t, F.col("affected") > 0, F.when(F.col("affected") >= 3, "warning").otherwise("info"), "Corrections set off expensive stretches of work")


#: What a session waits for, tried in this order.
WAITS = (("review", r"\breview|approv|merge"), ("deploy", r"\bdeploy|releas|publish"), ("build", r"\bbuild|compil|install|bundle"), ("test", r"\btest|suite|\bci\b|lint"))


@rule("workflow.reclaim-wait-windows", "timeline")
def wait_windows(s: Signals) -> DataFrame:
    """Passive waits of a minute or more by what is waited for."""
    w = Window.partitionBy("session_id").orderBy("ord")
    said = F.last(F.when(F.col("kind") == "assistant", F.struct("summary", "ts")), ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, -1))
    c = s.timeline.withColumn("said", said).filter("kind = 'user'").withColumn("gap", (S.micros("ts") - S.micros("said.ts")) / 1e6)
    c = c.filter((F.col("gap") >= 60) & F.lower("said.summary").rlike(r"\b(?:wait(?:ing)?|let me know when|once (?:it|that) (?:is|finishes))\b"))
    kind = F.lit("other")
    for name, pattern in reversed(WAITS):
        kind = F.when(F.lower("said.summary").rlike(pattern), name).otherwise(kind)
    g = c.groupBy(kind.alias("wait")).agg(F.count(F.lit(1)).alias("n"), F.sum("gap").alias("gap"), F.max("gap").alias("worst"))
    t = g.agg(F.sum("n").alias("affected"), (F.sum("gap") / 60).alias("minutes"), F.max("worst").alias("worst"))
    return recommend(with_evidence(t, g, "wait", "gap", 6), F.col("affected") >= 3, F.when(F.col("worst") >= 300, "warning").otherwise("info"), "Waiting time could be used", minutes="minutes", evidence="evidence")


@rule("workflow.value-of-agent-handoff", "tool_calls", "sessions")
def handoff(s: Signals) -> DataFrame:
    """Sessions that changed something outside, left no note, and whose project's next session looked it up again within twenty minutes of its start."""
    c = bash(s)
    outside = c.filter(F.col("command").rlike(r"\bgh\s+(?:pr|issue|release)\s+(?:create|merge|edit)\b|\bgit\s+push\b|\b(?:kubectl|terraform)\s+apply\b")).select("session_id").distinct()
    noted = s.tool_calls.filter(F.col("tool_name").isin(*EDIT_TOOLS) & F.col("input.file_path").rlike(r"(?i)(?:handoff|notes?|todo|status|memory)[^/]*\.md$")).select("session_id").distinct()
    silent = outside.join(noted, "session_id", "left_anti")
    w = Window.partitionBy("project").orderBy("start_ts", "session_id")
    after = s.sessions.withColumn("next", F.lead(F.struct("session_id", "start_ts")).over(w)).filter("next IS NOT NULL").select("session_id", "project", F.col("next.session_id").alias("later"), F.col("next.start_ts").alias("began"))
    again = c.filter(F.col("command").rlike(r"\bgh\s+(?:pr|issue|run)\s+(?:list|view|status|checks)\b|\bgit\s+(?:log|status|fetch)\b")).select(F.col("session_id").alias("later"), "ts")
    hits = silent.join(after, "session_id").join(again, "later").filter(S.micros("ts") - S.micros("began") <= 20 * 60_000_000)
    g = hits.groupBy("session_id", "project").agg(F.count(F.lit(1)).alias("n")).filter("n >= 2")
    return recommend(with_evidence(g.agg(F.count(F.lit(1)).alias("affected")), g, "project", "n"), F.col("affected") > 0, F.when(F.col("affected") >= 3, "warning").otherwise("info"), "The next session finds out again what the last one did", evidence="evidence")


@rule("cost.model-eval-routing-gap", "model_evals")
def eval_routing_gap(s: Signals) -> DataFrame:
    """Task classes that a cheaper model passed lately (task_class, correct, process, cost, style, vetoes, cheaper, ts)."""
    score = C.weighted_score("correct", "process", "cost", "style", "vetoes")
    g = s.model_evals.filter("cheaper").filter(F.col("ts") >= s.since(14)).groupBy("task_class").agg(F.avg(score).alias("score"), F.max("vetoes").alias("vetoes")).filter("score >= 0.6D AND vetoes = 0")
    return recommend(with_evidence(g.agg(F.count(F.lit(1)).alias("affected")), g, "task_class", "score"), F.col("affected") > 0, "info", "Evaluations show a cheaper model is good enough", evidence="evidence")


@rule("cost.local-downroute", "local_calibration")
def local_downroute(s: Signals) -> DataFrame:
    """What calibration says of local models (task_class, outcome): proven where it passed, an honest no where it failed, silence where it is not enough."""
    g = s.local_calibration.filter("outcome IN ('pass', 'fail')").groupBy("outcome").agg(F.count_distinct("task_class").alias("affected"))
    return recommend(g.withColumn("evidence", F.array("outcome")), F.col("affected") > 0, "info", "Local models were calibrated", evidence="evidence")


@rule("context.over-scoped-config-section", "config_sections")
def over_scoped(s: Signals) -> DataFrame:
    """Sections of a root instruction file whose governed files all lie in one folder (file, section, governed)."""
    top = F.regexp_extract("governed", "^([^/]+)/", 1)
    g = s.config_sections.filter(~F.contains("file", F.lit("/"))).groupBy("file", "section").agg(F.count(F.lit(1)).alias("n"), F.count_distinct(top).alias("folders"), F.min(top).alias("folder")).filter("folders = 1 AND folder <> ''")
    t = g.agg(F.count(F.lit(1)).alias("affected"))
    return recommend(with_evidence(t, g, "section", "n"), F.col("affected") > 0, F.when(F.col("affected") >= 3, "warning").otherwise("info"), "Instructions for one folder load everywhere", evidence="evidence")


@rule("context.repo-map-context-waste", "tool_calls", "import_edges")
def map_waste(s: Signals) -> DataFrame:
    """Files that are read again and never changed, and that at least two others import (src, dst)."""
    path = F.col("input.file_path")
    changed = s.tool_calls.filter(F.col("tool_name").isin(*EDIT_TOOLS)).select(path.alias("path")).distinct()
    reads = s.tool_calls.filter("tool_name = 'Read'").groupBy(path.alias("path")).agg(F.count(F.lit(1)).alias("n")).filter("path IS NOT NULL AND n >= 3").join(changed, "path", "left_anti")
    g = reads.join(G.in_degree(s.import_edges).filter("in_degree >= 2").withColumnRenamed("dst", "path"), "path")
    return recommend(with_evidence(g.agg(F.count(F.lit(1)).alias("affected")), g, "path", "n"), F.col("affected") > 0, "info", "Central files are read again instead of mapped", evidence="evidence")
