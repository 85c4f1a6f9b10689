import datetime as dt
import math

import pytest

from tracemill.plans import artifact_rules, rules  # noqa: F401  the former registers its rules

NOW = dt.datetime(2026, 2, 1)
T0 = dt.datetime(2026, 1, 31)
INPUT = "struct<command:string,file_path:string>"


def calls(spark, rows):
    """(session, tool, command, path, error, bytes, seconds)"""
    out, n = [], {}
    for s, tool, command, path, error, size, at in rows:
        n[s] = n.get(s, 0) + 1
        ts = T0 + dt.timedelta(seconds=at)
        out.append((s, f"{s}-{n[s]}", n[s], 0, ts, tool, "{}", (command, path), error, size, ts + dt.timedelta(seconds=20), n[s]))
    schema = f"session_id string, tool_use_id string, seq long, pos int, ts timestamp, tool_name string, input_json string, input {INPUT}, is_error boolean, result_bytes long, result_ts timestamp, ord int"
    return spark.createDataFrame(out, schema)


def entries(spark, rows):
    """(session, seconds, base, input, output, made, hour, read)"""
    out = [(s, f"m{k}", k, T0 + dt.timedelta(seconds=at), "m", "sdk-py" if s.startswith("auto") else "cli", None, base, i, o, c, h, r, 0, o, 0) for k, (s, at, base, i, o, c, h, r) in enumerate(rows)]
    schema = "session_id string, message_id string, seq long, ts timestamp, model string, entrypoint string, service_tier string, base double, input long, output long, cache_creation long, cache_creation_1h long, cache_read long, web_search long, visible long, thinking long"
    return spark.createDataFrame(out, schema)


def ids(df):
    return [r["id"] for r in df.collect()]


def run(s, *wanted):
    return {r["id"]: r for r in rules.evaluate(s, [r for r in rules.RULES if r.id in wanted]).collect()}


def test_tool_rules(spark):
    rows = [("s", "Bash", "grep x", None, k % 2 == 0, 5, k * 60) for k in range(12)] + [("s", "Edit", None, "/a", False, 5, 1000 + k) for k in range(15)] + [("s", "Bash", "rm -rf /x", None, False, 1, 2000)]
    s = rules.Signals(NOW, {"tool_calls": calls(spark, rows)})
    got = run(s, "workflow.native-bypass", "workflow.file-churn", "reliability.tool-errors", "reliability.retry-storms", "safety.risky-actions", "workflow.repeated-commands")
    assert got["workflow.native-bypass"]["affected"] == 12
    assert got["workflow.file-churn"]["evidence"] == ["/a"]
    assert got["reliability.tool-errors"]["affected"] == 6 and got["reliability.tool-errors"]["evidence"] == ["Bash"]
    assert got["reliability.retry-storms"]["affected"] == 1
    assert got["safety.risky-actions"]["severity"] == "critical" and got["workflow.repeated-commands"]["evidence"] == ["grep x"]


def test_gap_is_inclusive_at_a_minute(spark):
    at = [0, 60, 120, 181, 242]
    s = rules.Signals(NOW, {"tool_calls": calls(spark, [("s", "Bash", "x", None, True, 1, t) for t in at])})
    assert run(s, "reliability.retry-storms") == {}
    s = rules.Signals(NOW, {"tool_calls": calls(spark, [("s", "Bash", "x", None, True, 1, 60 * k) for k in range(4)])})
    assert run(s, "reliability.retry-storms")["reliability.retry-storms"]["affected"] == 1


def test_cost_rules(spark):
    rows = [(f"s{k}", k, 3.0, 1000, 1000, 0, 0, 0) for k in range(6)] + [("s0", 10, 3.0, 10**6, 10**5, 0, 0, 0), ("auto", 11, 3.0, 10**6, 10**4, 0, 0, 0), ("none", 12, None, 5, 5, 0, 0, 0)]
    got = run(rules.Signals(NOW, {"token_entries": entries(spark, rows)}), "cost.expensive-sessions", "cost.automation-share", "cost.unknown-model", "cost.batchable-workload", "context.over-window")
    assert got["cost.expensive-sessions"]["evidence"][0] == "s0"
    assert math.isclose(got["cost.automation-share"]["est_savings_usd"], 3.15)
    assert got["cost.unknown-model"]["affected"] == 1
    assert math.isclose(got["cost.batchable-workload"]["est_savings_usd"], 1.575)
    assert got["context.over-window"]["affected"] == 2


@pytest.mark.parametrize(("after", "seconds", "n"), [(60_000, 240, 1), (60_000, 360, 0), (70_000, 240, 0)])
def test_compactions(spark, after, seconds, n):
    rows = [("s", 0, 3.0, 100_000, 1, 0, 0, 0), ("s", seconds, 3.0, after, 1, 0, 0, 0)]
    assert rules.session_costs(rules.Signals(NOW, {"token_entries": entries(spark, rows)})).first()["shrunk"] == n


def test_dark_rules_and_rank(spark):
    s = rules.Signals(NOW, {"tool_calls": calls(spark, [("s", "Bash", "rm -rf /", None, True, 1, k) for k in range(6)])})
    states = dict(rules.coverage(s))
    assert states["cost.expensive-sessions"] == "dark" and states["reliability.tool-errors"] == "on"
    got = rules.build(s).collect()
    keys = [(-r["severity_rank"],) for r in got]
    assert keys == sorted(keys) and got[0]["severity"] == "critical"
    rejected = spark.createDataFrame([("safety.risky-actions",)], "id string")
    assert "safety.risky-actions" not in ids(rules.build(s, rejected)) and "safety.risky-actions" in [r["id"] for r in got]
    assert rules.build(rules.Signals(NOW, {"tool_calls": calls(spark, [])})).count() == 0


def test_every_rule_plans(spark):
    """All rules compile on tables of the right schema with no rows, and say nothing."""
    empty = lambda ddl: spark.createDataFrame([], ddl)
    s = rules.Signals(NOW, {
        "token_entries": entries(spark, []), "tool_calls": calls(spark, []),
        "sessions": empty("session_id string, project string, start_ts timestamp, end_ts timestamp, unattended boolean"),
        "api_errors": empty("session_id string, seq long, ts timestamp, status int, retryAttempt int"),
        "timeline": empty("session_id string, ord int, ts timestamp, kind string, summary string"),
        "turns": empty("session_id string, durationMs double"), "stop_hooks": empty("ts timestamp, timed_ms double, errors int, preventedContinuation boolean"),
        "permission_rows": empty("session_id string, mode string"), "attribution": empty("session_id string, kind string, name string, invocations long, output_tokens long"),
        "tool_inventory": empty("session_id string, available array<string>, used array<string>"), "plans": empty("has_verification boolean, file_refs int, words int"),
        "workflows": empty("tokens long, status string, rate_limited long"), "tasks": empty("session_id string, task_id string, status string, owner string, blocked_by array<string>, mtime timestamp"),
        "installed": empty("kind string, name string"), "latency": empty("model string, api_ms double, output_tokens long"),
        "steering": empty("corrections int, success double, specificity double"), "permission_rules": empty("kind string, rule string"), "daily": empty("day date, tool_calls long"),
        "model_targets": empty("model string, target_base double"), "routable_turns": empty("ts timestamp, saving_usd double"), "edit_hunks": empty("session_id string, file string, lines long, net_lines long, formatting_only boolean"),
        "instructions": empty("scope string, project string, chars long"), "results": empty("session_id string, tool_use_id string, digest string, bytes long"),
        "shadow": empty("axis string, variation string, at string, winner string"), "reviews": empty("id string, reviewer string, requestedAt string, closedAt string"),
        "file_history": empty("session_id string, file string, version_ts timestamp"), "session_factors": empty("session_id string, factor string, present boolean, good boolean"),
        "assignments": empty("team string, agent string, dropped boolean"), "updates": empty("status string, code int"), "backups": empty("at string, key string, value string"),
        "mcp_auth": empty("name string, needs_auth boolean"), "settings_findings": empty("severity string"), "git_outcomes": empty("id string, merged_at timestamp, kind string, files array<string>"),
        "deceit": empty("session_id string, unbacked int, contradicted int"), "doc_nodes": empty("node string"), "doc_edges": empty("src string, dst string, kind string"),
        "memory_files": empty("store string, name string, bytes long, longest_line int, is_index boolean"), "memory_links": empty("store string, to string"), "path_refs": empty("path string, state string"),
        "shadow_calls": empty("axis string, variation string, source string, ts timestamp"), "covered_axes": empty("axis string"), "import_edges": empty("src string, dst string"),
        "model_evals": empty("task_class string, correct double, process double, cost double, style double, vetoes int, cheaper boolean, ts timestamp"),
        "local_calibration": empty("task_class string, outcome string"), "config_sections": empty("file string, section string, governed string"),
    })
    assert all(state == "on" for _, state in rules.coverage(s))
    assert [r["id"] for r in rules.evaluate(s).collect()] == []


def test_cascade_adds_up(spark):
    claims = spark.createDataFrame([("a", 1, 0.5), ("a", 2, 0.5), ("a", 3, 0.1), ("b", 1, 1.0), ("b", 2, 0.3)], "scope string, ord int, fraction double")
    bill = spark.createDataFrame([("a", 100.0), ("b", 10.0)], "scope string, usd double")
    out = {(r["scope"], r["ord"]): r["marginal"] for r in rules.cascade(claims, bill).collect()}
    assert math.isclose(out["a", 1], 50) and math.isclose(out["a", 2], 25) and math.isclose(out["a", 3], 2.5)
    assert math.isclose(sum(v for (s, _), v in out.items() if s == "b"), 10)


def test_proof_needs_twelve_pairs(spark):
    of = lambda n, d: spark.createDataFrame([(10.0 + k, 10.0 + k - d * (k + 1)) for k in range(n)], "control double, treatment double")
    assert rules.paired_proof(of(11, 1)).first()["verdict"] == "not-yet-provable"
    assert rules.paired_proof(of(12, 1)).first()["verdict"] == "proven"
    assert rules.paired_proof(of(12, -1)).first()["verdict"] == "null"
    assert rules.paired_proof(of(12, 0)).first()["p"] == 1.0


def test_artifact_rules(spark):
    of = lambda ddl, *rows: spark.createDataFrame(list(rows), ddl)
    s = rules.Signals(NOW, {
        "doc_nodes": of("node string", ("a",), ("b",)), "doc_edges": of("src string, dst string, kind string", ("a", "b", "md-link"), ("a", "gone", "md-link")),
        "git_outcomes": of("id string, merged_at timestamp, kind string, files array<string>", ("1", T0, "feature", ["f"]), ("2", NOW, "revert", ["f", "g"])),
        "backups": of("at string, key string, value string", ("2026-01-30T00:00:00Z", "mode", "default"), ("2026-01-31T00:00:00Z", "mode", "bypassPermissions")),
        "instructions": of("scope string, project string, chars long", ("global", None, 30_000), ("project", "p", 9_000), ("project", "q", 11_000)),
        "tool_calls": calls(spark, [("s", "Bash", c, None, False, 1, k) for k, c in enumerate(["git stash", "git switch main", "git stash pop"])]),
    })
    got = run(s, "maintenance.doc-hygiene", "reliability.post-shipment-rework", "reliability.config-drift", "safety.policy-change", "context.bloated-claude-md", "workflow.shared-checkout-rework")
    assert got["maintenance.doc-hygiene"]["evidence"] == ["gone"] and got["maintenance.doc-hygiene"]["affected"] == 2
    assert {k: r["affected"] for k, r in got.items() if k != "maintenance.doc-hygiene"} == {
        "reliability.post-shipment-rework": 1, "reliability.config-drift": 1, "safety.policy-change": 1, "context.bloated-claude-md": 41_000, "workflow.shared-checkout-rework": 1,
    }


def test_rules_over_catalogues(spark):
    of = lambda ddl, *rows: spark.createDataFrame(list(rows), ddl)
    s = rules.Signals(NOW, {
        "installed": of("kind string, name string", ("mcp_server", "a"), ("plugin", "b"), ("mcp_server", "used"), ("skill", "c")), "attribution": of("session_id string, kind string, name string, invocations long, output_tokens long", ("s", "mcp_server", "used", 1, 1)),
        "shadow_calls": of("axis string, variation string, source string, ts timestamp", ("prompt", "v", "x", T0), ("prompt", "old", "x", NOW - dt.timedelta(days=40)), ("other", "w", "x", T0)),
        "shadow": of("axis string, variation string, at string, winner string", *[("tone", "v", "t", "shadow")] * 5, *[("size", "v", "t", "shadow")] * 5), "covered_axes": of("axis string", ("size",)),
        "model_evals": of("task_class string, correct double, process double, cost double, style double, vetoes int, cheaper boolean, ts timestamp", ("a", 1.0, 0.5, 0.5, 0.5, 0, True, T0), ("b", 1.0, 1.0, 1.0, 1.0, 1, True, T0), ("c", 1.0, 1.0, 1.0, 1.0, 0, True, NOW - dt.timedelta(days=20))),
        "local_calibration": of("task_class string, outcome string", ("a", "pass"), ("b", "fail"), ("c", "insufficient")),
        "config_sections": of("file string, section string, governed string", ("ROOT.md", "one", "web/a.ts"), ("ROOT.md", "one", "web/b.ts"), ("ROOT.md", "two", "web/a.ts"), ("ROOT.md", "two", "api/b.ts"), ("web/X.md", "three", "web/a.ts")),
        "import_edges": of("src string, dst string", ("a", "/hub"), ("b", "/hub"), ("c", "/leaf")), "tool_calls": calls(spark, [("s", "Read", None, p, False, 1, k) for k, p in enumerate(["/hub", "/leaf"] * 3)]),
        "token_entries": entries(spark, [("h", at, 3.0, n, 0, 0, 0, 0) for at, n in ((1, 1000), (61, 1000), (121, 1000), (181, 90_000))]),
        "timeline": of("session_id string, ord int, ts timestamp, kind string, summary string", *[("h", k, T0 + dt.timedelta(seconds=60 * k), "user", text) for k, text in enumerate(["please do this", "and that", "fine", "no, that is wrong"])]),
    })
    wanted = ("safety.config-hygiene-rollup", "workflow.shadow-prompt", "workflow.uncovered-shadow-axis", "cost.model-eval-routing-gap", "context.over-scoped-config-section", "context.repo-map-context-waste", "workflow.human-input-leverage")
    got = run(s, *wanted)
    assert {k: (r["affected"], r["evidence"]) for k, r in got.items()} == {
        "safety.config-hygiene-rollup": (2, ["a", "b"]), "workflow.shadow-prompt": (1, ["v"]), "workflow.uncovered-shadow-axis": (1, ["tone"]), "cost.model-eval-routing-gap": (1, ["a"]),
        "context.over-scoped-config-section": (1, ["one"]), "context.repo-map-context-waste": (1, ["/hub"]), "workflow.human-input-leverage": (1, []),
    }
    local = [r for r in rules.RULES if r.id == "cost.local-downroute"]
    assert sorted(r["evidence"][0] for r in rules.evaluate(s, local).collect()) == ["fail", "pass"]


def test_waits_and_handoffs(spark):
    say = [("s", k, T0 + dt.timedelta(minutes=6 * k), "assistant" if k % 2 == 0 else "user", "waiting for the build" if k % 2 == 0 else "done") for k in range(6)]
    sessions = spark.createDataFrame([("a", "p", T0, T0), ("b", "p", T0 + dt.timedelta(hours=1), NOW)], "session_id string, project string, start_ts timestamp, end_ts timestamp")
    rows = [("a", "Bash", "gh pr create", None, False, 1, 10), ("b", "Bash", "gh pr list", None, False, 1, 3700), ("b", "Bash", "git log -3", None, False, 1, 3800)]
    s = rules.Signals(NOW, {"timeline": spark.createDataFrame(say, "session_id string, ord int, ts timestamp, kind string, summary string"), "tool_calls": calls(spark, rows), "sessions": sessions})
    got = run(s, "workflow.reclaim-wait-windows", "workflow.value-of-agent-handoff")
    assert got["workflow.reclaim-wait-windows"]["affected"] == 3 and got["workflow.reclaim-wait-windows"]["evidence"] == ["build"] and got["workflow.reclaim-wait-windows"]["severity"] == "warning"
    assert got["workflow.value-of-agent-handoff"]["evidence"] == ["p"]
    noted = calls(spark, [*rows, ("a", "Write", None, "/x/HANDOFF.md", False, 1, 20)])
    assert run(rules.Signals(NOW, {"tool_calls": noted, "sessions": sessions}), "workflow.value-of-agent-handoff") == {}


def test_settings_silence_rules(spark):
    rows = [("s", "Bash", "grep x", None, False, 5, k * 60) for k in range(12)]
    tables = {"tool_calls": calls(spark, rows)}
    assert "workflow.native-bypass" in run(rules.Signals(NOW, tables), "workflow.native-bypass")
    text = "# Rules\n## Prefer native tools and path-safe shell usage\nAlways CHOOSE native tools or path-safe alternatives before Bash."
    config = spark.createDataFrame([("instructions", text), ("other", "x")], "key string, value string")
    assert run(rules.Signals(NOW, {**tables, "live_config": config}), "workflow.native-bypass") == {}
