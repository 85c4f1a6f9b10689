"""A world in which nearly every rule has something to say."""

import datetime as dt

import pytest

from tracemill.plans import artifact_rules, rules  # noqa: F401  the former registers its rules

NOW = dt.datetime(2026, 2, 1)
T0 = dt.datetime(2026, 1, 31)
ago = lambda **k: NOW - dt.timedelta(**k)


def at(seconds):
    return T0 + dt.timedelta(seconds=seconds)


def token_rows():
    """session, seconds, base, input, output, made, hour, read, web, tier, thinking, visible"""
    rows = [("waste", k, 3.0, 1000, 100, 10**6, 10**6, 0, 0, None, 0, 100) for k in range(2)]
    rows += [("reader", 5, 3.0, 1000, 100, 0, 0, 2 * 10**7, 0, None, 0, 100), ("search", 6, 3.0, 10, 10, 0, 0, 0, 4000, None, 0, 10)]
    rows += [(f"tier{k}", 7, 3.0, 10, 10, 0, 0, 0, 0, "priority", 0, 10) for k in range(3)]
    rows += [("thinker", 8, 3.0, 10, 10, 0, 0, 0, 0, None, 60_000, 3000), ("sdk", 9, 3.0, 10**6, 10**5, 0, 0, 0, 0, None, 0, 10), ("odd", 9, None, 1, 1, 0, 0, 0, 0, None, 0, 1)]
    for s in ("shrink1", "shrink2"):
        rows += [(s, k * 60, 3.0, n, 10, 5, 0, 0, 0, None, 0, 10) for k, n in enumerate([250_000, 90_000, 250_000, 90_000])]
    rows += [(f"early{k}", -9000 - k, 3.0, 100, 10, 0, 0, 0, 0, None, 0, 10) for k in range(12)] + [(f"recent{k}", 9000 + k, 3.0, 150_000, 10, 0, 0, 0, 0, None, 0, 10) for k in range(10)]
    rows += [("retry", 100 + k, 3.0, 10, 10, 0, 0, 5000, 0, None, 0, 10) for k in range(5)] + [("talker", 50, 3.0, 10, 30_000, 0, 0, 0, 0, None, 0, 20_000)]
    return rows


def call_rows():
    """session, tool, command, path, error, bytes, seconds"""
    rows = [("s1", "Read", None, "/again", False, 30_000, k * 10) for k in range(4)]
    rows += [(f"x{k}", "Read", None, "/shared", False, 40_000, 1) for k in range(5)]
    for k in range(12):
        rows += [("undo", "Edit", None, f"/u{k}", False, 1, k * 100), ("undo", "Bash", "git checkout -- .", None, False, 1, k * 100 + 1)]
    rows += [("bad", "Broken", None, None, True, 1, k * 100) for k in range(12)]
    rows += [("fix", "Read", None, "/a/target.py", True, 1, 1), ("fix", "Read", None, "/b/target.py", False, 1, 2)]
    for n in range(3):
        rows += [(f"proc{n}", "Bash", c, None, False, 1, k) for k, c in enumerate(["git status", "git add", "git commit"])]
    rows += [("stale", "Bash", f"git diff origin/main -- f{k}", None, False, 1, k) for k in range(4)]
    rows += [("ghost", "Read", None, f"/g{k}/alpha{k}", False, 1, k) for k in range(6)]
    rows += [("build", "Bash", f"npm run build {k}", None, False, 1, k * 100) for k in range(3)]
    rows += [("free", "Bash", "rm -rf /x", None, False, 1, 1), ("retry", "Bash", "flaky", None, True, 1, 100 + 0), *[("retry", "Bash", "flaky", None, True, 1, 100 + k) for k in range(1, 5)]]
    rows += [("fresh", "Read", None, f"/d{k}", False, 1, k) for k in range(3)] + [("fresh", "Bash", "git pull", None, False, 1, 10)] + [("fresh", "Edit", None, f"/d{k}", False, 1, 20 + k) for k in range(3)]
    rows += [("search", "Bash", "grep x .", None, False, 1, k) for k in range(12)] + [("churn", "Edit", None, "/churn", False, 1, k) for k in range(16)]
    rows += [("long", "Bash", "ls", None, False, 1, -20 * 86_400)]
    rows += [(f"big{n}", "Web", None, None, False, 30_000, k) for n in range(3) for k in range(4)]
    rows += [("shared", "Bash", c, None, False, 1, k) for k, c in enumerate(["git stash", "git switch x", "git stash pop"])] + [("drop", "Bash", c, None, False, 1, k) for k, c in enumerate(["git stash drop", "git switch x", "git stash pop"])]
    return rows


@pytest.fixture(scope="module")
def world(spark):
    of = lambda ddl, *rows: spark.createDataFrame(list(rows), ddl)
    entries = [(s, f"m{k}", k, at(t), "old-model" if s == "sdk" else "m", "sdk-py" if s == "sdk" else "cli", tier, base, i, o, made, hour, read, web, vis, th) for k, (s, t, base, i, o, made, hour, read, web, tier, th, vis) in enumerate(token_rows())]
    n, calls = {}, []
    for s, tool, command, path, error, size, t in call_rows():
        n[s] = n.get(s, 0) + 1
        calls.append((s, f"{s}-{n[s]}", n[s], 0, at(t), tool, f'{{"x": "{path or command}"}}', (command, path), error, size, at(t + 20), n[s]))
    said = [("talk", k, at(k), "assistant", "I can't do it" if k % 3 == 0 else "ok") for k in range(60)] + [("stop", k, at(k), "user", "[Request interrupted by user]") for k in range(3)]
    said += [("wait", k, at(400 * k), "assistant" if k % 2 == 0 else "user", "waiting for the test suite" if k % 2 == 0 else "go on") for k in range(8)]
    said += [(s, 1, at(1), "user", "please make the parser accept nested lists of numbers and report errors with line and column") for s in ("first", "second")] + [("leak", 1, at(1), "assistant", "key AKIA" + "A" * 16), ("talker", 1, at(60), "assistant", "word " * 20_000)]
    sessions = [(s, "p", at(0), at(100), s == "free") for s in n] + [(s, "q", at(0), at(100), False) for s in ("first", "second")] + [(f"old{k}", "quiet", ago(days=60), ago(days=60), False) for k in range(3)]
    tasks = [("t", f"a{k}", "pending", "ann" if k else "bob", ["root"], ago(days=20)) for k in range(6)] + [("t", "root", "pending", "ann", [], ago(days=20))]
    return rules.Signals(NOW, {
        "token_entries": of("session_id string, message_id string, seq long, ts timestamp, model string, entrypoint string, service_tier string, base double, input long, output long, cache_creation long, cache_creation_1h long, cache_read long, web_search long, visible long, thinking long", *entries),
        "tool_calls": of("session_id string, tool_use_id string, seq long, pos int, ts timestamp, tool_name string, input_json string, input struct<command:string,file_path:string>, is_error boolean, result_bytes long, result_ts timestamp, ord int", *calls),
        "timeline": of("session_id string, ord int, ts timestamp, kind string, summary string", *said), "sessions": of("session_id string, project string, start_ts timestamp, end_ts timestamp, unattended boolean", *sessions),
        "permission_rows": of("session_id string, seq long, ts timestamp, mode string", ("free", 1, T0, "bypassPermissions")),
        "api_errors": of("session_id string, seq long, ts timestamp, status int, retryAttempt int", ("retry", 1, at(101), 529, 2), ("retry", 2, at(102), 529, 3), *[("s1", 3 + k, T0, 500, 1) for k in range(6)]),
        "stop_hooks": of("session_id string, ts timestamp, timed_ms double, errors int, preventedContinuation boolean", *[("h", at(k), 6000.0, 1, True) for k in range(6)]),
        "turns": of("session_id string, seq long, ts timestamp, durationMs double, messageCount int", *[("h", k, T0, 600_000.0, 1) for k in range(4)]),
        "attribution": of("session_id string, kind string, name string, invocations long, output_tokens long", *[(f"recent{k}", "agent", "helper", 1, 10) for k in range(6)], ("s", "mcp_server", "locked", 3, 1)),
        "tool_inventory": of("session_id string, available array<string>, used array<string>", *[(f"i{k}", ["mcp__a", "Bash"], ["Bash"]) for k in range(3)]),
        "plans": of("name string, has_verification boolean, file_refs int, words int", *[(f"p{k}", False, 7, 10) for k in range(3)]),
        "workflows": of("status string, tokens long, rate_limited int", ("ok", 1000, 0), ("ok", 1000, 0), ("failed", 1000, 12), ("ok", 900_000, 0)),
        "tasks": of("session_id string, task_id string, status string, owner string, blocked_by array<string>, mtime timestamp", *tasks),
        "installed": of("kind string, name string", *[("skill", f"s{k}") for k in range(3)], *[("plugin", f"p{k}") for k in range(5)], *[(kind, f"{kind}{k}") for kind in ("agent", "command") for k in range(3)]),
        "steering": of("session_id string, specificity double, turns long, corrections double, success double", *[(f"v{k}", 0.25, 3, 3.0, 0.95) for k in range(4)], *[(f"c{k}", 0.75, 3, 0.0, 0.95) for k in range(4)]),
        "permission_rules": of("kind string, rule string", ("deny", "Bash(curl:*)"), ("allow", "Bash(curl x:*)")),
        "latency": of("model string, api_ms double, output_tokens long", *[("slow", 200_000.0, 2000) for _ in range(3)], *[("fast", 2000.0, 2000) for _ in range(3)]),
        "daily": of("day date, tool_calls long", *[(dt.date(2026, 1, 1) + dt.timedelta(days=k), 100 if k > 6 else 10) for k in range(14)]),
        "model_targets": of("model string, target_base double", ("old-model", 1.0)), "routable_turns": of("ts timestamp, saving_usd double", *[(at(3600 * k), 1.0) for k in range(30)]),
        "edit_hunks": of("session_id string, file string, lines long, net_lines long, formatting_only boolean", *[("e", "f", 20, 1 if k % 2 else -1, True) for k in range(14)]),
        "instructions": of("scope string, project string, chars long", ("global", None, 50_000)), "results": of("session_id string, tool_use_id string, digest string, bytes long", ("s", "1", "d", 100), ("s", "2", "d", 100)),
        "shadow": of("axis string, variation string, at string, winner string", *[("tone", "v", "t", "shadow")] * 5), "reviews": of("id string, reviewer string, requestedAt string, closedAt string", *[(str(k), "ann", "2026-01-20T00:00:00Z", None) for k in range(4)]),
        "file_history": of("session_id string, file string, version_ts timestamp", *[(s, "f", at(10 * k)) for s in ("a", "b", "c") for k in range(6)]),
        "session_factors": of("session_id string, factor string, present boolean, good boolean", *[(f"g{k}", "late", k < 4, k >= 4) for k in range(8)]),
        "assignments": of("team string, agent string, dropped boolean", ("t", "a", True)), "updates": of("status string, code int", ("failed", 3)),
        "backups": of("at string, key string, value string", ("2026-01-30T00:00:00Z", "mode", "default"), ("2026-01-31T00:00:00Z", "mode", "bypassPermissions")),
        "mcp_auth": of("name string, needs_auth boolean", ("locked", True)), "settings_findings": of("severity string", ("error",)), "deceit": of("session_id string, unbacked int, contradicted int", ("s", 1, 1)),
        "git_outcomes": of("id string, merged_at timestamp, kind string, files array<string>", ("1", T0, "feature", ["f"]), ("2", NOW, "revert", ["f"])),
        "doc_nodes": of("node string", ("a",)), "doc_edges": of("src string, dst string, kind string", ("a", "gone", "md-link")),
        "memory_files": of("store string, name string, bytes long, longest_line int, is_index boolean", ("m", "INDEX.md", 30_000, 10, True)), "memory_links": of("store string, to string", ("m", "lost.md")), "path_refs": of("path string, state string", ("/x", "missing")),
    })


#: Rules that need a table of their own test, or that this world keeps silent on purpose.
ELSEWHERE = {"cost.expensive-sessions", "cost.automation-share", "safety.prompt-friction", "reliability.api-errors", "workflow.human-input-leverage", "workflow.value-of-agent-handoff", "context.low-cache-hit", "context.last-n-runs-audit"}


def test_nearly_every_rule_fires(world):
    here = [r for r in rules.RULES if world.has(*r.needs)]
    got = rules.evaluate(world.prepared()).collect()
    fired = {r["id"] for r in got}
    silent = {r.id for r in here} - fired - ELSEWHERE
    assert len(here) >= 90 and silent == set()
    assert next(r for r in got if r["id"] == "workflow.shared-checkout-rework")["affected"] == 1  # dropping a stash is not taking it back


def test_the_rest(spark, world):
    names = "session_id string, ts timestamp, base double, input long, cache_creation long, cache_creation_1h long, cache_read long, output long, web_search long, seq long, entrypoint string, service_tier string, thinking long, visible long"
    rows = [(f"e{k}", at(k), 3.0, 40_000, 10, 0, 5, 1, 0, k, "cli", None, 0, 1) for k in range(6)] + [(f"r{k}", at(100 + k), 3.0, 90_000, 10, 0, 5, 1, 0, k, "cli", None, 0, 1) for k in range(10)]
    rows += [("sdk", at(-5), 3.0, 2 * 10**6, 10, 0, 5, 1, 0, 0, "sdk-py", None, 0, 1)]
    calls = world.tool_calls.limit(1).withColumn("n", rules.F.explode(rules.F.sequence(rules.F.lit(1), rules.F.lit(25)))).withColumn("tool_name", rules.F.lit("Bash"))
    s = rules.Signals(NOW, {"token_entries": spark.createDataFrame(rows, names), "tool_calls": calls, "api_errors": world.api_errors})
    wanted = {"cost.automation-share", "context.low-cache-hit", "safety.prompt-friction", "reliability.api-errors"}
    got = {r["id"]: r for r in rules.evaluate(s, [r for r in rules.RULES if r.id in wanted]).collect()}
    assert set(got) == wanted and got["context.low-cache-hit"]["affected"] == 17
    s = rules.Signals(NOW, {"token_entries": spark.createDataFrame(rows[:16], names)})
    recent = rules.evaluate(s, [r for r in rules.RULES if r.id == "context.last-n-runs-audit"]).collect()
    assert [(r["severity"], r["affected"]) for r in recent] == [("warning", 10)]
