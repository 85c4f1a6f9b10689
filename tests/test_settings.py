"""Settings and instruction files, and the rules that they answer."""

import json

from tracemill.sources import settings


def test_settings_files_become_rows(spark, tmp_path):
    user = {"cleanupPeriodDays": 30, "model": "some-haiku-4", "permissions": {"allow": ["Bash(ls:*)"], "deny": ["Read(./x)", "Bash(dd:*)"]}, "unknown": {"a": [1]},
            "hooks": {"PreToolUse": [{"matcher": "Write|Edit", "hooks": [{"type": "command", "command": "check"}, {"command": "run cwd-anchor-guard"}]}], "Stop": [{"hooks": [{"command": "done"}]}]}}
    (tmp_path / "settings.json").write_text(json.dumps(user, indent=1))
    (tmp_path / "settings.local.json").write_text('{"autoCompactEnabled": false}')
    (tmp_path / "broken.json").write_text("{not json")
    (tmp_path / "empty.json").write_text("{}")
    rows = {tuple(r) for r in settings.read(spark, [f"{tmp_path}/*.json"]).collect()}
    assert rows == {
        ("cleanupPeriodDays", "30.0"), ("model", "some-haiku-4"), ("autoCompactEnabled", "false"), ("permissions.allow", "Bash(ls:*)"), ("permissions.deny", "Read(./x)"), ("permissions.deny", "Bash(dd:*)"),
        ("hooks.PreToolUse.matcher", "Write|Edit"), ("hooks.PreToolUse.command", "check"), ("hooks.PreToolUse.command", "run cwd-anchor-guard"), ("hooks.Stop.command", "done"),
    }
    got = {r["id"] for r in settings.answered(settings.read(spark, [f"{tmp_path}/*.json"])).collect()}
    assert got == {"activity.stale-projects", "workflow.tool-undo-rate", "reliability.cwd-drift-execution", "cost.unknown-model", "cost.legacy-model-overpay", "cost.expensive-agent-type", "cost.automation-share", "context.repeated-compactions"}


def test_advice_needs_its_heading_and_its_phrase(spark, tmp_path):
    (tmp_path / "CLAUDE.md").write_text("# Mine\r\n## Key files\r\nload these files ONCE into context\r\n## Common commands\r\n\r\ntext ## Session scope\r\nstart a fresh session when the task changes")
    (tmp_path / "AGENTS.md").write_text("please keep assistant output terse\nand wrap them in a script")
    config = settings.read(spark, [], [str(tmp_path / "CLAUDE.md"), str(tmp_path / "AGENTS.md")])
    assert {r["id"] for r in settings.answered(config).collect()} == {"workflow.redundant-reads", "workflow.repeated-commands"}  # of one file, and of both together
    assert settings.answered(settings.read(spark, [])).count() == 0
    assert len({i for i, _, _ in settings.MARKERS}) == len(settings.MARKERS)


def test_every_answer_is_of_a_rule():
    from tracemill.plans import artifact_rules, rules  # noqa: F401  the former registers its rules

    known = {r.id for r in rules.RULES}
    assert {i for i, *_ in (*settings.SETTING_ANSWERS, *settings.MARKERS)} <= known


def test_each_transition_comes_once(spark, tmp_path):
    import datetime as dt

    from tracemill.plans import adoption, artifact_rules, rules  # noqa: F401

    now = dt.datetime(2026, 2, 1)
    call = lambda k, name, command, path: ("s", f"t{k}", k, 0, now - dt.timedelta(seconds=900 - 10 * k), name, "{}", (command, path), False, 30_000, now, k)
    schema = "session_id string, tool_use_id string, seq long, pos int, ts timestamp, tool_name string, input_json string, input struct<command: string, file_path: string>, is_error boolean, result_bytes long, result_ts timestamp, ord int"
    calls = spark.createDataFrame([call(k, "Bash", "grep x", None) for k in range(12)] + [call(20 + k, "Read", None, "/again") for k in range(4)], schema)
    taken = "## Key files\nLoad these files once into context"
    native = "## Prefer native tools and path-safe shell usage\nchoose native tools or path-safe alternatives before Bash"
    config = lambda *texts: spark.createDataFrame([("instructions", t) for t in texts], "key string, value string")
    chosen = {"workflow.native-bypass", "workflow.redundant-reads"}
    kept, rules.RULES[:] = list(rules.RULES), [r for r in rules.RULES if r.id in chosen]
    try:
        folder = str(tmp_path / "receipts")
        run = lambda n, *texts: {(r["finding_id"], r["kind"], r["marker_heading"]) for r in adoption.record(rules.Signals(now, {"tool_calls": calls, "live_config": config(*texts)}), folder, n).collect()}
        assert run(1, native) == {("workflow.native-bypass", "ORGANIC", "Prefer native tools and path-safe shell usage")}  # never shown
        wanted = {("workflow.redundant-reads", "SUPPRESSED", "Key files")}
        assert run(2, native, taken) == wanted | {("workflow.native-bypass", "ORGANIC", "Prefer native tools and path-safe shell usage")}
        again = run(2, native, taken)
        assert again >= wanted and len(again) == 2  # a run done again says the same
        assert run(3, taken) == set()  # suppressed already; the other is shown
        assert run(4, native, taken) == {("workflow.native-bypass", "SUPPRESSED", "Prefer native tools and path-safe shell usage")}
        run(5)  # both are shown once more
        assert {x[0] for x in run(6, taken)} == {"workflow.redundant-reads"}
        rows = adoption.receipts(spark, folder, 7).filter("kind = 'SUPPRESSED'").groupBy("finding_id").count().collect()
        assert {r["finding_id"]: r["count"] for r in rows} == {"workflow.redundant-reads": 2, "workflow.native-bypass": 1}
    finally:
        rules.RULES[:] = kept


def test_sections_meet_what_sessions_do(spark):
    import datetime as dt

    from tracemill.operators import config_attribution as attribution

    at = lambda k: dt.datetime(2026, 1, 1) + dt.timedelta(minutes=k)
    calls = spark.createDataFrame([
        ("a", at(0), "Bash", "npx vite build && vite build", None), ("a", at(1), "Bash", "npm run build", None), ("b", at(2), "Bash", "tsc -b; npx vite build", None), ("c", at(3), "Bash", None, None),
        ("a", at(4), "Grep", None, None), ("b", at(5), "Bash", "ls | grep x; cat y", None), ("b", at(6), "Bash", "echo cat", None),
        ("a", at(7), "Read", None, "/r/REFERENCES.md"), ("a", at(8), "Read", None, "/r/src/lib/parse-a.ts"), ("b", at(9), "Read", None, "parse-b.ts"), ("b", at(10), "Read", None, "references.md"),
        ("c", None, "Read", None, "parse-c.ts"), ("d", at(11), "Write", None, "parse-d.ts"),
    ], "session_id string, ts timestamp, tool_name string, command string, file string")
    sections = spark.createDataFrame([
        (1, "AGENTS.md", "How to Build", []), (2, "README.md", "Build", None), (3, "x", "Prefer Read and Grep", None), (4, "x", "Maps", ["docs/REFERENCES.md", "y"]), (5, None, None, None), (6, "CLAUDE.md", "Deploy", ["REFERENCES.md"]),
    ], "section_id int, scope string, heading string, references array<string>")
    got = {r["section_id"]: (r["signature_id"] and r["signature_id"].split("/")[0], r["attributability"], r["good"], r["bad"], r["sessions"]) for r in attribution.attribute_sections(sections, calls).collect()}
    assert got == {
        1: ("build-command", "attributable", 2, 2, 2), 2: (None, "unfalsifiable", None, None, None), 3: ("native-tool", "attributable", 1, 2, 2), 4: ("key-file-pin", "attributable", 1, 1, 2),
        5: (None, "unfalsifiable", None, None, None), 6: ("build-command", "attributable", 2, 2, 2),
    }
    assert {r["attributability"] for r in attribution.attribute_sections(sections, calls.limit(0)).collect()} == {"unattributable", "unfalsifiable"}
