import json

import pytest

from tracemill.sources.transcripts import Transcripts, history_only, read_history, read_lines


def assistant(ts, mid, usage=None, content=None, model="m-1", **more):
    return {"type": "assistant", "timestamp": ts, "message": {"id": mid, "model": model, "usage": usage or {}, "content": content or []}, **more}


@pytest.fixture(scope="module")
def t(spark, tmp_path_factory):
    folder = tmp_path_factory.mktemp("corpus") / "projects" / "alpha"
    folder.mkdir(parents=True)
    lines = [
        {"type": "user", "timestamp": "2026-01-01T10:00:00Z", "permissionMode": "plan", "message": {"role": "user", "content": "please fix it"}, "entrypoint": "cli", "version": "1.2"},
        {"type": "user", "timestamp": "2026-01-01T10:00:01Z", "message": {"content": [{"type": "tool_result", "tool_use_id": "t1", "is_error": True, "content": "boom"}]}},
        assistant("2026-01-01T10:00:02Z", "a", {"input_tokens": 5, "output_tokens": 10, "cache_read_input_tokens": 3}, [{"type": "thinking", "thinking": "hm"}]),
        assistant("2026-01-01T10:00:03Z", "a", {"input_tokens": 5, "output_tokens": 40, "cache_read_input_tokens": 3}, [{"type": "text", "text": "x" * 26}]),
        assistant("2026-01-01T10:00:04Z", "a", {"input_tokens": 5, "output_tokens": 30}, [{"type": "tool_use", "id": "t1", "name": "Bash", "input": {"command": "ls"}}, {"type": "tool_use", "id": "t2", "name": "Read", "input": {"file_path": "/a"}}]),
        {"type": "system", "subtype": "api_error", "timestamp": "2026-01-01T10:01:00Z", "level": "error", "error": {"status": 529, "error": {"error": {"type": "overloaded_error", "message": "busy"}}}, "retryAttempt": 4},
        {"type": "system", "subtype": "stop_hook_summary", "timestamp": "2026-01-01T10:02:00Z", "hookCount": 1, "hookInfos": [{"command": "x", "durationMs": 4000000}], "hookErrors": ["e"], "preventedContinuation": True},
        {"type": "attachment", "timestamp": "2026-01-01T10:03:00Z", "attachment": {"type": "deferred_tools_delta", "addedNames": ["Bash", "Web"], "removedNames": []}},
        {"type": "attachment", "timestamp": "2026-01-01T10:04:00Z", "attachment": {"type": "deferred_tools_delta", "addedNames": ["Map"], "removedNames": ["Web"]}},
        {"type": "ai-title", "aiTitle": "made"},
        {"type": "custom-title", "customTitle": "chosen"},
        {"type": "user", "timestamp": "2026-01-01T10:05:00Z", "permissionMode": "bypassPermissions", "message": json.dumps({"role": "user", "content": "a string message"})},
    ]
    (folder / "s1.jsonl").write_text("\n".join([json.dumps(x) for x in lines] + ["{not json", ""]))
    sub = folder / "s1" / "subagents"
    sub.mkdir(parents=True)
    (sub / "agent.jsonl").write_text(json.dumps(assistant("2026-01-01T10:06:00Z", "b", {"input_tokens": -4, "output_tokens": 1}, attributionAgent="helper", entrypoint="sdk-py")))
    return Transcripts(read_lines(spark, str(folder.parent.parent)))


def test_messages_merge(t):
    a = {r["message_id"]: r for r in t.token_entries.collect()}
    assert (a["a"]["input"], a["a"]["output"], a["a"]["cache_read"]) == (5, 40, 3)
    assert a["a"]["tool_use_ids"] == ["t1", "t2"]
    assert a["a"]["visible"] == 10 + 20 and a["a"]["thinking"] == 40 - a["a"]["visible"]
    assert a["b"]["input"] == 0 and a["b"]["session_id"] == "s1"


def test_tool_results_may_come_first_or_never(t):
    calls = {r["tool_use_id"]: r for r in t.tool_calls.collect()}
    assert calls["t1"]["is_error"] is True and calls["t1"]["result_bytes"] == 4
    assert calls["t2"]["is_error"] is None and calls["t2"]["input"]["file_path"] == "/a"


def test_events(t):
    assert [(r["status"], r["cause_code"], r["retryAttempt"]) for r in t.api_errors.collect()] == [(529, "overloaded_error", 4)]
    hook = t.stop_hooks.first()
    assert hook["timed_ms"] is None and hook["errors"] == 1 and hook["preventedContinuation"]
    assert [(r["was"], r["mode"]) for r in t.permission_changes.collect()] == [("plan", "bypassPermissions")]


def test_sessions_and_inventory(t):
    s = t.sessions.first()
    assert (s["session_id"], s["title"], s["entrypoint"], s["project"], s["unattended"]) == ("s1", "chosen", "cli", "alpha", False)
    i = t.tool_inventory.first()
    assert i["available"] == ["Bash", "Map"] and i["used"] == ["Bash"] and i["unused"] == ["Map"]
    assert [tuple(r) for r in t.attribution.collect()] == [("s1", "agent", "helper", 1, 1)]


def test_string_messages_and_order(t):
    texts = [r["summary"] for r in t.timeline.filter("kind = 'user'").orderBy("ord").collect()]
    assert texts == ["please fix it", "a string message"]


def test_history(spark, tmp_path, t):
    rows = [{"display": "/clear", "timestamp": 1767261600000, "project": "/p", "sessionId": "s1", "pastedContents": {}}, {"display": "hello", "timestamp": 1767261600000, "project": "/p", "sessionId": "s9", "pastedContents": {}}]
    (tmp_path / "history.jsonl").write_text("\n".join(map(json.dumps, rows)) + "\nbroken")
    h = read_history(spark, str(tmp_path / "history.jsonl"))
    assert sorted((r["session_id"], r["human"]) for r in h.collect()) == [("s1", False), ("s9", True)]
    assert [r["session_id"] for r in history_only(h, t.sessions).collect()] == ["s9"]


def test_transcripts_to_ranked_recommendations(spark, tmp_path):
    """Lines in, recommendations out: prices by model, calls, errors, steering and settings on the way."""
    import datetime as dt

    from tracemill.plans import artifact_rules, rules  # noqa: F401  the former registers its rules
    from tracemill.sources.signals import from_transcripts

    folder = tmp_path / "projects" / "beta"
    folder.mkdir(parents=True)
    for n in range(5):
        at = lambda k: f"2026-01-1{n}T10:{k:02d}:00Z"  # noqa: B023, E731
        lines = [{"type": "user", "timestamp": at(0), "permissionMode": "bypassPermissions", "message": {"content": "please fix it"}}]
        for k in range(1, 7):
            tool = {"type": "tool_use", "id": f"t{k}", "name": "Bash", "input": {"command": "rm -rf /tmp/x" if k == 6 else "grep foo ."}}
            lines.append(assistant(at(2 * k), f"m{k}", {"input_tokens": 100_000 * (n + 1), "output_tokens": 10_000, "cache_read_input_tokens": 1}, [tool], model="claude-opus-4-8[1m]" if k < 6 else "gpt-x"))
            lines.append({"type": "user", "timestamp": at(2 * k + 1), "message": {"content": [{"type": "tool_result", "tool_use_id": f"t{k}", "is_error": k % 2 == 0, "content": "x" * 30}]}})
        lines.append({"type": "user", "timestamp": at(30), "message": {"content": "no, that is wrong"}})
        (folder / f"s{n}.jsonl").write_text("\n".join(map(json.dumps, lines)))
    t = Transcripts(read_lines(spark, str(tmp_path)))
    now = dt.datetime(2026, 1, 20)
    s = from_transcripts(t, now)
    first = t.token_entries.filter("session_id = 's0'").count()
    assert first == 6 and s.steering.filter("corrections = 1 AND turns = 1").count() == 5
    spend = rules.session_costs(s).filter("session_id = 's1'").first()
    assert abs(spend["cost"] - 5 * (200_000 * 5 + 10_000 * 25 + 0.5) / 1e6) < 1e-9 and spend["unknown"]
    got = rules.build(s).collect()
    by = {r["id"]: r for r in got}
    assert {"safety.dangerous-bypass", "safety.risky-actions", "reliability.tool-errors", "workflow.native-bypass", "cost.unknown-model", "context.over-window"} <= set(by)
    assert by["workflow.native-bypass"]["affected"] == 25 and by["cost.unknown-model"]["affected"] == 5 and by["reliability.tool-errors"]["affected"] == 15
    assert [r["severity_rank"] for r in got] == sorted((r["severity_rank"] for r in got), reverse=True)
    quiet = from_transcripts(t, now, live_config=spark.createDataFrame([("hooks.PostToolUse.matcher", "Edit|Write")], "key string, value string"))
    assert "reliability.tool-errors" not in {r["id"] for r in rules.build(quiet, spark.createDataFrame([("cost.unknown-model",)], "id string")).collect()}


def test_lines_keep_their_order(spark, tmp_path):
    folder = tmp_path / "projects" / "p"
    (folder / "s" / "subagents").mkdir(parents=True)
    (folder / "s.jsonl").write_text("\n".join(json.dumps({"type": "user", "n": i, "pad": "x" * 200}) for i in range(3000)))
    for name in ("b", "a"):
        (folder / "s" / "subagents" / f"{name}.jsonl").write_text("\n".join(json.dumps({"type": "user", "n": name + str(i)}) for i in range(3)))
    old = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "50000")  # several blocks a file
    try:
        got = [json.loads(r["line"])["n"] for r in read_lines(spark, str(tmp_path)).orderBy("session_id", "seq").collect()]
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", old)
    assert got == [*range(3000), "a0", "a1", "a2", "b0", "b1", "b2"]
