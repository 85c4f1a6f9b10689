"""Task success, claims, scorecards, verdicts, recurring runs and exact quantiles on small cases whose results are known."""

import json
import random

import pytest
from pyspark.sql import functions as F

from tracemill.operators import deceit, quantiles, scorecards, task_success, trajectories
from tracemill.sources.transcripts import Transcripts

DAY = "2026-01-01T00:00:{:02d}.000Z"


def user(content, at):
    return {"type": "user", "timestamp": at, "message": {"role": "user", "content": content}}


def agent(blocks, at):
    return {"type": "assistant", "timestamp": at, "message": {"role": "assistant", "content": blocks}}


def words(text):
    return {"type": "text", "text": text}


def stop(at):
    return {"type": "system", "subtype": "stop_hook_summary", "timestamp": at, "hookCount": 1, "hookInfos": [{"durationMs": 10}], "hookErrors": [], "preventedContinuation": False}


def tool(number, name, **given):
    return {"type": "tool_use", "id": number, "name": name, "input": given}


def result(number, content, error=False):
    return {"type": "tool_result", "tool_use_id": number, "content": content, "is_error": error}


def transcripts(spark, sessions):
    rows = [(s, f"{n:05d}", json.dumps(line)) for s, lines in sessions.items() for n, line in enumerate(lines)]
    return Transcripts(spark.createDataFrame(rows, "session_id string, seq string, line string"))


def worked(opener, path, after, later=()):
    """A session that edits a file, says it is done and hears `after`."""
    lines = [user(opener, DAY.format(0)), agent([tool("t1", "Edit", file_path=path), words(f"Done, fixed {path}.")], DAY.format(1)), user([result("t1", "edited")], DAY.format(2)), stop(DAY.format(3))]
    return lines + [user(after, DAY.format(4))] + [user(text, at) for text, at in later]


def test_task_success_from_transcripts(spark):
    sessions = {
        "accepted": worked("build it", "src/Accepted.tsx", "thanks, merge it"),
        "corrected": worked("fix the bug", "src/Corrected.tsx", "no, that's broken"),
        "demoted": worked("fix src/Widget.tsx", "src/Widget.tsx", "now check the logs"),
        "quiet": worked("fix src/Panel.tsx", "src/Panel.tsx", "now look at the logs"),
        "returned": worked("fix src/Back.tsx", "src/Back.tsx", "now look at the logs"),
        "complains": [user("no, Widget.tsx is still broken", "2026-01-02T00:00:00.000Z"), user("no, Accepted.tsx is still broken", "2026-01-02T00:00:01.000Z"), user("a word on Back.tsx", "2026-01-03T00:00:00.000Z")],
        "stuck": [user("go", DAY.format(0)), agent([tool("t2", "Bash", command="ls"), words("I am blocked on access.")], DAY.format(1)), user([result("t2", "no", True)], DAY.format(2)), stop(DAY.format(3))],
        "mute": [user("go", DAY.format(0)), stop(DAY.format(3)), stop(DAY.format(3)), user("", "2026-01-20T00:00:00.000Z"), user("unrelated", "2026-01-20T00:00:00.000Z")],
        "no stop": [user("go", DAY.format(0))],
    }
    got = {(r["session_id"], r["task"]): r for r in task_success.from_transcripts(transcripts(spark, sessions)).collect()}
    shown = lambda s, t=0: tuple(got[s, t][c] for c in ("verdict", "claim", "confidence", "score", "recurrence"))
    assert shown("accepted") == ("accept", "completed", "high", 1.0, None)
    assert shown("corrected") == ("correct", "completed", "high", 0.0, None)
    assert shown("demoted") == ("correct", "completed", "high", 0.0, "demoted")
    assert got["demoted", 0]["topic"] == "widget.tsx" and got["demoted", 0]["proof_session"] == "complains"
    assert shown("quiet") == ("neutral", "completed", "high", 0.9, "corroborated") and got["quiet", 0]["topic"] == "panel.tsx"
    assert shown("returned") == ("neutral", "completed", "med", 0.72, None)
    assert shown("stuck") == ("none", "blocked", "low", 0.0, None)  # 0.2 less the penalty of 0.35
    assert shown("mute") == ("none", "none", "unknown", 0.5, None) and shown("mute", 1) == ("neutral", "none", "unknown", 0.5, None)
    assert len(got) == 8
    first = got["accepted", 0]
    assert (first["tool_calls"], first["mutating_calls"], first["tool_results"], first["tool_errors"], first["backed"]) == (1, 1, 1, 0, True)


def test_silence_counts_only_when_it_was_watched(spark):
    watched = worked("fix src/Panel.tsx", "src/Panel.tsx", "next", [("hello", "2026-01-14T00:00:00.000Z")])
    got = task_success.from_transcripts(transcripts(spark, {"s": watched})).first()
    assert (got["recurrence"], got["confidence"], got["score"]) == (None, "med", 0.72)
    got = task_success.from_transcripts(transcripts(spark, {"s": watched + [user("hello", "2026-01-15T00:00:03.000Z")]})).first()
    assert (got["recurrence"], got["score"]) == ("corroborated", 0.9)


def test_words_are_told_apart(spark):
    said = ["lgtm", "stop here", "stop there", "stop it", "actually use b", "<system-reminder>wrong</system-reminder> great", "<task-notification id=1>\nno, wrong", None, "it still fails", "don't", "now the docs", "yes, please"]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(said)], "i int, t string")
    got = [r[0] for r in df.orderBy("i").select(task_success.verdict_of(F.col("t"))).collect()]
    assert got == ["accept", "neutral", "neutral", "correct", "correct", "accept", "correct", "none", "correct", "correct", "neutral", "accept"]
    claims = ["All is implemented.", "It is not yet done", "I need your approval for it", "hm", "tests passed", None]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(claims)], "i int, t string")
    assert [r[0] for r in df.orderBy("i").select(task_success.claim_of(F.col("t"))).collect()] == ["completed", "none", "blocked", "none", "completed", "none"]
    texts = ["see #12 and src/a/B.py, index.ts", "'lib/x.yaml' (x.yaml)", None]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string")
    assert [r[0] for r in df.orderBy("i").select(task_success.topics_of(F.col("t"))).collect()] == [["#12", "b.py"], ["x.yaml"], []]


def test_claims_against_the_record(spark):
    run = lambda n, out, error=False: [agent([tool(n, "Bash", command="npm run test")], DAY.format(1)), user([result(n, out, error)], DAY.format(2))]
    say = lambda text: [agent([words(text)], DAY.format(5))]
    sessions = {
        "caveat": run("a", "3 tests failed", True) + say("All tests pass, the failures are pre-existing."),
        "earlier": run("b", "ok") + say("I just ran the tests."),
        "zero": run("c", "0 failed, exit code 0") + say("All green."),
        "bare": say("I ran the tests.") + say("I've run the suite."),
        "wrong": run("d", "exit code 1") + say("Everything passes."),
        "flag": run("e", "boom", True) + say("lint clean"),
        "mended": run("f", "2 failed") + run("g", "0 failed") + say("all green"),
        "early": say("all green") + run("h", "2 failed"),
        "unable": say("I cannot run the tests here, so I have tested nothing."),
        "weak": say("I've confirmed it by reading. I checked the imports."),
        "other": say("I didn't touch the config. I ran the tests."),
        "many": [line for k in range(7) for line in say(f"I ran the tests {k}")],
    }
    got = {r["session_id"]: r for r in deceit.from_transcripts(transcripts(spark, sessions)).collect()}
    counts = {s: (r["unbacked"], r["contradicted"]) for s, r in got.items()}
    assert counts == {"caveat": (0, 0), "earlier": (0, 0), "zero": (0, 0), "bare": (2, 0), "wrong": (0, 1), "flag": (0, 1), "mended": (0, 0), "early": (0, 0), "unable": (0, 0), "weak": (0, 0), "other": (1, 0), "many": (7, 0)}
    assert got["earlier"]["backed"] == 1 and got["wrong"]["snippets"] == ["Everything passes."] and len(got["many"]["snippets"]) == 5 and got["weak"]["snippets"] == []


def test_scorecard_axes(spark):
    base = dict(session_id="", has_tokens=True, cost=0.5, peak=40_000.0, window=200_000.0, has_tools=True, has_timeline=True, calls=4, user_turns=3, minutes=3.0, permission_rows=1, good=True)
    cases = {
        "well": {},
        "dear": dict(cost=12.0, peak=250_000.0, compactions=2, growth_per_hour=60_000.0, unknown_model=True),
        "half": dict(peak=120_000.0),
        "long window": dict(peak=400_000.0, window=1_000_000.0),
        "no window": dict(peak=400_000.0, window=None),
        "labelled": dict(labelled=True),
        "bad": dict(good=False, tool_errors=2, api_errors=3, api_recovered=1, hook_errors=1, hooks=2),
        "risky": dict(bypass=True, dangerous_high=1, dangerous_medium=1),
        "nothing": dict(has_tokens=False, cost=None, peak=None, window=None, has_tools=False, has_timeline=False, calls=0, permission_rows=0, good=None),
        "one call": dict(calls=1),
        "spans": dict(task_spans=3, repeats=2, files=21),
    }
    rows = [{**base, "compactions": 0, "growth_per_hour": 0.0, "unknown_model": False, "labelled": False, "tool_errors": 0, "api_errors": 0, "api_recovered": 0, "hook_errors": 0, "hooks": 0, "bypass": False, "dangerous_high": 0, "dangerous_medium": 0, "task_spans": 1, "repeats": 0, "files": 3, **c, "session_id": s} for s, c in cases.items()]
    schema = "session_id string, has_tokens boolean, cost double, peak double, window double, has_tools boolean, has_timeline boolean, calls int, user_turns int, minutes double, permission_rows int, good boolean, compactions int, growth_per_hour double, unknown_model boolean, labelled boolean, tool_errors int, api_errors int, api_recovered int, hook_errors int, hooks int, bypass boolean, dangerous_high int, dangerous_medium int, task_spans int, repeats int, files int"
    names = [f.split()[0] for f in schema.split(", ")]
    df = spark.createDataFrame([tuple(r[n] for n in names) for r in rows], schema)
    got = {(r["session_id"], r["axis"]): (r["score"], r["confidence"]) for r in scorecards.session_scorecard(df).collect()}
    of = lambda s: {a: got[s, a] for a in scorecards.AXES}
    assert of("well") == {"cost": (100, "high"), "outcome": (94, "medium"), "speed": (95, "medium"), "security": (100, "high"), "portability": (100, "high"), "reliability": (100, "high"), "focus": (100, "high")}
    assert got["dear", "cost"] == (0, "high") and got["dear", "focus"] == (44, "high") and got["dear", "outcome"] == (64, "medium")
    assert got["half", "cost"] == (82, "high") and got["half", "focus"] == (85, "high")
    assert got["long window", "cost"] == got["no window", "cost"] == (100, "high")
    assert got["labelled", "outcome"] == (100, "high")
    assert got["bad", "outcome"] == (42, "medium") and got["bad", "reliability"] == (100 - 45 - 20 - 4 - 8, "high")
    assert got["risky", "security"] == (30, "medium")
    assert set(of("nothing").values()) == {(50, "low")}
    assert got["one call", "portability"] == (70, "medium")
    assert got["spans", "focus"] == (100 - 15 - 8 - 12, "high")


def test_report_card_blends_attribution_and_drag(spark):
    reg = lambda cwd, entries: [(f"{cwd}{i}", cwd, e) for i, e in enumerate(entries)]
    registry = spark.createDataFrame(reg("/keep", ["cli"] * 4) + reg("/move", ["cli"] * 4) + reg("/split", ["cli", "sdk-py", "cli", "sdk-py"]) + reg("/few", ["cli"] * 2) + reg("/drag", ["cli"] * 3) + reg("/dark", ["cli"] * 3), "session_id string, cwd string, entrypoint string")
    telemetry = spark.createDataFrame([("/move0", 9, 70_000.0), ("/drag0", 4, 10.0), ("/keep0", 1, 10.0), ("lost1", 1, 1.0), ("unknown", 1, 1.0)], "session_id string, attempt int, wasted_ms double")
    debug = spark.createDataFrame([("/move1", 2, 6000.0, 0), ("/keep1", 1, 100.0, 1)], "session_id string, max_attempt int, ttfb_p90_ms double, fast_mode_lost int")
    context = spark.createDataFrame([("lost1", "/found", "cli"), ("unknown", "", "cli"), ("/keep0", "/other", "cli")], "session_id string, cwd string, entrypoint string")
    got = {r["cwd"]: r for r in scorecards.report_card(registry, telemetry, debug, context).collect()}
    assert {c: (r["attribution"], r["drag_score"], r["drag"], r["verdict"]) for c, r in got.items()} == {
        "/keep": ("committed", 0, "OK", "KEEP"), "/move": ("committed", 80, "HEAVY", "MOVE"), "/split": ("split", 0, "OK", "FLAG"), "/few": ("low-signal", 0, "OK", "MOVE"),
        "/drag": ("committed", 40, "DRAG", "FLAG"), "/dark": ("committed", 0, "OK", "FLAG"), "/found": ("low-signal", 0, "OK", "MOVE"),
    }


@pytest.mark.parametrize(
    ("findings", "coverage", "want"),
    [
        ([], [], ("unknown", None)),
        ([], ["CANNOT_SEE"], ("unknown", None)),
        ([], ["PROVE", "CANNOT_SEE"], ("ok", None)),
        ([("a", "cost", "critical")], [], ("unknown", None)),
        ([("a", "cost", "critical"), ("b", "safety", "critical")], ["INFER"], ("critical", "b")),
        ([("a", "safety", "warning"), ("b", "cost", "info")], ["PROVE"], ("attention", "b")),
        ([("a", "safety", "warning")], ["PROVE"], ("attention", "a")),
    ],
)
def test_digest_verdict(spark, findings, coverage, want):
    f = spark.createDataFrame([(*x, n) for n, x in enumerate(findings)], "id string, category string, severity string, rank int")
    c = spark.createDataFrame([(f"d{n}", s) for n, s in enumerate(coverage)], "domain string, status string")
    r = scorecards.digest_verdict(f, c).first()
    assert (r["tone"], r["named"]) == want


def test_empty_domains_say_why(spark):
    f = spark.createDataFrame([("x", "a", 2), ("y", "a", 1)], "id string, domain string, rank int")
    c = spark.createDataFrame([("a", "PROVE", None), ("b", "PROVE", None), ("c", "INFER", None), ("d", "PROVE", "old"), ("e", "CANNOT_SEE", "old")], "domain string, status string, stale_note string")
    d = spark.createDataFrame([(x,) for x in "abcdef"], "domain string")
    got = {r["domain"]: (r["id"], r["level"], r["empty_state"]) for r in scorecards.digest_domains(f, c, d).collect()}
    assert got == {"a": ("y", "healthy", None), "b": (None, "healthy", "clean"), "c": (None, "sparse", "uninstrumented"), "d": (None, "healthy", "stale"), "e": (None, "blind-spot", "uninstrumented"), "f": (None, "blind-spot", "uninstrumented")}


def test_recurring_runs_are_closed(spark):
    tools = {"s1": "ABCDE", "s2": "xABCDEy", "s3": "ABCz", "s4": "AAAA", "s5": "AAAA", "bad": "ABCDE"}
    calls = spark.createDataFrame([(s, i, t) for s, run in tools.items() for i, t in enumerate(run)], "session_id string, ord int, tool string")
    outcomes = spark.createDataFrame([(s, s != "bad") for s in tools], "session_id string, good boolean")
    got = {r["signature"].replace(" -> ", ""): (r["sessions"], r["occurrences"], r["closed"]) for r in trajectories.recurring_runs(calls, outcomes).collect()}
    assert got == {"ABC": (3, 3, True), "BCD": (2, 2, False), "CDE": (2, 2, False), "ABCD": (2, 2, False), "BCDE": (2, 2, False), "ABCDE": (2, 2, True)}
    best = trajectories.best_runs(trajectories.recurring_runs(calls, outcomes)).collect()
    assert [r["signature"].replace(" -> ", "") for r in best] == ["ABC", "ABCDE"]


@pytest.mark.parametrize("limit", [10, 200, 10**6])
def test_quantiles_are_exact(spark, limit):
    import numpy as np

    r = random.Random(8)
    groups = {"even": [r.random() for _ in range(1500)], "hot": [7.0] * 900 + [r.gauss(7, 1) for _ in range(600)], "one": [3.0], "two": [1.0, 2.0], "ints": [float(r.randrange(5)) for _ in range(700)], None: [r.expovariate(1) for _ in range(300)]}
    rows = [(g, v) for g, vs in groups.items() for v in vs] + [("even", None), ("empty", None)]
    r.shuffle(rows)
    df = spark.createDataFrame(rows, "g string, v double").repartition(3)
    qs = [0.0, 0.25, 0.5, 0.9, 0.95, 1.0]
    got = {x["g"]: x for x in quantiles.exact_quantiles(df, ["g"], "v", qs, limit).collect()}
    assert set(got) == set(groups)
    for g, vs in groups.items():
        assert got[g]["n"] == len(vs) and np.allclose(got[g]["q"], np.quantile(vs, qs), rtol=1e-12, atol=1e-12)
    whole = quantiles.exact_quantiles(df, [], "v", [0.5], limit).collect()
    every = [v for vs in groups.values() for v in vs]
    assert len(whole) == 1 and whole[0]["n"] == len(every) and abs(whole[0]["q"][0] - np.median(every)) < 1e-12
    assert quantiles.exact_quantiles(df.filter("v > 1e9"), [], "v", [0.5], limit).count() == 0


def test_retypes_match_all_pairs(spark):
    from tracemill.operators import retypes

    r = random.Random(2)
    day = 86_400_000_000
    base = [[r.choice("alpha beta gamma delta epsilon zeta eta theta iota kappa".split()) + str(r.randrange(9)) + chr(97 + r.randrange(26)) for _ in range(r.choice([8, 14, 30]))] for _ in range(6)]
    rows = []
    for i in range(140):
        w = list(r.choice(base))
        for _ in range(r.choice([0, 0, 1, 3])):
            w[r.randrange(len(w))] = "x" + "".join(r.choices("abcdef", k=4))
        rows.append((f"s{i:03d}", r.choice(["p", "q"]), r.randrange(60 * day), " ".join(w).replace("0", " /src/a.ts ")))
    rows += [("none", "p", 5, None), ("short", "p", 5, "hi"), ("command", "p", 5, "/run " + "alpha beta gamma delta " * 4), ("nowhere", None, 5, rows[0][3]), ("never", "p", None, rows[0][3])]
    df = spark.createDataFrame(rows, "session_id string, project string, us long, opener string")
    sets = {}
    for x in retypes.openers(df).collect():
        sets[x["session_id"]] = (x["us"], set(x["s"]))
    assert not {"none", "short", "command", "nowhere", "never"} & set(sets)
    for window in (7 * day, day):
        links = {a: {b for b in sets if b != a and abs(sets[a][0] - sets[b][0]) <= window and len(sets[a][1] & sets[b][1]) >= 0.5 * len(sets[a][1] | sets[b][1])} for a in sets}
        root = {a: a for a in links if links[a]}
        for _ in root:
            for a in root:
                root[a] = min([root[a], *(root[b] for b in links[a])])
        want = {a: (root[a], sum(v == root[a] for v in root.values()), len(links[a])) for a in root}
        got = {x["session_id"]: (x["cluster"], x["size"], x["links"]) for x in retypes.retype_clusters(df, window).collect()}
        assert got == want and len(want) > 10
    assert retypes.retype_clusters(df.limit(0)).count() == 0


def test_index_search_matches_a_scan(spark, tmp_path):
    import math

    from tracemill.operators import search_index as index

    texts = {1: "Login tokens and sessions expire", 2: "the budget plan", 3: "fix the login bug", 4: None, 5: "", 6: "relogin", 7: "Login bug fix: the login bug fixes", 8: "unrelated words only", 9: "credential credential", 10: "a login, bugs"}
    df = spark.createDataFrame(list(texts.items()), "id long, body string")
    index.build(df, "id", "body", str(tmp_path / "index"))

    def vector(text):
        v = {}
        for t in index.query_terms(text):
            v[t] = v.get(t, 0) + 1
            if t in index.CONCEPT_OF:
                c = f"concept:{index.CONCEPT_OF[t]}"
                v[c] = v.get(c, 0) + index.CONCEPT_WEIGHT
        return v

    for query in ("login bug", "Login", "credentials", "the", "nothing here", "bug login plan", "", "  "):
        want, terms, q = {}, index.query_terms(query), vector(query)
        for i, text in texts.items():
            if not text or not query.strip():
                continue
            lower, v = text.lower(), vector(text)
            lexical = min(1, (0.75 if query.strip().lower() in lower else 0) + (sum(t in lower for t in terms) / len(terms) if terms else 0))
            norm = math.sqrt(sum(x * x for x in v.values()) * sum(x * x for x in q.values()))
            semantic = sum(x * q.get(k, 0) for k, x in v.items()) / norm if norm else 0
            if lexical > 0 or semantic >= index.THRESHOLD:
                want[i] = round(index.LEXICAL * lexical + index.SEMANTIC * semantic, 9)
        got = {r["key"]: round(r["score"], 9) for r in index.search(spark, str(tmp_path / "index"), query).collect()}
        assert got == want, query
    plan = index.search(spark, str(tmp_path / "index"), "credential")._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(bucket" in plan or "bucket#" in plan


def test_values_that_tell(spark):
    from tracemill.operators.text import distinctive_values

    text = "see src/lib/file.ts and deadbeef0123 or ABCDEFABCDEF, HTTP.Client.getName plainwordhere 2024-01-02-03 user_123456789012345 x1:abcdefghi some.lower.name abcdefgh12345678"
    got = spark.createDataFrame([(text,)], "t string").select(distinctive_values("t").alias("v")).first()["v"]
    assert got == ["src/lib/file.ts", "deadbeef0123", "http.client.getname", "123456789012345" if "123456789012345" in got else got[3], *got[4:]] and "some.lower.name" not in got and "abcdefabcdef" not in got and "plainwordhere" not in got
    assert "x1:abcdefghi" in got and "abcdefgh12345678" in got
