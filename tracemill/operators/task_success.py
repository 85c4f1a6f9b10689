"""How well tasks went, told by what the user says next, what the agent claims and what comes back later.

A stop closes a task. What lies before it and after the stop before belongs to it; the user's first
words after it are the verdict. A claim of completion counts less than a verdict, and less still
without a mutation behind it. Topics (issue numbers and file names) tell whether a task that looked
done came back: a correction within fourteen days that shares a topic overrules the claim, and
fourteen days of observed silence corroborate it.

Tasks and turns meet by an index of topics: each topic's task ends and turns are stacked in time and
the nearest one is carried on, so a topic that all sessions share is sorted, not paired.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import materialized
from .sequences import asof

#: The window, the patterns and the names that decide what a text is.
WINDOW_US = 14 * 24 * 3600 * 1_000_000
SYNTHETIC_BLOCK = r"(?is)<\s*(task-notification|system-reminder)\b[^>]*>.*?<\s*/\s*\1\s*>"
SYNTHETIC_LINE = r"(?i)^\s*<\s*(task-notification|system-reminder)\b[^>]*>"
ACCEPT = r"(?i)^(thanks?(?:[,!\s]|$)|thank you\b|looks good\b|lgtm\b|ship it\b|merge it\b|yes[,!\s]+(?:that|this|please|merge)|works\b|perfect\b|great\b|nice\b|approved\b|all good\b|done\b)"
CORRECT = r"(?i)^(no[,!:.\s]+(?:that|this|revert|undo|wrong|broken|not)|actually\b|wait\b|hold on\b|stop\b(?!\s+(here|there)$)|revert\b|undo\b|don'?t\b|do not\b|not that\b|wrong\b|that'?s wrong\b|broken\b|failed\b|you misunderstood\b|instead\b)"
STILL_WRONG = r"(?i)\b(?:still\s+(?:broken|failing|fails?|wrong|not working)|not\s+(?:fixed|working)|doesn'?t\s+work|failed again)\b"
BLOCKED = r"(?i)\b(?:blocked|stuck|cannot proceed|can(?:'|’)?t proceed|unable to proceed|need (?:your|a|the) .{0,40}(?:input|answer|permission|approval)|waiting for)\b"
COMPLETED = r"(?i)\b(?:done|completed|complete|finished|implemented|fixed|added|updated|created|wired|refactored|tests? pass(?:ed)?|all checks (?:green|pass)|build pass(?:es|ed)?|ready)\b"
NOT_COMPLETED = r"(?i)\b(?:not|isn(?:'|’)?t|is not|aren(?:'|’)?t|are not|haven(?:'|’)?t|have not|couldn(?:'|’)?t|could not|didn(?:'|’)?t|did not)\b.{0,32}\b(?:done|complete|finished|implemented|fixed|pass(?:ed|es)?)\b"
ISSUE = r"#\d+\b"
FILE = r"(?i)(?:^|[\s\"'`(\[<{])((?:[\w.-]+/)*[\w.-]+\.(?:tsx?|jsx?|mjs|cjs|json|mdx?|css|scss|py|go|rs|rb|java|ya?ml|toml|sh|sql))"
COMMON_NAMES = ("index.ts", "index.tsx", "index.js", "index.jsx", "types.ts", "types.tsx", "types.js", "types.jsx")
MUTATING_TOOLS = ("Write", "Edit", "MultiEdit", "NotebookEdit")
MUTATING_COMMAND = (
    r"(?i)\b(?:apply_patch|git\s+(?:commit|push|merge|rebase)|npm\s+(?:run|version)|npx\s+(?:tsx|vite|vitest|tsc)|pnpm\s+|yarn\s+|mkdir|rm|mv|cp|chmod|touch|tee\s|sed\s+-i"
    r"|python\b[\s\S]{0,120}\bwrite|podman\s+(?:compose\s+)?up|docker\s+(?:compose\s+)?up|kubectl\s+(?:apply|delete|patch|rollout)|terraform\s+apply)\b"
)
#: Confidence and base score by verdict, claim and whether a mutation backs the claim.
CLAIM_SCORES = (
    ("neutral", "completed", True, "med", 0.72),
    ("neutral", "completed", False, "med", 0.62),
    ("neutral", "blocked", False, "med", 0.25),
    ("none", "completed", True, "low", 0.6),
    ("none", "completed", False, "low", 0.52),
    ("none", "blocked", False, "low", 0.2),
)
PENALTY, ERROR_BASE, UNKNOWN_SCORE, LOOKS_DONE, CORROBORATED = 0.35, 0.45, 0.5, 0.5, 0.9


def verdict_of(text: Column) -> Column:
    """accept, correct, neutral or none: what a user's words say of the task before them."""
    lines = F.split(F.regexp_replace(F.coalesce(text, F.lit("")), SYNTHETIC_BLOCK, " "), "\n")
    own = F.array_join(F.filter(lines, lambda x: ~x.rlike(SYNTHETIC_LINE)), "\n")
    said = F.lower(F.trim(F.regexp_replace(own, r"\s+", " ")))
    return F.when(said == "", "none").when(said.rlike(CORRECT) | said.rlike(STILL_WRONG), "correct").when(said.rlike(ACCEPT), "accept").otherwise("neutral")


def claim_of(text: Column) -> Column:
    """completed, blocked or none: what an agent's words claim."""
    said = F.trim(F.regexp_replace(F.coalesce(text, F.lit("")), r"\s+", " "))
    return F.when(said.rlike(BLOCKED), "blocked").when(said.rlike(COMPLETED) & ~said.rlike(NOT_COMPLETED), "completed").otherwise("none")


def topics_of(text: Column) -> Column:
    """Issue numbers and file names (without folders, but for names that every project has) of a text, sorted."""
    text = F.coalesce(text, F.lit(""))
    names = F.transform(F.regexp_extract_all(text, F.lit(FILE), F.lit(1)), lambda p: F.lower(F.element_at(F.split(p, "/"), -1)))
    return F.array_sort(F.array_distinct(F.concat(F.regexp_extract_all(text, F.lit(ISSUE), F.lit(0)), F.filter(names, lambda n: (n != "") & ~n.isin(*COMMON_NAMES)))))


def mutating(tool: Column, tool_input: Column) -> Column:
    return F.coalesce(tool.isin(*MUTATING_TOOLS) | ((tool == "Bash") & tool_input.rlike(MUTATING_COMMAND)), F.lit(False))


def spans(stops: DataFrame, humans: DataFrame, events: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(spans, topics): a row a stop with its times, counts, verdict and claim; and session_id, task, topic.

    stops: session_id, us. humans: session_id, us, ord, verdict, topics. events: session_id, us, ord, kind
    (assistant_text, tool_use, tool_result), claim, is_error, mutating, topics. Marks without a time are left
    out, and sessions without a stop have no task. A mark at a stop's very time belongs to it.
    """
    order = Window.partitionBy("session_id").orderBy("us")
    ends = stops.filter("us IS NOT NULL").select("session_id", "us", (F.row_number().over(order) - 1).alias("task"), F.lag("us").over(order).alias("prev_us"), F.lead("us").over(order).alias("next_us"))
    mark = ["session_id", "us", "ord", "kind", "verdict", "claim", "is_error", "mutating", "topics"]
    empty = lambda *names: {n: F.lit(None).cast(t) for n, t in (("verdict", "string"), ("claim", "string"), ("is_error", "boolean"), ("mutating", "boolean")) if n in names}
    said = humans.withColumn("kind", F.lit("human")).withColumns(empty("claim", "is_error", "mutating")).select(*mark)
    done = events.withColumns(empty("verdict")).select(*mark)
    closing = ends.select("session_id", "us").withColumn("kind", F.lit("stop"))
    stacked = said.unionByName(done).filter("us IS NOT NULL").unionByName(closing, allowMissingColumns=True)
    is_stop = (F.col("kind") == "stop").cast("int")
    before = Window.partitionBy("session_id").orderBy("us", is_stop).rowsBetween(Window.unboundedPreceding, -1)
    marks = stacked.withColumn("task", F.coalesce(F.sum(is_stop).over(before), F.lit(0)).cast("int")).filter("kind <> 'stop'")

    counted = lambda kind, also=F.lit(True): F.count_if((F.col("kind") == kind) & also)
    claims = F.when((F.col("kind") == "assistant_text") & (F.col("claim") != "none"), F.struct("us", "ord", "claim"))
    inside = marks.groupBy("session_id", "task").agg(
        F.min("us").alias("first_us"), counted("tool_use").alias("tool_calls"), counted("tool_use", F.col("mutating")).alias("mutating_calls"),
        counted("tool_result").alias("tool_results"), counted("tool_result", F.col("is_error")).alias("tool_errors"), F.max(claims)["claim"].alias("claim"),
    )
    after = marks.filter("kind = 'human' AND task > 0").withColumn("task", F.col("task") - 1).join(ends.select("session_id", "task", "next_us"), ["session_id", "task"]).filter("next_us IS NULL OR us < next_us")
    verdicts = after.groupBy("session_id", "task").agg(F.min_by("verdict", F.struct("us", "ord")).alias("verdict"))
    rows = ends.join(inside, ["session_id", "task"], "left").join(verdicts, ["session_id", "task"], "left")
    zero = lambda c: F.coalesce(c, F.lit(0)).cast("bigint").alias(c)
    found = rows.select(
        "session_id", "task", F.coalesce("prev_us", "first_us", "us").alias("start_us"), F.col("us").alias("end_us"), F.coalesce("verdict", F.lit("none")).alias("verdict"),
        F.coalesce("claim", F.lit("none")).alias("claim"), *map(zero, ("tool_calls", "mutating_calls", "tool_results", "tool_errors")),
    )
    topics = marks.select("session_id", "task", F.explode("topics").alias("topic")).distinct()
    return found, topics.join(ends.select("session_id", "task"), ["session_id", "task"], "left_semi")


def scored(found: DataFrame) -> DataFrame:
    """Spans with confidence, score, verdict_score, claim_score, error_penalty and backed (a mutation stands behind the claim)."""
    rate = F.coalesce(F.try_divide("tool_errors", "tool_results"), F.lit(0.0))
    rows = found.withColumn("backed", (F.col("claim") == "completed") & (F.col("mutating_calls") > 0)).withColumn("error_rate", rate)
    base, trust = F.lit(None).cast("double"), F.lit(None).cast("string")
    for verdict, claim, backed, confidence, points in CLAIM_SCORES:
        here = (F.col("verdict") == verdict) & (F.col("claim") == claim) & (F.col("backed") == backed)
        base, trust = F.when(here, points).otherwise(base), F.when(here, confidence).otherwise(trust)
    told = {"accept": 1.0, "correct": 0.0}
    final = F.when(F.col("verdict") == "accept", told["accept"]).when(F.col("verdict") == "correct", told["correct"])
    penalty = F.least(F.lit(PENALTY), F.col("error_rate") * PENALTY)
    rows = rows.withColumn("claim_score", F.when(final.isNull(), base)).withColumn("_final", final).withColumn("_trust", trust)
    silent = F.col("_final").isNull() & F.col("claim_score").isNull()
    rows = rows.withColumn("error_penalty", F.when(F.col("_final").isNotNull() | (silent & (F.col("tool_errors") == 0)), 0.0).otherwise(penalty))
    worth = F.coalesce("claim_score", F.when(F.col("tool_errors") > 0, ERROR_BASE).otherwise(UNKNOWN_SCORE))
    confidence = F.when(F.col("_final").isNotNull(), "high").when(F.col("claim_score").isNotNull(), F.col("_trust")).when(F.col("tool_errors") > 0, "low").otherwise("unknown")
    verdict_score = F.coalesce("_final", F.when((F.col("verdict") == "neutral") & F.col("claim_score").isNotNull(), 0.5))
    rows = rows.withColumn("confidence", confidence).withColumn("verdict_score", verdict_score).withColumn("score", F.round(F.coalesce("_final", F.greatest(F.lit(0.0), worth - F.col("error_penalty"))), 3))
    return rows.withColumn("error_rate", F.round("error_rate", 3)).withColumn("error_penalty", F.round("error_penalty", 3)).drop("_final", "_trust")


def with_recurrence(found: DataFrame, topics: DataFrame, turns: DataFrame) -> DataFrame:
    """Scored spans after what came back: recurrence (demoted, corroborated or null), its topic, the turn that proves it, and how far was observed.

    turns: session_id, us, ord, verdict, topics (of every real human turn). A corrective turn demotes the
    task that ended last before it, within the window, among those that look done and share a topic
    (ties: the smallest session and task); of several turns the last is the proof.
    """
    key = ["session_id", "task"]
    looks_done = (F.col("claim") == "completed") & F.col("backed") & (F.col("score") >= LOOKS_DONE)
    done = found.filter(looks_done).join(topics, key)
    at = done.groupBy("topic", "end_us").agg(F.min(F.struct("session_id", "task")).alias("who")).select("topic", (F.col("end_us") + 1).alias("from_us"), F.struct("end_us", "who").alias("span"))
    spoken = turns.filter("us IS NOT NULL").select(F.struct("us", "ord", "session_id").alias("turn"), "us", "verdict", F.explode("topics").alias("topic")).distinct()

    corrections = spoken.filter("verdict = 'correct'")
    met = asof(corrections, at, ["topic"], "us", "from_us", "span", out="hit").filter(F.col("hit").isNotNull() & (F.col("us") - F.col("hit.end_us") <= WINDOW_US))
    target = met.groupBy("turn").agg(F.min(F.struct((-F.col("hit.end_us")).alias("less"), "hit.who")).alias("t")).select("turn", "t.who.session_id", "t.who.task")
    target = target.join(found.filter("verdict <> 'accept'").select(*key), key)
    shared = target.join(corrections.select("turn", "topic"), "turn").join(topics, [*key, "topic"]).groupBy(*key, "turn").agg(F.min("topic").alias("topic"))
    demoted = shared.groupBy(*key).agg(F.max(F.struct("turn", "topic")).alias("d"))

    heard = spoken.groupBy("topic", "us").agg(F.lit(True).alias("there")).withColumn("before_us", F.col("us") - 1).drop("us")
    silent = done.filter("confidence <> 'high'").select(*key, "topic", "end_us")
    back = asof(silent, heard, ["topic"], "end_us", "before_us", "there", forward=True, out="next")
    quiet = back.groupBy(*key).agg(F.max(F.coalesce(F.col("next_time") + 1 - F.col("end_us") <= WINDOW_US, F.lit(False))).alias("returned"), F.min("topic").alias("first_topic")).filter("NOT returned")
    seen = turns.agg(F.max("us").alias("observed_us"))  # one row
    rows = found.join(demoted, key, "left").join(quiet.select(*key, "first_topic"), key, "left").crossJoin(F.broadcast(seen))
    down = F.col("d").isNotNull()
    up = ~down & F.col("first_topic").isNotNull() & (F.col("observed_us") - F.col("end_us") >= WINDOW_US)
    return rows.select(
        *[c for c in found.columns if c not in ("verdict", "confidence", "score", "verdict_score")],
        F.when(down, "correct").otherwise(F.col("verdict")).alias("verdict"), F.when(down | up, "high").otherwise(F.col("confidence")).alias("confidence"),
        F.when(down, 0.0).when(up, F.greatest("score", F.lit(CORROBORATED))).otherwise(F.col("score")).alias("score"), F.when(down, 0.0).otherwise(F.col("verdict_score")).alias("verdict_score"),
        F.when(down, "demoted").when(up, "corroborated").alias("recurrence"), F.when(down, F.col("d.topic")).when(up, F.col("first_topic")).alias("topic"),
        F.col("d.turn.session_id").alias("proof_session"), F.col("d.turn.us").alias("proof_us"), F.when(up, F.col("observed_us")).alias("observed_until_us"),
    )


def task_success(stops: DataFrame, humans: DataFrame, events: DataFrame) -> DataFrame:
    """Every task's span, scored, after what came back later."""
    found, topics = spans(stops, humans, events)
    return with_recurrence(materialized(scored(found)), materialized(topics), humans)


def from_transcripts(t) -> DataFrame:
    """task_success of transcripts (sources.transcripts.Transcripts): stops are the stop hooks, humans the user's own texts."""
    from .sequences import micros

    line = t.timeline.withColumn("us", micros("ts"))
    own = line.filter((F.col("kind") == "user") & F.coalesce(F.col("summary"), F.lit("")).rlike(r"^\s*[^/\s<]"))
    humans = own.select("session_id", "us", "ord", verdict_of(F.col("summary")).alias("verdict"), topics_of(F.col("summary")).alias("topics"))
    text = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("ord", "summary"))), lambda x: x["summary"]), "\n")  # the blocks of one message
    words = line.filter("kind = 'assistant'").groupBy("session_id", "seq").agg(F.min("us").alias("us"), F.min("ord").alias("ord"), text.alias("text"))
    no = F.lit(False)
    said = words.select("session_id", "us", "ord", F.lit("assistant_text").alias("kind"), claim_of(F.col("text")).alias("claim"), no.alias("is_error"), no.alias("mutating"), topics_of(F.col("text")).alias("topics"))
    tools = line.filter("kind IN ('tool_use', 'tool_result')").select(
        "session_id", "us", "ord", "kind", F.lit("none").alias("claim"), F.coalesce("is_error", no).alias("is_error"), ((F.col("kind") == "tool_use") & mutating(F.col("tool_name"), F.col("summary"))).alias("mutating"),
        F.when(F.col("kind") == "tool_use", topics_of(F.col("summary"))).otherwise(F.array().cast("array<string>")).alias("topics"),
    )
    return task_success(t.stop_hooks.select("session_id", micros("ts").alias("us")), humans, said.unionByName(tools))
