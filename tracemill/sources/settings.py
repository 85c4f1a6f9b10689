"""Settings in force: settings files and instruction files as (key, value) rows, and the rules they already answer.

A rule falls silent once what it would advise is there: a setting or hook in a settings file, or its advice in
the instruction files, told by a heading and a phrase that both have to occur in their merged text.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

SETTINGS = """cleanupPeriodDays double, model string, autoCompactEnabled boolean, permissions struct<allow array<string>, ask array<string>, deny array<string>>,
  hooks map<string, array<struct<matcher string, hooks array<struct<command string>>>>>"""
INSTRUCTIONS = "instructions"

#: A rule, the key that answers it, and what a value of the key has to match.
SETTING_ANSWERS = (
    ("activity.stale-projects", "cleanupPeriodDays", r"^\d"),
    ("reliability.tool-errors", "hooks.PostToolUse.matcher", r"\bEdit\b|\bWrite\b"),
    ("workflow.low-tool-effectiveness", "hooks.PostToolUse.matcher", r"\bEdit\b|\bWrite\b"),
    ("workflow.tool-undo-rate", "hooks.PreToolUse.matcher", r"\bEdit\b|\bWrite\b"),
    ("reliability.cwd-drift-execution", "hooks.PreToolUse.command", "cwd-anchor-guard"),
    ("cost.unknown-model", "model", "."),
    ("cost.legacy-model-overpay", "model", "."),
    ("cost.expensive-agent-type", "model", r"(?i)\bhaiku\b"),
    ("cost.automation-share", "model", r"(?i)\bhaiku\b"),
    ("context.repeated-compactions", "autoCompactEnabled", "^false$"),
)
#: A rule, the heading and the phrase that show its advice was taken.
MARKERS = (
    ("reliability.tool-errors", r"^##\s+Claude Coach Adopted Recommendations\b", "Tools with high error rates"),
    ("reliability.api-errors", r"^##\s+Rate-limit hygiene\b", "Avoid launching many parallel agent runs"),
    ("reliability.stale-state-assertion", r"^##\s+Fetch before asserting repo state\b", "local tree can sit many commits behind origin"),
    ("reliability.cwd-drift-execution", r"^##\s+Anchor (?:repo|git)\b", "silently targets the wrong repository"),
    ("reliability.discovery-freshness", r"^##\s+Read freshness\b", "re-read the target after the ref moves before acting"),
    ("workflow.human-input-leverage", r"^##\s+(?:Ask(?:ing)? upfront|Human input|Value of human input|Upfront questions)\b", "ask the human upfront"),
    ("workflow.native-bypass", r"^##\s+Prefer native tools and path-safe shell usage\b", "choose native tools or path-safe alternatives before Bash"),
    ("workflow.value-of-agent-handoff", r"^##\s+(?:Agent handoff|Handoff artifacts|Durable state handoff|Runbooks for durable state)\b", "durable external state changes need a handoff artifact"),
    ("workflow.session-restart-retype", r"^##\s+Resume prior sessions instead of re-?typing\b", "resume the prior session instead of re-explaining the task"),
    ("workflow.redundant-reads", r"^##\s+Key files\b", "Load these files once into context"),
    ("workflow.shadow-prompt", r"^##\s+Winning prompt framing\b", "the tasks these prompt shadow experiments sampled"),
    ("workflow.correction-mining", r"^##\s+(?:Known paths|File locations|Project map|Corrections|Gotchas)\b", "not the first place the agent looked"),
    ("workflow.repeated-commands", r"^##\s+Common commands\b", "wrap them in a script"),
    ("context.compaction-hot-sessions", r"^##\s+Context discipline\b", "letting context grow until it auto-compacts"),
    ("context.low-health", r"^##\s+(Keep the session|Session) heal", "Avoid switching permission modes mid-session"),
    ("context.repo-map-context-waste", r"^##\s+Stable reference files\b", "Reference these stable files instead of re-reading them"),
    ("context.over-window", r"^##\s+Context discipline\b", "working context well under the model"),
    ("context.repeated-compactions", r"^##\s+Session resets\b", "split the remaining work into a new session"),
    ("context.cross-session-reread", r"^##\s+Distilled reference notes\b", "Distill these docs once here instead of re-reading them cold"),
    ("context.compaction-large-tool-outputs", r"^##\s+Tool output discipline\b", "prefer Grep/Glob over unfiltered"),
    ("context.low-cache-hit", r"^##\s+(Keep the )?prompt cache\b", "stable context prefix, so avoid churning"),
    ("context.reclaim-potential", r"^##\s+Context reclaim discipline\b", "Cache or reference these large tool outputs and pasted blocks"),
    ("cost.model-eval-routing-gap", r"^##\s+Scoped model routing\b", "scoped model-routing decision adopted from eval evidence"),
    ("cost.expensive-sessions", r"^##\s+Session scope\b", "start a fresh session when the task changes"),
    ("cost.output-verbosity", r"^##\s+Output brevity\b", "keep assistant output terse"),
    ("cost.cache-1h-waste", r"^##\s+Cach(e|ing)\b", "default 5-minute prompt cache for routine work"),
    ("cost.web-search-spend", r"^##\s+Web-search discipline\b", "Prefer web_fetch for stable URLs"),
    ("cost.edit-format-churn", r"^##\s+Formatting discipline\b", "do not reformat code you are not otherwise changing"),
)


def flattened(files: DataFrame) -> DataFrame:
    """key, value of settings files (a column `value` with each file's whole JSON): scalars, permission rules, hooks' matchers and commands. A file that isn't JSON gives nothing."""
    s = files.select(F.from_json("value", SETTINGS).alias("s")).select("s.*")
    pair = lambda key, value: F.struct(F.lit(key).alias("key"), value.cast("string").alias("value"))
    scalars = [F.array(pair(k, F.col(k))) for k in ("cleanupPeriodDays", "model", "autoCompactEnabled")]
    listed = lambda key: F.transform(F.col(key), lambda rule: pair(key, rule))
    rules = [listed(f"permissions.{k}") for k in ("allow", "ask", "deny")]
    named = lambda event, part, value: F.struct(F.concat(F.lit("hooks."), event, F.lit(f".{part}")).alias("key"), value.alias("value"))

    def hooks(e):
        commands = F.flatten(F.transform(e["value"], lambda h: F.transform(F.coalesce(h["hooks"], F.array()), lambda c: named(e["key"], "command", c["command"]))))
        return F.concat(F.transform(e["value"], lambda h: named(e["key"], "matcher", h["matcher"])), commands)

    hooked = F.flatten(F.transform(F.map_entries("hooks"), hooks))
    none = F.array().cast("array<struct<key: string, value: string>>")
    return s.select(F.explode(F.concat(*[F.coalesce(a, none) for a in (*scalars, *rules, hooked)])).alias("p")).select("p.*").filter("value IS NOT NULL AND value <> ''")


def read(spark: SparkSession, settings: list[str], instructions: list[str] = ()) -> DataFrame:
    """key, value of settings files and instruction files by their paths (folders and globs too); an instruction file is one row of its text."""
    whole = lambda paths: spark.read.option("recursiveFileLookup", "true").text(list(paths), wholetext=True)
    empty = spark.createDataFrame([], "key string, value string")
    found = flattened(whole(settings)) if settings else empty
    return found.unionByName(whole(instructions).select(F.lit(INSTRUCTIONS).alias("key"), "value")) if instructions else found


def answered(live_config: DataFrame) -> DataFrame:
    """id of the rules that the settings in force (key, value) already answer."""
    spark = live_config.sparkSession
    by_setting = spark.createDataFrame(list(SETTING_ANSWERS), "id string, key string, pattern string")
    set_ = live_config.join(F.broadcast(by_setting), "key").filter(F.expr("value RLIKE pattern")).select("id")  # a dozen rows
    texts = live_config.filter(F.col("key") == INSTRUCTIONS).select(F.lower("value").alias("text"), F.filter(F.split("value", "\r?\n"), lambda x: x.rlike(r"^#{1,6}\s+")).alias("heads"))
    marks = spark.createDataFrame([(i, f"(?i){h}", p.lower()) for i, h, p in MARKERS], "id string, heading string, phrase string")
    hits = texts.crossJoin(F.broadcast(marks)).select("id", F.expr("exists(heads, x -> x RLIKE heading)").alias("headed"), F.contains("text", F.col("phrase")).alias("said"))  # a row a file and mark
    taken = hits.groupBy("id").agg(F.bool_or("headed").alias("headed"), F.bool_or("said").alias("said")).filter("headed AND said").select("id")
    return set_.unionByName(taken).distinct()
