"""Do sessions follow the sections of their instruction files? Sections met by behaviour signatures, and what the calls show.

A section belongs to the first signature that fits its scope, heading or references; without one nothing that
is recorded can tell. All signatures are evaluated in one pass over the calls (a few sums a session each), so
the calls are read once however many signatures or sections there are, and sections only meet their totals.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Shell programs that a built-in tool replaces, as the first word of a simple command.
_HEAD = r"(?:^|[;&|]\s*)"
SHELL_SEARCH, SHELL_FIND, SHELL_READ = (rf"{_HEAD}(?:{p})\b" for p in ("grep|egrep|fgrep|rg", "find|fd", "cat|head|tail"))


@dataclass(frozen=True)
class Signature:
    """What a section has to look like (patterns, null: anything), and the behaviour that shows whether it is kept.

    kind command: shell commands that match `good` or `bad`. kind native: built-in searches against shell ones.
    kind pin: sessions that read a `bad` file, good where a `good` file was read before the first of them.
    """

    id: str
    kind: str
    scope: str | None = None
    heading: str | None = None
    reference: str | None = None
    good: str = ""
    bad: str = ""


#: The signatures there are.
SIGNATURES = (
    Signature("build-command/vite-not-tsc", "command", scope=r"(?i)AGENTS\.md|CLAUDE\.md", heading="(?i)build|deploy", good=r"\b(?:npx\s+)?vite\s+build\b", bad=r"\bnpm\s+run\s+build\b|\btsc\s+-b\b"),
    Signature("native-tool/prefer-native", "native", heading=r"(?i)native tool|prefer.*(read|grep|glob)|bash command|dedicated tool"),
    Signature("key-file-pin/references-before-parsers", "pin", reference=r"(?i)REFERENCES\.md", good=r"(?i)REFERENCES\.md", bad=r"(?:^|/)(?:src/lib/)?parse-[\w-]+\.ts$"),
)


def _measures(s: Signature) -> tuple[Column, Column]:
    """A session's good and bad events by its calls."""
    tool, command, file = F.col("tool_name"), F.when(F.col("tool_name") == "Bash", F.col("command")), F.col("file")
    n = lambda when: F.count_if(F.coalesce(when, F.lit(False)))
    if s.kind == "command":
        return n(command.rlike(s.good)), n(command.rlike(s.bad))
    if s.kind == "native":
        shell = [n(command.rlike(p)) for p in (SHELL_SEARCH, SHELL_FIND, SHELL_READ)]
        return n(tool.isin("Grep", "Glob")), shell[0] + shell[1] + shell[2]
    read = (tool == "Read") & (F.coalesce(file, F.lit("")) != "") & F.col("ts").isNotNull()
    pinned = F.min(F.when(read & file.rlike(s.good), F.col("ts")))
    governed = F.min(F.when(read & ~file.rlike(s.good) & file.rlike(s.bad), F.col("ts")))
    kept = F.coalesce(pinned < governed, F.lit(False))
    return F.when(governed.isNotNull() & kept, 1).otherwise(0), F.when(governed.isNotNull() & ~kept, 1).otherwise(0)


def observations(calls: DataFrame, signatures: tuple[Signature, ...] = SIGNATURES) -> DataFrame:
    """signature_id: good and bad events and the sessions with any. calls: session_id, ts, tool_name, command, file."""
    columns = []
    for k, s in enumerate(signatures):
        good, bad = _measures(s)
        columns += [good.alias(f"g{k}"), bad.alias(f"b{k}")]
    each = calls.groupBy("session_id").agg(*columns)
    rows = F.array(*[F.struct(F.lit(s.id).alias("signature_id"), F.col(f"g{k}").cast("bigint").alias("good"), F.col(f"b{k}").cast("bigint").alias("bad")) for k, s in enumerate(signatures)])
    long = each.select(F.explode(rows).alias("r")).select("r.*")
    return long.groupBy("signature_id").agg(F.sum("good").alias("good"), F.sum("bad").alias("bad"), F.count_if(F.col("good") + F.col("bad") > 0).alias("sessions"))


def attribute_sections(sections: DataFrame, calls: DataFrame, signatures: tuple[Signature, ...] = SIGNATURES) -> DataFrame:
    """section_id: its signature, attributability, good and bad events, the share kept, and sessions.

    sections: section_id, scope, heading, references (file targets). attributable where events were seen,
    unattributable where none were, unfalsifiable where no signature fits (its other columns are null).
    """
    chosen = F.lit(None).cast("string")
    for s in reversed(signatures):
        fits = F.lit(True)
        if s.scope:
            fits = fits & F.coalesce(F.col("scope").rlike(s.scope), F.lit(False))
        if s.heading:
            fits = fits & F.coalesce(F.col("heading").rlike(s.heading), F.lit(False))
        if s.reference:
            fits = fits & F.coalesce(F.exists("references", _matches(s.reference)), F.lit(False))
        chosen = F.when(fits, s.id).otherwise(chosen)
    seen = F.broadcast(observations(calls, signatures))  # a row a signature
    rows = sections.select("section_id", chosen.alias("signature_id")).join(seen, "signature_id", "left")
    any_ = F.coalesce(F.col("good") + F.col("bad"), F.lit(0)) > 0
    status = F.when(F.col("signature_id").isNull(), "unfalsifiable").when(any_, "attributable").otherwise("unattributable")
    shown = lambda c: F.when(any_, F.col(c)).alias(c)
    return rows.select("section_id", "signature_id", status.alias("attributability"), shown("good"), shown("bad"), F.when(any_, F.col("good") / (F.col("good") + F.col("bad"))).alias("kept"), shown("sessions"))


def _matches(pattern: str):
    return lambda target: target.rlike(pattern)
