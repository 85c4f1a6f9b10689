"""Scalar functions as column expressions: text, paths, versions, dates, numbers, shell commands."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def _c(x: str | Column) -> Column:
    return F.col(x) if isinstance(x, str) else x


# -- text and paths ---------------------------------------------------------------------------


def summarize(text: str | Column, limit: int = 160) -> Column:
    """One line of at most limit characters, with an ellipsis where it is cut."""
    line = F.trim(F.regexp_replace(_c(text), r"\s+", " "))
    return F.when(F.length(line) > limit, F.concat(F.rtrim(F.substring(line, 1, limit - 1)), F.lit("…"))).otherwise(line)


def truncate_middle(text: str | Column, limit: int) -> Column:
    """The start and the end of a long text around an ellipsis."""
    t, head = _c(text), limit // 2
    tail = limit - 1 - head
    return F.when(F.length(t) > limit, F.concat(F.substring(t, 1, head), F.lit("…"), F.right(t, F.lit(tail)))).otherwise(t)


def basename(path: str | Column) -> Column:
    return F.regexp_extract(_c(path), r"([^/\\]*)[/\\]*$", 1)


def dirname(path: str | Column) -> Column:
    return F.regexp_extract(_c(path), r"^(.*?)[/\\]+[^/\\]*[/\\]*$", 1)


def stem(path: str | Column) -> Column:
    """The base name without its last extension; a leading dot is no extension."""
    return F.regexp_replace(basename(path), r"(?<=.)\.[^.]*$", "")


def project_key(path: str | Column) -> Column:
    """One identity for the spellings of a project's path: slashes, case of drives, trailing slashes."""
    p = F.regexp_replace(F.replace(_c(path), F.lit("\\"), F.lit("/")), "/+$", "")
    return F.when(p.rlike("^[A-Za-z]:"), F.concat(F.lower(F.substring(p, 1, 1)), F.regexp_extract(p, "^.(.*)$", 1))).otherwise(p)


def slug(path: str | Column) -> Column:
    """A project path as a folder name."""
    return F.regexp_replace(_c(path), "[^A-Za-z0-9]", "-")


def tokens_of(text: str | Column, chars: float = 4.0) -> Column:
    """An estimate of tokens from characters."""
    return F.ceil(F.length(_c(text)) / chars).cast("bigint")


def json_length(value: str | Column) -> Column:
    return F.length(F.to_json(_c(value)))


# -- versions, dates, numbers -----------------------------------------------------------------


def version_key(version: str | Column) -> Column:
    """An array of numbers that orders dotted versions; pre-release tags don't count."""
    parts = F.split(F.regexp_extract(_c(version), r"^v?([0-9]+(?:\.[0-9]+)*)", 1), r"\.")
    return F.transform(F.filter(parts, lambda p: p != ""), lambda p: p.cast("bigint"))


def day_key(ts: str | Column, zone: str = "UTC") -> Column:
    return F.to_date(F.from_utc_timestamp(_c(ts), zone))


def week_start(day: str | Column) -> Column:
    """The Monday of a day's week."""
    return F.date_trunc("week", _c(day)).cast("date")


def strict_instant(text: str | Column) -> Column:
    """A timestamp only where text is a full RFC 3339 instant of a day that exists."""
    t = _c(text)
    good = t.rlike(r"^\d{4}-(0[1-9]|1[0-2])-(0[1-9]|[12]\d|3[01])T([01]\d|2[0-3]):[0-5]\d:[0-5]\d(\.\d+)?(Z|[+-]([01]\d|2[0-3]):[0-5]\d)$")
    return F.when(good, F.try_to_timestamp(t))


def half_up(x: str | Column) -> Column:
    """Rounding to whole numbers with halves toward plus infinity."""
    return F.floor(_c(x) + 0.5)


def clamp(x: str | Column, low: float, high: float) -> Column:
    return F.least(F.greatest(_c(x), F.lit(low)), F.lit(high))


def smoothed(successes: str | Column, trials: str | Column, alpha: float = 1.0) -> Column:
    """A rate with Laplace smoothing."""
    return (_c(successes) + alpha) / (_c(trials) + 2 * alpha)


# -- documents, branches, scores --------------------------------------------------------------


def frontmatter(text: str | Column) -> Column:
    """The key: value lines between the leading dashes of a document as a map, empty where there are none."""
    block = F.regexp_extract(_c(text), r"(?s)^---\r?\n(.*?)\r?\n---(?:\r?\n|$)", 1)
    pairs = F.filter(F.split(block, r"\r?\n"), lambda x: x.rlike(r"^[\w-]+\s*:"))
    entry = lambda x: F.struct(F.trim(F.substring_index(x, ":", 1)).alias("k"), F.trim(F.regexp_extract(x, r"^[^:]*:\s*(.*)$", 1)).alias("v"))
    return F.map_from_entries(F.transform(pairs, entry))


def headings(text: str | Column) -> Column:
    """The texts of a document's headings in order, fenced code left out."""
    body = F.regexp_replace(_c(text), r"(?s)(?:^|\n)(```|~~~).*?\n\1", "\n")
    return F.regexp_extract_all(body, F.lit(r"(?m)^#{1,6}[ \t]+(.+?)[ \t]*#*[ \t]*$"), F.lit(1))


def doc_slug(path: str | Column) -> Column:
    """A document's path without its suffix."""
    return F.regexp_replace(_c(path), r"\.md$", "")


def doc_category(path: str | Column) -> Column:
    """A document's category by its folder: root, or the first folder below docs, or the first folder."""
    p = _c(path)
    return F.when(~F.contains(p, F.lit("/")), "root").when(p.rlike("^docs/[^/]+/"), F.regexp_extract(p, "^docs/([^/]+)/", 1)).otherwise(F.regexp_extract(p, "^([^/]+)/", 1))


def issue_of_branch(branch: str | Column) -> Column:
    """The issue number that a feature or fix branch is named by, else null."""
    return F.nullif(F.regexp_extract(_c(branch), r"^(?:feature|fix)/(\d+)-", 1), F.lit("")).try_cast("bigint")


def delivery(state: str | Column, merged_at: str | Column, reverted: str | Column) -> Column:
    """The outcome of a change request: reverted, merged, closed or open."""
    return F.when(F.coalesce(_c(reverted), F.lit(False)), "reverted").when(_c(merged_at).isNotNull(), "merged").when(F.lower(_c(state)) == "closed", "closed").otherwise("open")


def opener_length(text: str | Column) -> Column:
    """Whether an opening is short (below 60 characters), medium (below 200) or long."""
    n = F.length(F.trim(_c(text)))
    return F.when(n < 60, "short").when(n < 200, "medium").otherwise("long")


def weighted_score(correct: str | Column, process: str | Column, cost: str | Column, style: str | Column, vetoes: str | Column) -> Column:
    """Fixed weights 50, 25, 15 and 10 percent; any veto makes it 0."""
    return F.when(_c(vetoes) > 0, F.lit(0.0)).otherwise(0.50 * _c(correct) + 0.25 * _c(process) + 0.15 * _c(cost) + 0.10 * _c(style))


def regime(version: str | Column, bounds: list[tuple[str, str]]) -> Column:
    """The regime in force for a version: the last (first version, name) that is not above it; `indeterminate` before the first or without a version."""
    out, key = F.lit("indeterminate"), version_key(version)
    for first, name in sorted(bounds, key=lambda b: [int(x) for x in b[0].split(".")]):
        out = F.when((F.size(key) > 0) & (key >= F.array(*[F.lit(int(x)).cast("bigint") for x in first.split(".")])), name).otherwise(out)
    return out


#: Words that tell a task's class, tried in this order; authoring is also the default.
TASK_CLASSES = (
    ("authoring", r"\b(?:implement|build|add|fix|refactor|write|create|code|coder|develop)\b"),
    ("review", r"\b(?:review|audit|critique|approve|reviewer)\b"),
    ("mechanical", r"\b(?:classify|pick|label|status|replay|triage|sort|tag)\b"),
)


def task_class(opener: str | Column) -> Column:
    """authoring, review or mechanical, by an opening's words; code work wins, and so it does where nothing is said."""
    o, out = F.lower(F.coalesce(_c(opener), F.lit(""))), F.lit("authoring")
    for name, pattern in reversed(TASK_CLASSES):
        out = F.when(o.rlike(pattern), name).otherwise(out)
    return out


def permission_rule(rule: str | Column) -> Column:
    """tool, spec and whether the spec is a prefix, of a rule such as Bash(git push:*); a bare tool has no spec."""
    r = F.trim(_c(rule))
    spec = F.nullif(F.regexp_extract(r, r"^[\w-]+\((.*)\)$", 1), F.lit(""))
    return F.struct(F.regexp_extract(r, r"^([\w-]+)", 1).alias("tool"), F.regexp_replace(spec, r":\*$", "").alias("spec"), F.coalesce(spec.rlike(r":\*$"), F.lit(False)).alias("prefix"))


def relative_path(path: str | Column) -> Column:
    """A relative path without repeated separators and `.` parts; null where it is absolute or empty."""
    p = _c(path)
    parts = F.filter(F.split(p, "/"), lambda x: (x != "") & (x != "."))
    return F.when(~F.startswith(p, F.lit("/")) & (F.size(parts) > 0), F.array_join(parts, "/"))


def short_id(session: str | Column, n: int = 8) -> Column:
    """The beginning of a session's id."""
    return F.left(_c(session), F.lit(n))


def percent_of(part: str | Column, whole: str | Column) -> Column:
    """A share in whole percent, halves up; 0 of nothing is 0."""
    return F.when(_c(whole) > 0, F.floor(100.0 * _c(part) / _c(whole) + 0.5)).otherwise(F.lit(0)).cast("int")


def topics(text: str | Column, least: int = 4) -> Column:
    """The distinct words of a text that can name a topic: letters and digits, at least so long, in order of appearance."""
    return F.array_distinct(F.filter(F.split(F.lower(F.coalesce(_c(text), F.lit(""))), "[^a-z0-9]+"), lambda w: F.length(w) >= least))


#: What a turn's language says, by kind.
LANGUAGE = {
    "refusal": r"\bi (?:can't|cannot|can not|won't|am unable to|'m unable to)\b",
    "hedge": r"\b(?:might|maybe|perhaps|possibly|i think|it seems|should work|probably)\b",
    "wait": r"\b(?:wait(?:ing)?|let me know when|once (?:it|that|this) (?:is|finishes|completes)|hold on)\b",
    "claim": r"\b(?:all tests pass|done|completed?|fixed|successfully|works now)\b",
    "interrupt": r"^\[request interrupted by user",
}


def language_flags(text: str | Column) -> list[Column]:
    """A boolean column for each kind of LANGUAGE."""
    t = F.lower(F.coalesce(_c(text), F.lit("")))
    return [t.rlike(p).alias(kind) for kind, p in LANGUAGE.items()]


# -- shell commands ---------------------------------------------------------------------------

#: Classes of commands, tried in this order.
COMMAND_CLASSES = (
    ("search", r"^(?:grep|rg|ag|find|fd)$"),
    ("read", r"^(?:cat|head|tail|less|sed|awk)$"),
    ("navigate", r"^(?:cd|ls|pwd|tree)$"),
    ("git", r"^(?:git|gh)$"),
    ("test", r"^(?:pytest|jest|vitest|tox|ctest)$"),
    ("build", r"^(?:make|cmake|cargo|go|tsc|gradle|mvn)$"),
    ("package", r"^(?:npm|pnpm|yarn|pip|uv|brew|apt)$"),
    ("run", r"^(?:python3?|node|bash|sh|deno|ruby)$"),
)


def unquoted(command: str | Column) -> Column:
    """A command with the contents of its quotes and here-documents blanked, so that operators in them don't count."""
    c = F.regexp_replace(_c(command), r"(?s)<<-?\s*['\"]?(\w+)['\"]?[^\n]*\n.*?\n\1\s*(?=\n|$)", "<<$1")
    return F.regexp_replace(c, r"'[^']*'|\"(?:[^\"\\]|\\.)*\"", "''")


def segments(command: str | Column) -> Column:
    """The simple commands of a line, cut at `;`, `&&`, `||`, `|` and line ends outside quotes."""
    parts = F.split(unquoted(command), r"&&|\|\||[;|\n&]")
    return F.filter(F.transform(parts, lambda p: F.trim(p)), lambda p: p != "")


def program(segment: str | Column) -> Column:
    """The program of a simple command, without assignments, sudo and its folder."""
    return F.regexp_extract(_c(segment), r"^(?:(?:\w+=\S*|sudo|time|env)\s+)*(?:\S*/)?([\w.+-]+)", 1)


def command_class(segment: str | Column) -> Column:
    p = program(segment)
    out = F.lit("other")
    for name, pattern in reversed(COMMAND_CLASSES):
        out = F.when(p.rlike(pattern), name).otherwise(out)
    return out


def git_steps(df: DataFrame, command: str) -> DataFrame:
    """A row a git call in a command line: its place (step), subcommand (sub) and first argument (arg, empty where there is none)."""
    parts = df.select("*", F.posexplode(segments(command)).alias("step", "_seg")).filter(program("_seg") == "git")
    rest = F.regexp_extract("_seg", r"\bgit\s+(?:(?:-C|-c)\s+\S+\s+|--?[\w-]+(?:=\S+)?\s+)*(.*)$", 1)
    words = F.split(F.trim(rest), r"\s+")
    return parts.withColumn("sub", F.get(words, F.lit(0))).withColumn("arg", F.coalesce(F.get(words, F.lit(1)), F.lit(""))).drop("_seg")


def rule_matches(rule: str | Column, call: str | Column) -> Column:
    """Whether a permission rule covers a call: exactly, or by prefix with `:*`; null where the rule has no meaning."""
    r, c = _c(rule), _c(call)
    prefix = F.regexp_replace(r, r":\*\)?$", "")
    return F.when(r.isNull() | (F.trim(r) == ""), F.lit(None).cast("boolean")).when(r.rlike(r":\*\)?$"), c.startswith(prefix)).otherwise(c == r)
