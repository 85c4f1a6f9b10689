"""Side artifacts: one reader a kind, each a glob of JSON, JSON lines or text below a folder.

Every reader takes a path that Spark can open. Broken files or lines give no rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

SCHEMAS = {
    "tasks": "id string, subject string, status string, owner string, blockedBy array<string>, updatedAt string",
    "telemetry": "event_name string, client_timestamp string, session_id string, model string, betas string, attempt int, elapsed_ms double, status int, output_tokens bigint, api_duration_ms double",
    "registry": "sessionId string, pid int, cwd string, startedAt string, endedAt string, status string",
    "updates": "version string, status string, code int, at string",
    "backups": "at string, key string, value string",
    "workflows": "id string, status string, startedAt string, tokens bigint, agents array<struct<name:string,state:string,error:string>>",
    "receipts": "id string, at string, kind string",
    "shadow": "axis string, variation string, at string, winner string",
    "daily": "date string, messageCount bigint, sessionCount bigint, toolCallCount bigint",
    "reviews": "id string, reviewer string, requestedAt string, closedAt string",
}


def read(spark: SparkSession, kind: str, path: str, lines: bool = True) -> DataFrame:
    """The rows of one kind, with the file that they came from; lines is False where a file is one JSON value."""
    raw = spark.read.text(path, wholetext=not lines).select(F.col("_metadata.file_path").alias("file"), "value")
    rows = raw.select("file", F.from_json("value", SCHEMAS[kind]).alias("r"))
    first = SCHEMAS[kind].split()[0]
    return rows.filter(F.col(f"r.{first}").isNotNull()).select("file", "r.*")


def plans(spark: SparkSession, path: str) -> DataFrame:
    """Markdown plans: name, sections, file_refs, words, has_verification."""
    raw = spark.read.text(path, wholetext=True).select(F.regexp_extract("_metadata.file_path", r"([^/]+)\.md$", 1).alias("name"), F.col("value").alias("t"))
    heads = F.regexp_extract_all("t", F.lit(r"(?m)^#{1,6}\s+(.+?)\s*$"), F.lit(1))
    return raw.select(
        "name", heads.alias("sections"), F.size(F.array_distinct(F.regexp_extract_all("t", F.lit(r"\b[\w./-]+\.(?:py|ts|js|go|rs|java|md|json)\b"), F.lit(0)))).alias("file_refs"),
        F.regexp_count("t", F.lit(r"\S+")).alias("words"), F.exists(heads, lambda h: F.lower(h).rlike("verif|test|validat")).alias("has_verification"),
    )


def documents(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """The graph of Markdown files: nodes (node, words) and edges (src, dst, kind) by relative link or issue number."""
    root = path.rstrip("/")
    raw = spark.read.option("recursiveFileLookup", "true").option("pathGlobFilter", "*.md").text(root, wholetext=True)
    node = F.regexp_replace(F.col("_metadata.file_path"), F.lit(r"^.*?" + root.split("/")[-1] + "/"), F.lit(""))
    rows = raw.select(node.alias("node"), F.col("value").alias("t"))
    links = rows.select(F.col("node").alias("src"), F.explode(F.regexp_extract_all("t", F.lit(r"\]\(([^)#\s:]+\.md)(?:#[^)]*)?\)"), F.lit(1))).alias("to"))
    folder = F.regexp_extract("src", r"^(.*/)?[^/]*$", 1)
    joined = F.regexp_replace(F.concat(folder, "to"), r"(^|/)\./", "$1")
    up = joined
    for _ in range(4):  # folders that links climb
        up = F.regexp_replace(up, r"(^|/)(?!\.\.)[^/]+/\.\./", "$1")
    issues = rows.select(F.col("node").alias("src"), F.explode(F.regexp_extract_all("t", F.lit(r"(?<![\w&])#(\d{1,6})\b"), F.lit(1))).alias("n"))
    edges = links.select("src", up.alias("dst"), F.lit("md-link").alias("kind")).unionByName(issues.select("src", F.concat(F.lit("#"), "n").alias("dst"), F.lit("issue-ref").alias("kind")))
    return rows.select("node", F.regexp_count("t", F.lit(r"\S+")).alias("words")), edges.distinct()


def imports(files: DataFrame) -> DataFrame:
    """src, module of Python imports in a table of path and text: the edges of a repository map."""
    found = F.regexp_extract_all("text", F.lit(r"(?m)^\s*(?:from\s+([\w.]+)\s+import|import\s+([\w.]+))"), F.lit(0))
    rows = files.select(F.col("path").alias("src"), F.explode(found).alias("line"))
    return rows.select("src", F.regexp_extract("line", r"(?:from|import)\s+([\w.]+)", 1).alias("module")).distinct()


def changes(backups: DataFrame) -> DataFrame:
    """Transitions of configuration values, key by key, from snapshot to snapshot."""
    was = F.lag("value").over(Window.partitionBy("key").orderBy("at"))
    return backups.withColumn("was", was).filter(F.col("was").isNotNull() & ~F.col("was").eqNullSafe(F.col("value"))).select("key", "at", "was", "value")


def lifecycle(receipts: DataFrame) -> DataFrame:
    """The state that a recommendation's receipts lead to, in order: shown, applied, verified, reverted, rejected."""
    step = F.when(F.col("kind") == "reverted", "reverted").when(F.col("kind") == "rejected", "rejected").otherwise(F.col("kind"))
    last = F.max_by(step, F.struct("at", "kind"))
    return receipts.groupBy("id").agg(last.alias("state"), F.count(F.lit(1)).alias("receipts"), F.min("at").alias("first_at"), F.max("at").alias("last_at"))


def shadow_wins(calls: DataFrame, min_samples: int = 5, min_decided: int = 3, min_rate: float = 0.6) -> DataFrame:
    """Axes on which the shadow variation wins often enough."""
    g = calls.groupBy("axis", "variation").agg(
        F.count(F.lit(1)).alias("samples"), F.count_if(F.col("winner").isin("shadow", "live")).alias("decided"), F.count_if(F.col("winner") == "shadow").alias("wins")
    )
    return g.filter((F.col("samples") >= min_samples) & (F.col("decided") >= min_decided)).withColumn("rate", F.col("wins") / F.col("decided")).filter(F.col("rate") >= min_rate)


def review_bottlenecks(reviews: DataFrame, now, stale_hours: float = 48) -> DataFrame:
    """Reviewers with requests that stay open too long, and the oldest's age."""
    age = (F.unix_seconds(F.lit(now)) - F.unix_seconds(F.try_to_timestamp("requestedAt"))) / 3600
    rows = reviews.filter("closedAt IS NULL").withColumn("age", age).filter(F.col("age") >= stale_hours)
    return rows.groupBy("reviewer").agg(F.count(F.lit(1)).alias("stale"), F.max("age").alias("oldest_hours"))


def telemetry_reliability(events: DataFrame) -> DataFrame:
    """Retry attempts overall, by model, by session and by both."""
    return events.groupingSets([[], ["model"], ["session_id"], ["model", "session_id"]], "model", "session_id").agg(
        F.count(F.lit(1)).alias("events"), F.count_if(F.col("attempt") > 1).alias("retries"), F.max("attempt").alias("worst"), F.avg("elapsed_ms").alias("mean_ms")
    )
