"""Session transcripts: line-delimited JSON to typed tables.

A file is a session (its name without `.jsonl`), or a part of one below a folder of that name.
Lines that aren't JSON are dropped. `message` may be an object or a string that holds one. Every
table is a DataFrame over the same parsed lines, with only the fields it needs.
"""

from __future__ import annotations

from functools import cached_property

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

LINE = (
    "type string, subtype string, timestamp string, sessionId string, version string, gitBranch string, entrypoint string, permissionMode string, message string, "
    "attributionAgent string, attributionSkill string, attributionMcpServer string, attributionMcpTool string, toolUseResult string, level string, error string, "
    "retryInMs double, retryAttempt int, maxRetries int, durationMs double, messageCount int, hookCount int, hookInfos array<struct<command:string,durationMs:double>>, "
    "hookErrors array<string>, preventedContinuation boolean, content string, name string, value string, aiTitle string, customTitle string, "
    "attachment struct<type:string,addedNames:array<string>,removedNames:array<string>,readdedNames:array<string>,names:array<string>>"
)
MESSAGE = (
    "id string, model string, role string, content string, usage struct<service_tier:string,input_tokens:bigint,output_tokens:bigint,cache_creation_input_tokens:bigint,"
    "cache_read_input_tokens:bigint,cache_creation:struct<ephemeral_5m_input_tokens:bigint,ephemeral_1h_input_tokens:bigint>,"
    "server_tool_use:struct<web_search_requests:bigint,web_fetch_requests:bigint>>"
)
BLOCKS = "array<struct<type:string,text:string,thinking:string,id:string,name:string,input:string,tool_use_id:string,is_error:boolean,content:string>>"
INPUT = "command string, file_path string, subagent_type string, skill string, pattern string, description string"

#: Characters a token by kind of text.
TEXT_CHARS, TOOL_CHARS, RESULT_CHARS = 2.6, 1.7, 3.5


def read_lines(spark: SparkSession, path: str) -> DataFrame:
    """session_id, project, file, part, seq and the line's text of every transcript below path.

    seq orders a session's lines as text: the top file before its sub-agents' by name, then the place
    in the file (block, then row), however Spark deals the files' blocks to its tasks.
    """
    raw = spark.read.option("recursiveFileLookup", "true").option("pathGlobFilter", "*.jsonl").text(path)
    file = F.col("_metadata.file_path")
    session = F.coalesce(F.nullif(F.regexp_extract(file, r"/([^/]+)/subagents/[^/]+\.jsonl$", 1), F.lit("")), F.regexp_extract(file, r"([^/]+)\.jsonl$", 1))
    project = F.regexp_extract(file, r"/projects/([^/]+)/", 1)
    part = F.when(F.contains(file, F.lit("/subagents/")), F.concat(F.lit("1"), F.regexp_extract(file, r"([^/]+)\.jsonl$", 1))).otherwise(F.lit("0"))
    block = F.lpad(F.col("_metadata.file_block_start").cast("string"), 15, "0")
    row = F.lpad(F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1)).cast("string"), 10, "0")
    return raw.select(session.alias("session_id"), project.alias("project"), file.alias("file"), part.alias("part"), F.concat_ws("|", part, block, row).alias("seq"), F.col("value").alias("line"))


def count(c: str | Column) -> Column:
    """A counter: never negative, 0 where absent."""
    return F.greatest(F.coalesce(F.col(c) if isinstance(c, str) else c, F.lit(0)), F.lit(0)).cast("bigint")


class Transcripts:
    """The tables of a set of transcripts; `lines` as from `read_lines`, or any DataFrame with session_id, seq and line."""

    def __init__(self, lines: DataFrame):
        parsed = lines.withColumn("e", F.from_json("line", LINE)).filter("e.type IS NOT NULL")
        keep = [c for c in lines.columns if c != "line"]
        parsed = parsed.select(*keep, "e.*").withColumn("ts", F.try_to_timestamp("timestamp"))
        m = parsed.withColumn("m", F.from_json("message", MESSAGE))
        blocks = F.when(F.col("m.content").startswith("["), F.from_json("m.content", BLOCKS))
        self.lines = m.withColumn("blocks", blocks).withColumn("text", F.when(F.col("blocks").isNull(), F.col("m.content")))

    @cached_property
    def blocks(self) -> DataFrame:
        """A row a content block, with its place."""
        return self.lines.select("session_id", "seq", "ts", F.col("type").alias("line_type"), F.col("m.id").alias("message_id"), F.posexplode("blocks").alias("pos", "b")).select("*", "b.*")

    @cached_property
    def token_entries(self) -> DataFrame:
        """A row a billed message: counters of repeated lines by maximum, visible tokens by sum, tool ids as a set, the rest from the first line."""
        rows = self.lines.filter("type = 'assistant' AND m.usage IS NOT NULL")
        chars = F.aggregate(F.coalesce("blocks", F.array()), F.lit(0.0), lambda a, b: a + F.coalesce(F.length(b["text"]) / TEXT_CHARS, F.lit(0.0)) + F.coalesce(F.length(b["input"]) / TOOL_CHARS, F.lit(0.0)))
        ids = F.transform(F.filter(F.coalesce("blocks", F.array()), lambda b: b["type"] == "tool_use"), lambda b: b["id"])
        think = F.exists(F.coalesce("blocks", F.array()), lambda b: b["type"] == "thinking")
        key = F.coalesce(F.col("m.id"), F.concat(F.lit("line-"), "seq"))
        u = "m.usage."
        first = lambda c: F.min_by(c, "seq")
        out = rows.withColumn("visible", F.ceil(chars)).withColumn("ids", ids).withColumn("thinks", think).groupBy("session_id", key.alias("message_id")).agg(
            F.min("seq").alias("seq"), first("ts").alias("ts"), first("m.model").alias("model"), first("entrypoint").alias("entrypoint"), first(u + "service_tier").alias("service_tier"),
            F.max(count(u + "input_tokens")).alias("input"), F.max(count(u + "output_tokens")).alias("output"),
            F.max(count(u + "cache_creation_input_tokens")).alias("cache_creation"), F.max(count(u + "cache_creation.ephemeral_1h_input_tokens")).alias("cache_creation_1h"),
            F.max(count(u + "cache_read_input_tokens")).alias("cache_read"), F.max(count(u + "server_tool_use.web_search_requests")).alias("web_search"),
            F.max(count(u + "server_tool_use.web_fetch_requests")).alias("web_fetch"), F.sum("visible").alias("visible"), F.bool_or("thinks").alias("thinks"),
            F.array_sort(F.array_distinct(F.flatten(F.collect_list("ids")))).alias("tool_use_ids"),
        )
        return out.withColumn("thinking", F.when(F.col("thinks"), F.greatest(F.lit(0), F.col("output") - F.col("visible"))).otherwise(F.lit(0)))

    @cached_property
    def tool_calls(self) -> DataFrame:
        """A row a tool use; of repeated ids the last counts. is_error is null while no result came, which may also come first."""
        use = self.blocks.filter("b.type = 'tool_use' AND b.id IS NOT NULL").groupBy("session_id", F.col("id").alias("tool_use_id")).agg(
            F.max_by(F.struct("seq", "pos", "ts", "name", "input"), F.struct("seq", "pos")).alias("u")
        )
        result = self.blocks.filter("b.type = 'tool_result' AND tool_use_id IS NOT NULL").groupBy("session_id", "tool_use_id").agg(
            F.max_by(F.struct(F.coalesce("is_error", F.lit(False)).alias("is_error"), F.octet_length("content").alias("result_bytes"), F.col("ts").alias("result_ts")), F.struct("seq", "pos")).alias("r")
        )
        calls = use.join(result, ["session_id", "tool_use_id"], "left").select(
            "session_id", "tool_use_id", "u.seq", "u.pos", "u.ts", F.col("u.name").alias("tool_name"), F.col("u.input").alias("input_json"), F.from_json("u.input", INPUT).alias("input"),
            "r.is_error", "r.result_bytes", "r.result_ts",
        )
        return calls.withColumn("ord", F.row_number().over(Window.partitionBy("session_id").orderBy("seq", "pos")))

    @cached_property
    def timeline(self) -> DataFrame:
        """The ordered event log: user, assistant, thinking, tool_use, tool_result, other."""
        kind = F.when(F.col("b.type") == "text", F.col("line_type")).when(F.col("b.type").isin("thinking", "tool_use", "tool_result"), F.col("b.type")).otherwise("other")
        from_blocks = self.blocks.select("session_id", "seq", "pos", "ts", kind.alias("kind"), F.coalesce("text", "thinking", "content", "input").alias("summary"), F.col("name").alias("tool_name"),
                                         F.coalesce("id", "tool_use_id").alias("tool_use_id"), "is_error")
        plain = self.lines.filter("blocks IS NULL AND type IN ('user', 'assistant')").select(
            "session_id", "seq", F.lit(0).alias("pos"), "ts", F.col("type").alias("kind"), F.col("text").alias("summary"),
            *[F.lit(None).cast(t).alias(c) for c, t in (("tool_name", "string"), ("tool_use_id", "string"), ("is_error", "boolean"))],
        )
        both = from_blocks.unionByName(plain)
        return both.withColumn("ord", F.row_number().over(Window.partitionBy("session_id").orderBy("seq", "pos")))

    @cached_property
    def api_errors(self) -> DataFrame:
        rows = self.lines.filter("type = 'system' AND subtype = 'api_error'")
        get = lambda p: F.get_json_object("error", p)
        return rows.select("session_id", "seq", "ts", get("$.status").cast("int").alias("status"), F.coalesce(get("$.error.error.type"), get("$.error.type")).alias("cause_code"),
                           F.coalesce(get("$.error.error.message"), get("$.message")).alias("summary"), "level", "retryInMs", "retryAttempt", "maxRetries")

    def _system(self, subtype: str, *columns: str) -> DataFrame:
        return self.lines.filter((F.col("type") == "system") & (F.col("subtype") == subtype)).select("session_id", "seq", "ts", *columns)

    @cached_property
    def turns(self) -> DataFrame:
        return self._system("turn_duration", "durationMs", "messageCount")

    @cached_property
    def stop_hooks(self) -> DataFrame:
        """Stop-hook summaries with their plausible total duration (above 0, up to an hour) and number of errors."""
        total = F.aggregate(F.coalesce("hookInfos", F.array()), F.lit(0.0), lambda a, h: a + F.coalesce(h["durationMs"], F.lit(0.0)))
        rows = self._system("stop_hook_summary", "hookCount", "hookInfos", "hookErrors", "preventedContinuation")
        return rows.withColumn("total_ms", total).withColumn("timed_ms", F.when((F.col("total_ms") > 0) & (F.col("total_ms") <= 3_600_000), F.col("total_ms"))).withColumn("errors", F.greatest(F.size("hookErrors"), F.lit(0)))

    @cached_property
    def away_summaries(self) -> DataFrame:
        return self._system("away_summary", "content")

    @cached_property
    def scheduled_fires(self) -> DataFrame:
        return self._system("scheduled_task_fire", "content")

    @cached_property
    def permission_rows(self) -> DataFrame:
        return self.lines.filter("permissionMode IS NOT NULL").select("session_id", "seq", "ts", F.col("permissionMode").alias("mode"))

    @cached_property
    def permission_changes(self) -> DataFrame:
        was = F.lag("mode").over(Window.partitionBy("session_id").orderBy("seq"))
        return self.permission_rows.withColumn("was", was).filter("was <> mode")

    @cached_property
    def sessions(self) -> DataFrame:
        """A row a session: bounds, entries, dimensions from the first line that has them, and titles (custom before made)."""
        first = lambda c: F.min_by(c, F.when(F.col(c).isNotNull(), F.col("seq")))
        last = lambda c: F.max_by(c, F.when(F.col(c).isNotNull(), F.col("seq")))
        extra = [F.first("project", ignorenulls=True).alias("project")] if "project" in self.lines.columns else []
        return self.lines.groupBy("session_id").agg(
            F.min("ts").alias("start_ts"), F.max("ts").alias("end_ts"), F.count(F.lit(1)).alias("entries"), *[first(c).alias(c) for c in ("version", "gitBranch", "entrypoint")],
            F.coalesce(last("customTitle"), last("aiTitle")).alias("title"), *extra,
        ).withColumn("unattended", F.coalesce(F.col("entrypoint").startswith("sdk-"), F.lit(False)))

    @cached_property
    def attribution(self) -> DataFrame:
        """kind, name, invocations, output tokens by session."""
        rows = self.lines.filter("type = 'assistant'").select(
            "session_id", count("m.usage.output_tokens").alias("out"), F.explode(F.array(*[
                F.struct(F.lit(k).alias("kind"), F.col(c).alias("name")) for k, c in
                (("agent", "attributionAgent"), ("skill", "attributionSkill"), ("mcp_server", "attributionMcpServer"), ("mcp_tool", "attributionMcpTool"))])).alias("a"),
        )
        return rows.filter("a.name IS NOT NULL").groupBy("session_id", "a.kind", "a.name").agg(F.count(F.lit(1)).alias("invocations"), F.sum("out").alias("output_tokens"))

    @cached_property
    def tool_inventory(self) -> DataFrame:
        """available (additions less later removals), used and unused tools of each session."""
        rows = self.lines.filter("attachment.type = 'deferred_tools_delta'").select("session_id", "seq", F.explode(F.concat(
            F.transform(F.coalesce("attachment.addedNames", F.array()), lambda n: F.struct(n.alias("name"), F.lit(True).alias("there"))),
            F.transform(F.coalesce("attachment.readdedNames", F.array()), lambda n: F.struct(n.alias("name"), F.lit(True).alias("there"))),
            F.transform(F.coalesce("attachment.removedNames", F.array()), lambda n: F.struct(n.alias("name"), F.lit(False).alias("there"))))).alias("d"))
        state = rows.groupBy("session_id", "d.name").agg(F.max_by("d.there", F.struct("seq", "d.there")).alias("there")).filter("there")
        used = self.tool_calls.groupBy("session_id", F.col("tool_name").alias("name")).agg(F.count(F.lit(1)).alias("calls"))
        both = state.join(used, ["session_id", "name"], "left")
        return both.groupBy("session_id").agg(
            F.array_sort(F.collect_set("name")).alias("available"), F.array_sort(F.collect_set(F.when(F.col("calls") > 0, F.col("name")))).alias("used")
        ).withColumn("unused", F.array_except("available", "used"))


def read_history(spark: SparkSession, path: str) -> DataFrame:
    """The prompt log: session_id, ts (from epoch milliseconds), display, project; human turns only have text beyond a command."""
    raw = spark.read.text(path).select(F.from_json("value", "display string, timestamp double, project string, sessionId string, pastedContents map<string,struct<id:int,type:string,content:string>>").alias("e"))
    rows = raw.filter("e.sessionId IS NOT NULL").select(F.col("e.sessionId").alias("session_id"), F.timestamp_millis(F.col("e.timestamp").cast("bigint")).alias("ts"), "e.display", "e.project", "e.pastedContents")
    return rows.withColumn("human", F.col("display").rlike(r"^\s*[^/\s<]"))


def history_only(history: DataFrame, sessions: DataFrame) -> DataFrame:
    """History of sessions that no transcript covers."""
    return history.join(sessions.select("session_id"), "session_id", "left_anti")


def changed_files(signatures: DataFrame, known: DataFrame) -> DataFrame:
    """Files whose (size, modification time) is new: what an incremental run has to read again."""
    return signatures.join(known, ["path", "length", "modificationTime"], "left_anti")
