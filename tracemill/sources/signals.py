"""From transcripts to the tables that rules read, so that recommendations can be built end to end."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.cost import base_price
from ..operators.deceit import from_transcripts as unborne
from ..plans.rules import Signals
from .transcripts import Transcripts

#: What a user's turn says about the work so far, tried in this order.
STEERING = (
    ("corrective", r"\b(?:no|not|wrong|don't|stop|instead|undo|revert|still|again|broken|fails?)\b"),
    ("clarifying", r"\?\s*$|\b(?:what|why|how|which|where|when|explain)\b"),
    ("approving", r"\b(?:yes|ok|okay|good|great|thanks|thank you|perfect|lgtm|continue|proceed|go ahead)\b"),
)


def steering_kind(text: str | Column) -> Column:
    """corrective, clarifying, approving or other."""
    t, out = F.lower(F.col(text) if isinstance(text, str) else text), F.lit("other")
    for kind, pattern in reversed(STEERING):
        out = F.when(t.rlike(pattern), kind).otherwise(out)
    return out


def specificity(text: str | Column) -> Column:
    """How concrete an opening is, 0 to 1: a quarter each for length, a path, a number or identifier, and a list or code."""
    t = F.col(text) if isinstance(text, str) else text
    signs = (F.length(t) >= 120, t.rlike(r"[\w-]+/[\w./-]+|\w+\.(?:py|ts|js|go|rs|java|md|json)\b"), t.rlike(r"\d|[a-z]_[a-z]|[a-z][A-Z]"), t.rlike(r"(?m)^\s*(?:[-*]|\d+\.)\s|`"))
    return sum((F.coalesce(s, F.lit(False)).cast("double") for s in signs), F.lit(0.0)) / 4


def steering(timeline: DataFrame, tool_calls: DataFrame) -> DataFrame:
    """session_id: how concrete its opening is, turns after it, corrections among them, and success: the smoothed share of calls that did not fail."""
    turns = timeline.filter("kind = 'user' AND summary IS NOT NULL").withColumn("_n", F.row_number().over(Window.partitionBy("session_id").orderBy("ord")))
    said = turns.groupBy("session_id").agg(
        F.max(F.when(F.col("_n") == 1, specificity("summary"))).alias("specificity"), F.count_if(F.col("_n") > 1).alias("turns"), F.count_if((F.col("_n") > 1) & (steering_kind("summary") == "corrective")).alias("corrections")
    )
    done = tool_calls.groupBy("session_id").agg(((F.count_if(~F.coalesce("is_error", F.lit(False))) + 1) / (F.count(F.lit(1)) + 2)).alias("success"))
    return said.join(done, "session_id").select("session_id", "specificity", "turns", F.col("corrections").cast("double").alias("corrections"), "success")


def from_transcripts(t: Transcripts, now: dt.datetime, **artifacts: DataFrame) -> Signals:
    """Signals of a set of transcripts at a moment, with the tables of side artifacts by name (tasks, workflows, plans, live_config, ...)."""
    entries = t.token_entries.withColumn("base", base_price("model"))
    calls = t.tool_calls
    daily = calls.groupBy(F.to_date("ts").alias("day")).agg(F.count(F.lit(1)).alias("tool_calls"))
    tables = {
        "token_entries": entries, "tool_calls": calls, "sessions": t.sessions, "api_errors": t.api_errors, "timeline": t.timeline, "turns": t.turns, "stop_hooks": t.stop_hooks,
        "permission_rows": t.permission_rows, "attribution": t.attribution, "tool_inventory": t.tool_inventory, "daily": daily, "steering": steering(t.timeline, calls),
        "deceit": unborne(t).select("session_id", "unbacked", "contradicted"),
    }
    return Signals(now, {**tables, **artifacts})
