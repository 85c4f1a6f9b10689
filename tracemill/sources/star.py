"""The star-schema tables as session tables, so that the rules run on them too.

An event is a tool call (event type: tool, user: session, value: kilobytes of result, an error or
a value above 150: failed); a line item is a billed message of its order; conversations are
timelines.
"""

from __future__ import annotations

import datetime as dt

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..plans.rules import Signals


def tool_calls(events: DataFrame) -> DataFrame:
    none = F.lit(None).cast("string")
    order = F.row_number().over(Window.partitionBy("user_id").orderBy("ts", "event_id"))
    return events.select(
        F.col("user_id").cast("string").alias("session_id"), F.col("event_id").cast("string").alias("tool_use_id"), F.col("event_id").alias("seq"), F.lit(0).alias("pos"),
        F.col("ts").cast("timestamp").alias("ts"), F.col("event_type").alias("tool_name"), F.col("props").alias("input_json"),
        F.struct(none.alias("command"), F.concat(F.lit("/"), F.get_json_object("props", "$.k")).alias("file_path")).alias("input"),
        ((F.col("event_type") == "error") | (F.col("value") > 150)).alias("is_error"), F.floor(F.col("value") * 1000).alias("result_bytes"),
        F.col("ts").cast("timestamp").alias("result_ts"), order.alias("ord"),
    )


def token_entries(lineitem: DataFrame) -> DataFrame:
    whole = lambda c: F.floor(c).cast("bigint")
    zero = F.lit(0).cast("bigint")
    return lineitem.select(
        F.col("l_orderkey").cast("string").alias("session_id"), F.concat_ws("-", "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey").alias("message_id"), F.col("l_linenumber").cast("bigint").alias("seq"),
        F.col("l_shipdate").cast("timestamp").alias("ts"), F.col("l_linestatus").alias("model"), F.when(F.col("l_returnflag") == "A", "sdk-py").otherwise("cli").alias("entrypoint"),
        F.lit(None).cast("string").alias("service_tier"), F.when(F.col("l_quantity") < 49, F.lit(3.0)).alias("base"), whole(F.col("l_quantity") * 100).alias("input"), whole(F.col("l_quantity") * 10).alias("output"),
        whole(F.col("l_extendedprice") * F.col("l_tax")).alias("cache_creation"), zero.alias("cache_creation_1h"), whole(F.col("l_extendedprice") * F.col("l_discount")).alias("cache_read"), zero.alias("web_search"),
        whole(F.col("l_quantity")).alias("visible"), zero.alias("thinking"),
    )


def timeline(conversations: DataFrame) -> DataFrame:
    return conversations.select(
        F.col("conv_id").cast("string").alias("session_id"), F.col("turn").cast("int").alias("ord"), F.timestamp_seconds(F.col("turn") * 60).alias("ts"), F.col("role").alias("kind"), F.col("text").alias("summary")
    )


def sessions(orders: DataFrame) -> DataFrame:
    start = F.col("o_orderdate").cast("timestamp")
    return orders.select(F.col("o_orderkey").cast("string").alias("session_id"), F.concat(F.lit("p"), "o_custkey").alias("project"), start.alias("start_ts"), start.alias("end_ts"), (F.col("o_orderpriority") == "1-URGENT").alias("unattended"))


def signals(t, now: dt.datetime = dt.datetime(1998, 12, 31)) -> Signals:
    """Signals over the tables of a folder; what has no stand-in stays dark."""
    return Signals(now, {"tool_calls": tool_calls(t.events), "token_entries": token_entries(t.lineitem), "timeline": timeline(t.conversations), "sessions": sessions(t.orders)})
