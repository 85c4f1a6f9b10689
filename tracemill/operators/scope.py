"""Scoping tables to a time span, projects and route filters before anything is aggregated."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Hours of the time presets; None is all.
PRESETS = {"24h": 24, "7d": 168, "30d": 720, "all": None}


def within(df: DataFrame, ts: str, preset: str) -> DataFrame:
    """The rows of the preset's span, counted back from the table's own last time and not from the clock."""
    hours = PRESETS[preset]
    if hours is None:
        return df
    last = df.agg(F.max(ts).alias("_last"))
    start = F.col("_last") - F.expr(f"INTERVAL {hours} HOURS")
    return df.join(F.broadcast(last), F.col(ts).between(start, F.col("_last"))).drop("_last")  # one row


def overlapping(df: DataFrame, start: str, end: str, low: Column, high: Column) -> DataFrame:
    """The rows whose span touches [low, high]."""
    return df.filter((F.col(start) <= high) & (F.col(end) >= low))


def of_sessions(df: DataFrame, kept: DataFrame, key: str = "session_id") -> DataFrame:
    """The rows of the sessions that are left in another table."""
    return df.join(kept.select(key).distinct(), key, "left_semi")


def unattended(entrypoint: str = "entrypoint") -> Column:
    return F.coalesce(F.col(entrypoint).startswith("sdk-"), F.lit(False))


def route(df: DataFrame, **wanted) -> DataFrame:
    """Route parameters as predicates: equality by column name; `from_day`, `to_day` on `day`; `latency_gt_ms` (above) and
    `latency_lte_ms` (up to) on `latency_ms`. A parameter whose column the table lacks, or that is None, does nothing."""
    special = {
        "from_day": ("day", lambda v: F.col("day") >= F.lit(v)),
        "to_day": ("day", lambda v: F.col("day") <= F.lit(v)),
        "latency_gt_ms": ("latency_ms", lambda v: F.col("latency_ms") > v),
        "latency_lte_ms": ("latency_ms", lambda v: F.col("latency_ms") <= v),
    }
    for name, v in wanted.items():
        column, predicate = special.get(name, (name, lambda v, name=name: F.col(name) == F.lit(v)))
        if v is not None and column in df.columns:
            df = df.filter(predicate(v))
    return df


def page(df: DataFrame, order: list[Column], offset: int, limit: int) -> DataFrame:
    return df.orderBy(*order).offset(offset).limit(limit)


def unlisted(available: DataFrame, used: DataFrame, key: list[str]) -> DataFrame:
    """What is available and not used."""
    return available.join(used.select(*key).distinct(), key, "left_anti")
