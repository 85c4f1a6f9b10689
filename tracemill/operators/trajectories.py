"""Runs of tools that recur in sessions that ended well."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..session import materialized

#: Lengths of runs, and the sessions in which one has to recur.
SHORTEST, LONGEST, LEAST_SESSIONS = 3, 5, 2
ARROW = " -> "


def recurring_runs(calls: DataFrame, outcomes: DataFrame, shortest: int = SHORTEST, longest: int = LONGEST, least: int = LEAST_SESSIONS) -> DataFrame:
    """signature, length, sessions and occurrences of runs of tools in at least `least` good sessions, and whether each is closed.

    A run that a run one tool longer contains, in as many sessions and as often, says nothing of its own
    and is not closed; since support only falls with length, no longer one has to be looked at. Each run
    names the two it contains, so runs meet by equality and are never compared with each other. Runs of
    one tool only are retries and left out.

    calls: session_id, ord, tool; outcomes: session_id, good.
    """
    w = Window.partitionBy("session_id").orderBy("ord")
    good = calls.join(outcomes.filter("good").select("session_id").distinct(), "session_id", "left_semi")
    ahead = good.select("session_id", *[(F.col("tool") if k == 0 else F.lead("tool", k).over(w)).alias(f"t{k}") for k in range(longest)])
    whole = [F.when(F.col(f"t{n - 1}").isNotNull(), F.array(*[f"t{k}" for k in range(n)])) for n in range(shortest, longest + 1)]
    runs = ahead.select("session_id", F.explode(F.array_compact(F.array(*whole))).alias("run")).filter(F.size(F.array_distinct("run")) > 1)
    each = runs.groupBy("run", "session_id").agg(F.count(F.lit(1)).alias("n"))
    found = materialized(each.groupBy("run").agg(F.count(F.lit(1)).alias("sessions"), F.sum("n").alias("occurrences")).filter(F.col("sessions") >= least))
    size = F.size("run")
    inner = F.array(F.slice("run", F.lit(1), size - 1), F.slice("run", F.lit(2), size - 1))
    covered = found.select(F.explode(inner).alias("run"), "sessions", "occurrences").distinct().withColumn("covered", F.lit(True))
    rows = found.join(covered, ["run", "sessions", "occurrences"], "left")
    return rows.select(F.array_join("run", ARROW).alias("signature"), size.alias("length"), "sessions", "occurrences", F.col("covered").isNull().alias("closed"))


def best_runs(found: DataFrame, top: int = 5) -> DataFrame:
    """A top-k report: closed runs of most sessions, then the longest, then by name."""
    return found.filter("closed").orderBy(F.desc("sessions"), F.desc("length"), "signature").limit(top)
