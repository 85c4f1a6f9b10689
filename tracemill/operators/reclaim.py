"""Savings without double counting: claims act one after the other on what earlier ones left.

The bill is a matrix of scopes (session and model) by token pools, each cell tokens times a rate.
A claim scales the tokens or the rate of some pools in some scopes to a factor from 0 to 1, in an
order that causes come before structure. A claim's marginal saving in a cell is what the cell was
worth just before it, times one minus its factor; so the marginals of a cell add up to its drop,
and the total does not depend on the order. With factors, what earlier claims left is a running
product, a window over a cell's claims in order: cells are independent and spread over the cluster.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.cost import breakdown

#: The order of causes; behaviour before structure.
CAUSES = ("errors", "retries", "rework", "interrupts", "context", "cache", "model", "structure")
POOLS = ("input", "output", "write_5m", "write_1h", "read")


def matrix(entries: DataFrame) -> DataFrame:
    """session_id, model, pool, usd: the priced cells of billed messages (with `base`)."""
    parts = breakdown("base")
    rows = entries.select("session_id", F.coalesce("model", F.lit("unknown")).alias("model"), *[parts[p].alias(p) for p in POOLS])
    cells = rows.groupBy("session_id", "model").agg(*[F.sum(p).alias(p) for p in POOLS])
    return cells.unpivot(["session_id", "model"], list(POOLS), "pool", "usd").filter("usd > 0")


def fresh_deletion(waste_tokens, fresh_tokens):
    """The factor that is left of fresh prompt tokens when `waste_tokens` of them are deleted; null where that is more than there are."""
    ratio = F.try_divide(waste_tokens, fresh_tokens)
    return F.when((ratio > 0) & (ratio <= 1), 1 - ratio)


def cascade(claims: DataFrame, cells: DataFrame) -> DataFrame:
    """claims (lever, cause, ord, session_id, model, pool, factor) with `before` (the cell's worth when the claim acts) and `marginal`.

    A claim whose factor is null or outside 0 to 1, or whose cell is not in the bill, saves nothing; a claim that lists a cell twice acts once.
    """
    rank = F.coalesce(F.array_position(F.array(*map(F.lit, CAUSES)), F.col("cause")), F.lit(0))
    good = claims.filter("factor >= 0 AND factor <= 1").dropDuplicates(["lever", "session_id", "model", "pool"])
    good = good.withColumn("_rank", F.when(rank == 0, len(CAUSES) + 1).otherwise(rank)).join(cells, ["session_id", "model", "pool"])
    w = Window.partitionBy("session_id", "model", "pool").orderBy("_rank", "ord", "lever").rowsBetween(Window.unboundedPreceding, -1)
    zero = F.coalesce(F.max((F.col("factor") == 0).cast("int")).over(w), F.lit(0))
    left = F.exp(F.coalesce(F.sum(F.log(F.when(F.col("factor") > 0, F.col("factor")))).over(w), F.lit(0.0)))
    good = good.withColumn("before", F.col("usd") * F.when(zero == 1, F.lit(0.0)).otherwise(left))
    return good.withColumn("marginal", F.col("before") * (1 - F.col("factor"))).drop("_rank")


def rollup(booked: DataFrame, cells: DataFrame, by: str = "lever") -> DataFrame:
    """by: marginal dollars and their share of the whole bill. The marginals add up to bill less what is left."""
    bill = cells.agg(F.sum("usd").alias("bill"))
    g = booked.groupBy(by).agg(F.sum("marginal").alias("marginal"), F.count_distinct("session_id").alias("sessions"))
    return g.crossJoin(F.broadcast(bill)).withColumn("share", F.col("marginal") / F.col("bill")).drop("bill")  # one row


def weekly(booked: DataFrame, weeks: DataFrame) -> DataFrame:
    """week, lever: marginal dollars, by the week (a column of session_id, week) of a session."""
    return booked.join(weeks, "session_id").groupBy("week", "lever").agg(F.sum("marginal").alias("marginal"))


def best_claims(claims: DataFrame) -> DataFrame:
    """Of several claims of one lever on one target the largest counts once: lever, usd of the sum over targets."""
    return claims.groupBy("lever", "target").agg(F.max("usd").alias("usd")).groupBy("lever").agg(F.sum("usd").alias("usd"), F.count(F.lit(1)).alias("targets"))
