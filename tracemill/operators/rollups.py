"""Aggregation operators: top-n with a rest, allocation, histograms, shares, trends."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def top_n_other(df: DataFrame, label: str, value: str, n: int) -> DataFrame:
    """The n labels of largest value, and one row `Other` with the rest; ties by label."""
    rank = F.row_number().over(Window.orderBy(F.desc(value), F.col(label)))
    named = df.withColumn("rank", F.least(rank, F.lit(n + 1)))
    return named.groupBy("rank").agg(
        F.when(F.first("rank") <= n, F.first(label)).otherwise(F.lit("Other")).alias(label), F.sum(value).alias(value), F.count(F.lit(1)).alias("members")
    )


def top_per_group(df: DataFrame, group: list[str], order: list[Column], n: int = 1) -> DataFrame:
    """The first n rows of each group."""
    return df.withColumn("rank", F.row_number().over(Window.partitionBy(*group).orderBy(*order))).filter(F.col("rank") <= n)


def allocate(df: DataFrame, scope: list[str], amount: str, weight: str, out: str) -> DataFrame:
    """Share out a scope's amount in proportion to weight; equally where all weights are 0."""
    w = Window.partitionBy(*scope)
    total, rows = F.sum(weight).over(w), F.count(F.lit(1)).over(w)
    return df.withColumn(out, F.col(amount) * F.when(total > 0, F.col(weight) / total).otherwise(1 / rows))


def bucketed(value: Column, edges: list[float]) -> Column:
    """The number of edges below value: buckets include their upper edge."""
    return sum((F.when(value > e, 1).otherwise(0) for e in edges), F.lit(0))


def histogram(df: DataFrame, value: Column, edges: list[float]) -> DataFrame:
    """bucket, n for every bucket, empty ones too."""
    counts = df.filter(value.isNotNull()).select(bucketed(value, edges).alias("bucket")).groupBy("bucket").agg(F.count(F.lit(1)).alias("n"))
    spine = df.sparkSession.range(len(edges) + 1).select(F.col("id").cast("int").alias("bucket"))
    return spine.join(counts, "bucket", "left").select("bucket", F.coalesce("n", F.lit(0)).alias("n"))


def share(value: str, scale: float = 100.0) -> Column:
    """A column's part of its total over the result."""
    return scale * F.col(value) / F.sum(value).over(Window.partitionBy())


def min_max(value: str) -> Column:
    """A column scaled to 0..1 over the result; 0 where it is constant."""
    w = Window.partitionBy()
    low, high = F.min(value).over(w), F.max(value).over(w)
    return F.when(high > low, (F.col(value) - low) / (high - low)).otherwise(F.lit(0.0))


def versus_prior(df: DataFrame, order: str, value: str, rows: int) -> DataFrame:
    """The last `rows` rows against as many before them: current, prior, change (null where there is no prior)."""
    r = df.withColumn("_r", F.row_number().over(Window.orderBy(F.desc(order))))
    now, before = F.sum(F.when(F.col("_r") <= rows, F.col(value))), F.sum(F.when((F.col("_r") > rows) & (F.col("_r") <= 2 * rows), F.col(value)))
    return r.agg(now.alias("current"), before.alias("prior")).withColumn("change", F.when(F.col("prior") > 0, (F.col("current") - F.col("prior")) / F.col("prior")))
