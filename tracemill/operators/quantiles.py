"""Exact quantiles of groups of any size.

A group of up to `limit` rows is one task's work. In larger ones each wanted rank is enclosed by probes:
approximate quantiles of the rows that are still in question become probes, the rows below, at and between
them are counted exactly, and the rank's bin is the next enclosure. A probe that is the value itself ends
the search, so a value that a third of all rows have costs a round and no more; else an enclosure of at
most `limit` rows is read off its running counts.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..session import materialized

#: Rows that one task may order, and probes a round.
LIMIT, PROBES = 1_000_000, 64


def _ranks(large: DataFrame, key: list[str], qs: list[float]) -> DataFrame:
    """A row a group and rank (counted from 0) next to the wanted positions."""
    at = [f(F.lit(q) * (F.col("n") - 1)).cast("bigint") for q in qs for f in (F.floor, F.ceil)]
    none = F.lit(None).cast("double")
    return large.select(*key, F.explode(F.array_distinct(F.array(*at))).alias("rank"), F.lit(0).cast("bigint").alias("base"), none.alias("lo"), none.alias("hi"))


def _selected(rows: DataFrame, want: DataFrame, key: list[str], limit: int) -> DataFrame:
    """key, rank, v: the values at the wanted ranks."""
    by, found = [*key, "rank"], []
    while True:
        inside = rows.join(want, key).filter("(lo IS NULL OR v > lo) AND (hi IS NULL OR v < hi)")
        cuts = [i / (PROBES + 1) for i in range(1, PROBES + 1)]
        state = materialized(inside.groupBy(*by, "base", "lo", "hi").agg(F.count(F.lit(1)).alias("c"), F.array_sort(F.array_distinct(F.percentile_approx("v", cuts, 1000))).alias("p")))
        small = want.join(state.filter(F.col("c") <= limit).select(*by), by, "left_semi")
        counts = rows.join(small, key).filter("(lo IS NULL OR v > lo) AND (hi IS NULL OR v < hi)").groupBy(*by, "base", "v").agg(F.count(F.lit(1)).alias("c"))
        before = Window.partitionBy(*by).orderBy("v").rowsBetween(Window.unboundedPreceding, -1)  # at most `limit` rows
        placed = counts.withColumn("first", F.col("base") + F.coalesce(F.sum("c").over(before), F.lit(0)))
        found.append(placed.filter("first <= rank AND rank < first + c").select(*by, "v"))
        large = state.filter(F.col("c") > limit)
        if large.isEmpty():
            break
        # bin 2i: between probes i - 1 and i; bin 2i + 1: at probe i
        below = F.size(F.filter("p", lambda x: x < F.col("v")))
        binned = rows.join(large.drop("c"), key).filter("(lo IS NULL OR v > lo) AND (hi IS NULL OR v < hi)")
        binned = binned.withColumn("bin", 2 * below + F.coalesce(F.get("p", below) == F.col("v"), F.lit(False)).cast("int")).groupBy(*by, "bin").agg(F.count(F.lit(1)).alias("c"))
        up_to = Window.partitionBy(*by).orderBy("bin").rowsBetween(Window.unboundedPreceding, -1)  # a row a bin
        binned = binned.join(large.drop("c"), by).withColumn("first", F.col("base") + F.coalesce(F.sum("c").over(up_to), F.lit(0))).filter("first <= rank AND rank < first + c")
        binned = materialized(binned.withColumn("i", F.floor(F.col("bin") / 2).cast("int")))
        found.append(binned.filter("bin % 2 = 1").select(*by, F.get("p", F.col("i")).alias("v")))
        edge = lambda at, old: F.coalesce(F.get("p", at), F.col(old)).alias(old)
        want = binned.filter("bin % 2 = 0").select(*by, F.col("first").alias("base"), edge(F.col("i") - 1, "lo"), edge(F.col("i"), "hi"))
    out = found[0]
    for more in found[1:]:
        out = out.unionByName(more)
    return out


def exact_quantiles(df: DataFrame, key: list[str], value: str, qs: list[float], limit: int = LIMIT) -> DataFrame:
    """key, n, q (an array, as qs): interpolated quantiles of the values that are not null; without a key one row, if there is a value.

    Values are read as doubles. Keys are compared by equality, null among them.
    """
    names = [f"_k{i}" for i in range(len(key))]
    if not key:
        names, df = ["_k0"], df.withColumn("_all", F.lit(0))
        key = ["_all"]
    # a null key as a key of its own, so that joins keep it
    keyed = [F.struct(F.col(k).isNull().alias("none"), F.coalesce(F.col(k).cast("string"), F.lit("")).alias("v")).alias(n) for k, n in zip(key, names)]
    rows = materialized(df.filter(F.col(value).isNotNull()).select(*keyed, *key, F.col(value).cast("double").alias("v")))
    totals = materialized(rows.groupBy(*names).agg(*[F.first(k).alias(k) for k in key], F.count(F.lit(1)).alias("n")))
    shown = [*key, "n"] if key != ["_all"] else ["n"]
    wanted = F.array(*[F.lit(float(q)) for q in qs])
    large = totals.filter(F.col("n") > limit)
    if large.isEmpty():
        return rows.groupBy(*names).agg(*[F.first(k).alias(k) for k in key], F.count(F.lit(1)).alias("n"), F.percentile("v", wanted).alias("q")).select(*shown, "q")
    small = rows.join(totals.filter(F.col("n") <= limit).select(*names), names, "left_semi")
    exact = small.groupBy(*names).agg(F.percentile("v", wanted).alias("q"))
    narrow = rows.select(*names, "v")
    picked = _selected(narrow, materialized(_ranks(large, names, qs)), names, limit).groupBy(*names).agg(F.map_from_entries(F.collect_list(F.struct("rank", "v"))).alias("m"))  # two ranks a quantile

    def at(q: float):
        place = F.lit(float(q)) * (F.col("n") - 1)
        low, high = F.col("m")[F.floor(place).cast("bigint")], F.col("m")[F.ceil(place).cast("bigint")]
        return low + (high - low) * (place - F.floor(place))

    chosen = large.join(picked, names).select(*names, F.array(*[at(q) for q in qs]).alias("q"))
    return totals.join(exact.unionByName(chosen), names).select(*shown, "q")
