"""Ordered-sequence operators: islands, spans by boundary, as-of and interval joins, look-ahead.

All are windows partitioned by the sequence's key, so they need one exchange on it; none joins a
sequence with itself. Times are microseconds since the epoch unless a column says otherwise.

What follows a row is taken in reverse order (`following`): a frame that starts at the partition's
beginning grows by a row at a time, while one that runs to its end is computed anew for each row.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def micros(ts: str | Column) -> Column:
    """A timestamp, with or without zone, as microseconds since the epoch (UTC)."""
    c = F.col(ts) if isinstance(ts, str) else ts
    return F.unix_micros(c.cast("timestamp"))


def following(key: list[str], order: list[str | Column], at_once: bool = False):
    """The rows after a row (with at_once, the row too) as a frame of the reversed order: use last() for the nearest."""
    w = Window.partitionBy(*key).orderBy(*[(F.col(c) if isinstance(c, str) else c).desc_nulls_last() for c in order])
    return w.rowsBetween(Window.unboundedPreceding, 0 if at_once else -1)


def islands(df: DataFrame, key: list[str], order: list[str], same: list[str], time: str, gap_us: int, out: str = "island") -> DataFrame:
    """Number the runs within a key whose rows agree in `same` and follow within gap_us (inclusive)."""
    w = Window.partitionBy(*key).orderBy(*order)
    begins = F.lag(time).over(w).isNull() | (F.col(time) - F.lag(time).over(w) > gap_us)
    for c in same:
        begins = begins | ~F.col(c).eqNullSafe(F.lag(c).over(w))
    return df.withColumn("_begins", begins.cast("int")).withColumn(out, F.sum("_begins").over(w.rowsBetween(Window.unboundedPreceding, 0))).drop("_begins")


def span_index(df: DataFrame, key: list[str], order: list[str], boundary: Column, inclusive: bool, out: str = "span") -> DataFrame:
    """Number of boundaries up to a row: itself counted (a boundary opens the next span) or not (it closes its own)."""
    w = Window.partitionBy(*key).orderBy(*order)
    frame = w.rowsBetween(Window.unboundedPreceding, 0 if inclusive else -1)
    return df.withColumn(out, F.coalesce(F.sum(F.when(boundary, 1).otherwise(0)).over(frame), F.lit(0)))


def asof(left: DataFrame, right: DataFrame, key: list[str], left_time: str, right_time: str, value: str, forward: bool = False, out: str = "asof") -> DataFrame:
    """For each left row the value and time of the nearest right row at or before its time (or at or after).

    The sides are stacked and a running last (first) value is taken, which stays linear where an
    interval join would be quadratic. Right rows of equal time count; of several, the largest value.
    """
    l = left.select("*", F.lit(1 if not forward else 0).alias("_side"), F.col(left_time).alias("_t"), F.lit(None).cast(right.schema[value].dataType).alias("_v"), F.lit(None).cast(right.schema[right_time].dataType).alias("_rt"))  # noqa: E741
    r = right.select(*key, F.col(right_time).alias("_t"), F.col(value).alias("_v"), F.col(right_time).alias("_rt"), F.lit(0 if not forward else 1).alias("_side"))
    stacked = l.unionByName(r, allowMissingColumns=True)
    w = Window.partitionBy(*key).orderBy("_t", "_side", "_v")
    frame = following(key, ["_t", "_side", "_v"], at_once=True) if forward else w.rowsBetween(Window.unboundedPreceding, 0)
    found = stacked.withColumn(out, F.last("_v", ignorenulls=True).over(frame)).withColumn(f"{out}_time", F.last("_rt", ignorenulls=True).over(frame))
    return found.filter(F.col("_side") == (0 if forward else 1)).drop("_side", "_t", "_v", "_rt")


def look_ahead(df: DataFrame, key: list[str], order: list[str], rows: int, expr: Column, out: str) -> DataFrame:
    """An aggregate of the next rows."""
    w = Window.partitionBy(*key).orderBy(*order).rowsBetween(1, rows)
    return df.withColumn(out, expr.over(w))


def next_where(df: DataFrame, key: list[str], order: list[str], condition: Column, value: Column, out: str) -> DataFrame:
    """The value of the next row that meets a condition, whatever lies between."""
    return df.withColumn(out, F.last(F.when(condition, value), ignorenulls=True).over(following(key, order)))


def ngrams(df: DataFrame, key: list[str], order: list[str], item: str, sizes: range, out: str = "gram") -> DataFrame:
    """All contiguous runs of so many items of a sequence, as text joined by `>`; by leads, so a long sequence stays rows."""
    w = Window.partitionBy(*key).orderBy(*order)
    following = [F.col(item), *[F.lead(item, k).over(w) for k in range(1, max(sizes))]]
    grams = [F.when(following[n - 1].isNotNull(), F.concat_ws(">", *following[:n])) for n in sizes]
    return df.select(*key, F.array_compact(F.array(*grams)).alias("_grams")).select(*key, F.explode("_grams").alias(out))


def calendar(df: DataFrame, day: str, keys: list[str] | None = None) -> DataFrame:
    """A row a day from the first to the last day of df (of each key)."""
    bounds = df.groupBy(*(keys or [])).agg(F.min(day).alias("_a"), F.max(day).alias("_b"))
    return bounds.select(*(keys or []), F.explode(F.sequence("_a", "_b", F.expr("interval 1 day"))).alias(day))


def lifecycle(df: DataFrame, key: list[str], order: list[str], event: str) -> DataFrame:
    """The state that a key's events lead to in their order: shown, applied, verified or reverted; and how often each way was gone.

    An ordered fold as running maxima: a verification counts only while something is applied, that is
    where the last application before it is later than the last reversal; a reversal only undoes what
    is applied. The last event that counted is the state.
    """
    w = Window.partitionBy(*key).orderBy(*order)
    before = w.rowsBetween(Window.unboundedPreceding, -1)
    rows = df.withColumn("_n", F.row_number().over(w))
    at = lambda e: F.coalesce(F.max(F.when(F.col(event) == e, F.col("_n"))).over(before), F.lit(0))
    rows = rows.withColumn("_on", at("applied") > at("reverted"))
    counts = F.col(event).isin("shown", "applied") | (F.col(event).isin("verified", "reverted") & F.col("_on"))
    kept = rows.filter(counts)
    later = kept.filter((F.col(event) != "shown") | ~F.col("_on"))
    of = lambda e: F.count_if(F.col(event) == e).alias(e)
    return kept.groupBy(*key).agg(*[of(e) for e in ("shown", "applied", "verified", "reverted")]).join(later.groupBy(*key).agg(F.max_by(event, "_n").alias("state")), key)
