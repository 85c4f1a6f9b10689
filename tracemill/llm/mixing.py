"""Mixing sources to target weights as a time-varying curriculum.

Each source has a weight schedule over training time 0 to 1, piecewise linear. Its integral,
scaled to the source's target, is the source's cumulative token demand. A source offers its
documents in a fixed pseudo-random order, over and over; inverting the demand at the words
offered before a document gives the document's training position, by which the rows are sorted.
What is offered when the schedule ends is cut at the target, inside a document if need be, so a
source's taken words are its target rounded down.

Targets share all words by weight 1, 2, 3, repeating over the sources by code point, null last;
a target stops at three times its source's words and the excess is shared by weight again. The
fixed point is found in one pass over the sources sorted by cap to weight.

Edge cases: a null source is a source; a null or empty text has size 0 and takes 0; a null id
orders first; repeated rows each take their own place; an empty table gives no rows; other
columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import WORD, written

CAP = 3
#: (time, relative weight) knots of the schedules, by weight class 1, 2, 3.
SCHEDULES = {1: [(0.0, 1.5), (0.5, 1.0), (1.0, 0.5)], 2: [(0.0, 1.0), (0.5, 1.0), (1.0, 1.0)], 3: [(0.0, 0.5), (0.5, 1.0), (1.0, 1.5)]}
#: Hexadecimal digits of the order key that name a block of a source's documents.
BLOCK_DIGITS = 3


def measured(docs: DataFrame) -> DataFrame:
    """Rows' place in the order of their source and their words."""
    order = F.coalesce(F.md5(F.col("doc_id").cast("string")), F.lit(""))
    return docs.select(
        "*",
        F.coalesce(F.regexp_count("text", F.lit(WORD)), F.lit(0)).cast("bigint").alias("_size"),
        order.alias("_order"),
        F.substring(order, 1, BLOCK_DIGITS).alias("_block"),
        F.coalesce(F.concat(F.lit("s"), "source"), F.lit("t")).alias("_source"),
    )


def targets(sizes: DataFrame) -> DataFrame:
    """_source, source_size to these with weight and target. The windows run over one row a source."""
    by_name = Window.orderBy("_source")
    by_ratio = Window.orderBy("ratio", "_source")
    rows = sizes.withColumn("weight", (F.row_number().over(by_name) - 1) % 3 + 1)
    rows = rows.withColumn("cap", (CAP * F.col("source_size")).cast("double")).withColumn("ratio", F.col("cap") / F.col("weight"))
    rows = rows.withColumn("rank", F.row_number().over(by_ratio))
    before = by_ratio.rowsBetween(Window.unboundedPreceding, -1)
    after = by_ratio.rowsBetween(Window.currentRow, Window.unboundedFollowing)
    everything = Window.partitionBy()
    level = (F.sum("source_size").over(everything) - F.coalesce(F.sum("cap").over(before), F.lit(0.0))) / F.sum("weight").over(after)
    rows = rows.withColumn("level", level)
    share = F.min_by(F.when(F.col("level") <= F.col("ratio"), F.col("level")), F.when(F.col("level") <= F.col("ratio"), F.col("rank"))).over(everything)
    return rows.select("_source", "source_size", "weight", F.least("cap", F.coalesce(share, F.lit(0.0)) * F.col("weight")).alias("target"))


def position(demand: Column, target: Column, weight: Column, schedules=SCHEDULES) -> Column:
    """The training time at which a source of that weight has used up `demand` words of its `target`."""
    out = F.lit(None).cast("double")
    for cls, knots in schedules.items():
        areas = [(b[0] - a[0]) * (a[1] + b[1]) / 2 for a, b in zip(knots, knots[1:])]
        whole, below, here = sum(areas), 0.0, F.lit(1.0)
        pieces = []
        for (t0, w0), (t1, w1), area in zip(knots, knots[1:], areas):
            pieces.append((below, t0, w0, (w1 - w0) / (t1 - t0)))
            below += area
        used = demand / target * whole
        for low, t0, w0, slope in pieces:
            rest = used - low
            value = t0 + 2.0 * rest / (w0 + F.sqrt(F.greatest(F.lit(0.0), w0 * w0 + 2.0 * slope * rest)))
            here = F.when(used >= low, value).otherwise(here) if low else value
        out = F.when(weight == cls, here).otherwise(out)
    return out


def mixed(rows: DataFrame) -> DataFrame:
    """`measured` rows with source_size, target, weight, offered (words of its source before it), demand and taken."""
    blocks = rows.groupBy("_source", "_block").agg(F.sum("_size").alias("block_size"))
    sources = targets(blocks.groupBy("_source").agg(F.sum("block_size").alias("source_size")))
    earlier = Window.partitionBy("_source").orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
    offsets = blocks.select("_source", "_block", F.coalesce(F.sum("block_size").over(earlier), F.lit(0)).alias("offset")).join(sources, "_source")
    within = Window.partitionBy("_source", "_block").orderBy("_order", "doc_id", "_size").rowsBetween(Window.unboundedPreceding, -1)
    rows = rows.join(offsets, ["_source", "_block"])
    rows = rows.withColumn("offered", F.col("offset") + F.coalesce(F.sum("_size").over(within), F.lit(0)))
    rows = rows.withColumn("demand", F.floor("target"))
    taken = sum(
        (F.greatest(F.lit(0), F.least(F.col("_size"), F.col("demand") - F.col("source_size") * k - F.col("offered"))) for k in range(CAP)),
        F.lit(0),
    )
    return rows.withColumn("taken", taken.cast("bigint"))


def mix(docs: DataFrame) -> DataFrame:
    """One row a document: doc_id, size, source_size, target, taken and the training position (null where nothing is taken), sorted by position."""
    narrow = written(measured(docs.select("doc_id", "text", "source")).select("doc_id", "source", "_size", "_order", "_block", "_source"))
    place = F.when(F.col("taken") > 0, position(F.col("offered").cast("double"), F.col("target"), F.col("weight")))
    return (
        mixed(narrow)
        .select("doc_id", F.col("_size").alias("size"), "source_size", "target", "taken", place.alias("position"))
        .orderBy(F.col("position").asc_nulls_last(), "doc_id")
    )


def mixture(docs: DataFrame) -> DataFrame:
    """The training set itself: docs' columns, a row for every copy taken, in training order.

    The copy in which its source's demand ends keeps its first words only.
    """
    words = [F.least(F.col("_size"), F.col("demand") - F.col("source_size") * k - F.col("offered")) for k in range(CAP)]
    whole = docs.select("doc_id", "text", "source", F.struct(*docs.columns).alias("_row"))  # in a struct, no column of docs can clash
    rows = mixed(measured(whole).drop("text", "source")).filter("taken > 0")
    rows = rows.select("*", F.posexplode(F.filter(F.array(*words), lambda n: n > 0)).alias("_copy", "_words"))
    first = F.expr(r"regexp_extract(_row.text, concat('^[\\x20\\x09-\\x0D]*+(?:[^\\x20\\x09-\\x0D]++[\\x20\\x09-\\x0D]*+){', _words, '}+'), 0)")
    text = F.when(F.col("_words") < F.col("_size"), first).otherwise(F.col("_row.text"))
    place = position((F.col("offered") + F.col("_copy") * F.col("source_size")).cast("double"), F.col("target"), F.col("weight"))
    row = F.col("_row").withField("text", text)
    return rows.select(row.alias("_row"), place.alias("_place"), "doc_id").orderBy("_place", "doc_id").select("_row.*")
