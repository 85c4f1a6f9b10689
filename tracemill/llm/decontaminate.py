"""Benchmark decontamination by size-partitioned MinHash containment search.

An item is contained in a document when at least 80% of its distinct five-word shingles occur
there. Items of equal shingle sets form one class. Classes are partitioned by their number of
shingles into ranges (1 to 2, 3 to 4, 5 to 8, ...). Within a range every class has a bottom-k
MinHash sketch (its k smallest shingle hashes) of one length, floor(0.2 u) + 1 + `MARGIN` for the
range's largest size u. The share of a sketch's values found in a document estimates the class's
containment there; a class of n shingles may lack floor(n / 5) of them, so a pair is a candidate
from k - floor(n / 5) common values on, which loses no contained item and is far above chance
(at least MARGIN + 1 values, for sets as large as that). A document's side has all its shingle
hashes: a sketch of the document would hold a short item's values only by luck. Documents with too
few shingles for a range are not looked up in it. Exact containment over all shingles decides.

The index of sketches is broadcast only while it has at most `BROADCAST_ROWS` rows; a larger one
is joined by shuffle. Documents are keyed by id and text hash, so repeated ids are kept apart.

Edge cases: an item of fewer than five words is one shingle, found only in a document of the
same words; null and empty items and documents have no shingles and are never linked; repeated
items are listed by each id (of any type), repeated documents are answered each, null ids like
others; long documents are looked up whole; an empty benchmark marks nothing, an empty table gives
no rows; other columns are kept, those with the result's names are replaced.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import shingles, written

CONTAINMENT = 0.8
BROADCAST_ROWS = 200_000
#: Sketch values beyond those that a contained item may lack.
MARGIN = 3


def _missing(size: Column) -> Column:
    """How many of so many shingles may be missing: a fifth, in whole numbers."""
    return F.floor(size / 5)


def _range_top(size: Column) -> Column:
    """The largest size of the range that holds size: the next power of two."""
    return F.pow(F.lit(2.0), F.ceil(F.log2(size.cast("double")))).cast("int")


def item_sets(items: DataFrame, id_col: str = "item_id", text_col: str = "text") -> DataFrame:
    """class, item_ids, item_set, item_size, range_top, sketch of every distinct item with a shingle; how many shingles (needs) and sketch values (common) a document needs at least."""
    rows = items.select(F.col(id_col).alias("item_id"), F.array_sort(shingles(F.col(text_col))).alias("item_set")).filter(F.size("item_set") > 0)
    rows = rows.groupBy("item_set").agg(F.collect_list("item_id").alias("item_ids"))
    rows = rows.withColumn("class", F.xxhash64("item_set")).withColumn("item_size", F.size("item_set")).withColumn("range_top", _range_top(F.col("item_size")))
    k = _missing(F.col("range_top")) + 1 + MARGIN
    rows = rows.withColumn("sketch", F.slice("item_set", F.lit(1), k.cast("int")))
    missing = _missing(F.col("item_size"))
    return rows.withColumn("needs", (F.col("item_size") - missing).cast("int")).withColumn("common", (F.size("sketch") - missing).cast("int"))


def _maybe_broadcast(df: DataFrame, limit: int) -> DataFrame:
    """df as a broadcast side if it has at most limit rows."""
    return F.broadcast(df) if df.limit(limit + 1).count() <= limit else df


def _keys(docs: DataFrame) -> list[Column]:
    return [F.coalesce(F.col("doc_id").cast("string"), F.lit("")).alias("_id"), F.xxhash64("text").alias("_text")]


def matches(docs: DataFrame, items: DataFrame, broadcast_rows: int = BROADCAST_ROWS) -> DataFrame:
    """_id, _text (a document's key), item_id and containment of every contained item."""
    sets = written(item_sets(items))
    index = sets.select(F.explode("sketch").alias("hash"), "range_top").groupBy("hash").agg(F.min("range_top").alias("range_top"))
    docs = docs.select("doc_id", "text").filter(F.col("text").isNotNull())
    looked_up = docs.select(*_keys(docs), shingles(F.col("text")).alias("s")).select("_id", "_text", F.size("s").alias("n"), F.explode("s").alias("hash"))
    hits = looked_up.join(_maybe_broadcast(index, broadcast_rows), "hash").filter(F.col("n") >= F.floor(F.col("range_top") / 2) * 4 / 5)
    by_hash = sets.select(F.explode("sketch").alias("hash"), "class", "needs", "common")
    pairs = hits.join(_maybe_broadcast(by_hash, broadcast_rows), "hash").filter(F.col("n") >= F.col("needs"))
    met = pairs.select("_id", "_text", "hash", "class", "common").distinct().groupBy("_id", "_text", "class").agg(F.count(F.lit(1)).alias("found"), F.first("common").alias("common"))
    candidates = written(met.filter("found >= common").select("_id", "_text", "class"))
    found = candidates.select("_id", "_text").distinct()
    near = docs.select("*", *_keys(docs)).join(found, ["_id", "_text"], "left_semi").dropDuplicates(["_id", "_text"])
    near = near.select("_id", "_text", shingles(F.col("text")).alias("doc_set"))
    known = sets.select("class", "item_ids", "item_set", "item_size")
    verified = candidates.join(_maybe_broadcast(known, broadcast_rows // 64), "class").join(near, ["_id", "_text"])
    both = F.size(F.array_intersect("item_set", "doc_set"))
    rows = verified.select("_id", "_text", "item_ids", both.alias("both"), "item_size").filter("5 * both >= 4 * item_size")
    return rows.select("_id", "_text", F.explode("item_ids").alias("item_id"), (F.col("both") / F.col("item_size")).alias("containment"))


def decontaminate(docs: DataFrame, items: DataFrame) -> DataFrame:
    """docs with contaminated, n_items, item_ids (ascending) and the largest containment (null if none), in place of columns of these names."""
    docs = docs.drop("contaminated", "n_items", "item_ids", "containment")
    found = matches(docs, items).groupBy("_id", "_text").agg(
        F.count(F.lit(1)).alias("n_items"), F.array_sort(F.collect_list("item_id")).alias("item_ids"), F.max("containment").alias("containment")
    )
    rows = docs.select("*", *_keys(docs)).join(found, ["_id", "_text"], "left")
    return rows.select(
        *docs.columns,
        F.col("n_items").isNotNull().alias("contaminated"),
        F.coalesce("n_items", F.lit(0)).cast("bigint").alias("n_items"),
        F.coalesce("item_ids", F.array().cast(found.schema["item_ids"].dataType)).alias("item_ids"),
        "containment",
    )


def clean(docs: DataFrame, items: DataFrame) -> DataFrame:
    """The documents that contain no item, all columns."""
    found = matches(docs, items).select("_id", "_text").distinct()
    return docs.select("*", *_keys(docs)).join(found, ["_id", "_text"], "left_anti").select(*docs.columns)
