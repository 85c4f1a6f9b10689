"""Shared column expressions and the scratch area in the cluster's checkpoint folder."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: ASCII white space, as a character class body.
SPACE = r"\x20\x09-\x0D"
WORD = rf"[^{SPACE}]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
SHINGLE = 5


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def scratch_dir(spark: SparkSession) -> str:
    """A fresh folder below spark.checkpoint.dir, which driver and executors share.

    Where that setting is absent, a local master (tests) gets a temporary folder; on a cluster,
    where executors would write to disks of their own, that is an error.
    """
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.conf.get("spark.master", "").startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        base = tempfile.mkdtemp(prefix="tracemill-")
        spark.conf.set("spark.checkpoint.dir", base)
    return f"{base.rstrip('/')}/tracemill-{uuid.uuid4().hex}"


def sampled_ids(rows: DataFrame, group: str, per_group: int) -> list[tuple]:
    """(group, doc_id) of at most per_group distinct ids a group, those of the lowest id hashes.

    A hash threshold fitted to each group's number of ids leaves about twice as many candidates as
    are wanted, so no task and not the driver sees more than that, whatever a group holds.
    """
    counts = rows.groupBy(group).agg(F.approx_count_distinct("doc_id").alias("_ids"))
    place = F.pmod(F.xxhash64("doc_id"), F.lit(1 << 40)) / float(1 << 40)
    few = rows.select(group, "doc_id").join(F.broadcast(counts), group).filter(place * F.col("_ids") < 2 * per_group + 50)  # a row a group
    found = sorted((r[0], r["place"], r["doc_id"]) for r in few.groupBy(group, "doc_id").agg(F.first(place).alias("place")).collect())
    out, now = [], {}
    for g, _, i in found:
        now[g] = now.get(g, 0) + 1
        if now[g] <= per_group:
            out.append((g, i))
    return out


def written(df: DataFrame, options: dict[str, str] | None = None) -> DataFrame:
    """df as a Parquet table in the scratch area: its lineage ends there, and a lost executor costs no recomputation. Options are Parquet's."""
    path = scratch_dir(df.sparkSession)
    df.write.options(**(options or {})).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def ascii_lower(text: Column) -> Column:
    """A-Z to lower case, other letters as they are; lower() does that quickly where every character is ASCII."""
    return F.when(F.octet_length(text) == F.length(text), F.lower(text)).otherwise(F.translate(text, UPPER, LOWER))


def words(text: Column) -> Column:
    """The ASCII-white-space separated words of text; an empty array for null."""
    return F.filter(F.split(F.coalesce(text, F.lit("")), f"[{SPACE}]+"), lambda w: w != F.lit(""))


def shingles(text: Column, size: int = SHINGLE) -> Column:
    """Distinct 64-bit hashes of the lower-cased `size`-word shingles of text.

    Fewer words make one shingle of the whole sequence; none make an empty array.
    """
    ws = words(ascii_lower(text))
    return F.transform(
        F.array(ws),
        lambda w: F.array_distinct(
            F.when(F.size(w) == 0, F.array().cast("array<bigint>"))
            .when(F.size(w) < size, F.array(F.xxhash64(w)))
            .otherwise(
                F.transform(
                    F.sequence(F.lit(0), F.size(w) - size),
                    lambda i: F.xxhash64(*[F.get(w, i + k) for k in range(size)]),
                )
            )
        ),
    )[0]


def fingerprint(hashes: Column) -> Column:
    """An order-free 64-bit fingerprint of an array of distinct hashes."""
    return F.aggregate(hashes, F.lit(0).cast("bigint"), lambda acc, x: acc.bitwiseXOR(F.xxhash64(x)))
