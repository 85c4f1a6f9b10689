"""Sharding by histogram sort.

Every document gets a 64-bit key: 32 bits of its text's hash, then 32 bits of its id's hash, so
that equal texts lie together and yet a large group of copies can be cut. Splitters between the
shards come from repeated exact counts of bytes below candidate boundaries: each round counts
the cells of a grid of probes and refines only the cells that hold a splitter, until a boundary
is within tolerance or the key has no more bits. Then one exchange places the rows.

Edge cases: a null text counts 8 bytes and crc32 0, as an empty one; a null id has the hash of
nothing; rows of one key (repeated rows) are never cut by a splitter and take slots in any order
among themselves; a text larger than a shard's share makes that shard larger; an empty table
gives no rows; other columns are ignored by the digest and kept by `dealt` and `write_shards`.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import written

PROBE_BITS = 10
OVERHEAD = 8
DIGEST = ("size", "text_crc32", "law", "shard", "slot", "grown_shard")


def _columns(id_col: str, text_col: str) -> list[Column]:
    """size, text_crc32 and key of a row."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    high = F.shiftleft(F.shiftright(F.xxhash64(text), 32), 32)
    low = F.shiftrightunsigned(F.xxhash64(F.col(id_col)), 32)
    return [
        (F.octet_length(text) + OVERHEAD).cast("bigint").alias("size"),
        F.crc32(text.cast("binary")).alias("text_crc32"),
        high.bitwiseOR(low).alias("key"),
    ]


def splitters(keyed: DataFrame, n_shards: int, tolerance: float = 0.001, probe_bits: int = PROBE_BITS) -> list[int]:
    """n_shards - 1 ascending keys; shard i holds the keys from splitter i-1 up to, not including, splitter i.

    A round collects at most (n_shards - 1) * 2**probe_bits counts, whatever the table's size.
    """
    found: dict[int, int] = {}
    shift, total, slack = 64, 0, 0.0
    open_cells: dict[int | None, tuple[int, list[int]]] = {None: (0, list(range(1, n_shards)))}
    while open_cells and shift > 0:
        wider, shift = shift, max(0, shift - probe_bits)
        rows = keyed
        if None not in open_cells:
            rows = rows.filter(F.shiftright("key", wider).isin(sorted(open_cells)))
        parent = F.shiftright("key", wider) if wider < 64 else F.lit(None).cast("bigint")
        counts = rows.groupBy(parent.alias("parent"), F.shiftright("key", shift).alias("cell")).agg(F.sum("size").alias("bytes"))
        by_parent: dict[int | None, list[tuple[int, int]]] = {}
        for r in counts.collect():
            by_parent.setdefault(r["parent"], []).append((r["cell"], r["bytes"]))
        if None in open_cells:
            total = sum(b for _, b in by_parent.get(None, []))
            slack = tolerance * total / n_shards
        refine: dict[int | None, tuple[int, list[int]]] = {}
        for parent_cell, (below, wanted) in open_cells.items():
            for cell, size in sorted(by_parent.get(parent_cell, [])):
                held = [i for i in wanted if below <= total * i / n_shards < below + size]
                for i in held:
                    before, after = total * i / n_shards - below, below + size - total * i / n_shards
                    if min(before, after) <= slack or shift == 0:
                        found[i] = (cell + (after < before)) << shift
                    else:
                        refine.setdefault(cell, (below, []))[1].append(i)
                below += size
        open_cells = refine
    return [found[i] for i in range(1, n_shards) if i in found]


def _plan(keyed: DataFrame, n_shards: int, rows_per_group: int) -> tuple[Column, Column, DataFrame]:
    """Shard and group of a key as expressions, and each group's offset in its shard."""
    cuts = splitters(keyed, n_shards)
    groups = max(8, -(-keyed.count() // (n_shards * rows_per_group)))
    number = sum((F.when(F.col("key") >= F.lit(c), 1).otherwise(0) for c in cuts), F.lit(0)).cast("int").alias("shard")
    part = F.pmod(F.xxhash64("key"), F.lit(groups)).cast("int").alias("part")
    counts = keyed.select(number, part).groupBy("shard", "part").agg(F.count(F.lit(1)).alias("n"))
    before = Window.partitionBy("shard").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    return number, part, counts.select("shard", "part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("offset"))


def _slots(placed: DataFrame, offsets: DataFrame) -> DataFrame:
    """placed with its slot; rows move once, to their shard and group."""
    within = Window.partitionBy("shard", "part").orderBy("key", "doc_id")
    return placed.join(offsets, ["shard", "part"]).withColumn("slot", (F.col("offset") + F.row_number().over(within) - 1).cast("bigint"))


def shard(docs: DataFrame, n_shards: int = 24, id_col: str = "doc_id", text_col: str = "text", rows_per_group: int = 100_000) -> DataFrame:
    """doc_id, size, text_crc32, shard and slot of every row; byte sizes of shards near equal, slots gapless from 0.

    Slots are dealt in groups of about rows_per_group rows of a shard, each with its offset, so no task holds a shard.
    """
    keyed = written(docs.select(F.col(id_col).alias("doc_id"), *_columns(id_col, text_col)))
    number, part, offsets = _plan(keyed, n_shards, rows_per_group)
    return _slots(keyed.select("*", number, part), offsets).select("doc_id", "size", "text_crc32", "shard", "slot")


def dealt(docs: DataFrame, n_shards: int = 24, rows_per_group: int = 20_000) -> DataFrame:
    """docs themselves with the digest's columns, in place of columns of these names.

    Splitters come from narrow keys. A row's shard then follows from its own key, so the texts
    need no join and go through one exchange, to the group that gives them their slot.
    """
    keyed = written(docs.select("doc_id", *_columns("doc_id", "text")))
    number, part, offsets = _plan(keyed, n_shards, rows_per_group)
    whole = docs.select("doc_id", F.struct(*docs.columns).alias("_row"), *_columns("doc_id", "text"))  # in a struct, no column of docs can clash
    rows = _slots(whole.select("*", number, part), offsets)
    own = [F.col(f"_row.`{c}`") for c in docs.columns if c not in DIGEST]
    return rows.select(*own, "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


def write_shards(docs: DataFrame, path: str, n_shards: int = 24) -> None:
    """The documents as Parquet, one folder a shard; a column named shard is replaced, others stay as they are."""
    rows = dealt(docs.select(F.struct(*docs.columns).alias("_own"), "doc_id", "text"), n_shards)
    kept = [F.col(f"_own.`{c}`") for c in docs.columns if c != "shard"]
    rows.select(*kept, "shard").write.partitionBy("shard").parquet(path)


def sharded(docs: DataFrame) -> DataFrame:
    """The digest of `shard` with 24 shards under the law `bytes`."""
    return shard(docs).select(
        "doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard")
    )
