"""Near-duplicate groups by one-permutation MinHash.

A document's set has its distinct lower-cased four-word shingles; two documents link when the
Jaccard similarity of their sets is at least 0.8, which is confirmed on the full sets.

1. One hash of every shingle both deals it to one of 128 bins and orders it there; a bin's least
   hash is its value. An empty bin borrows the value of the first filled bin in a random order of
   its own (optimal densification), so that two sets agree in a bin with the probability of their
   similarity, however small they are.
2. Bins are banded by four: two sets that are 0.8 alike share none of the 32 buckets with a
   probability of 0.59^32, some 5e-8.
3. Equal sets are one class, by two fingerprints. Classes of a bucket meet as a star: each with the
   bucket's leader only. Links are contracted to components; a leader, which all others have met,
   leaves its buckets, and a bucket whose classes are all in one component is done. After
   `STARS` rounds the pairs of different components that are left in a bucket are verified, as far
   as sizes and parity sketches let them link; pairs within a component can't change the result.

Shingles are 64-bit hashes (a linear sum of the hashes of their words, mixed), so what is said of
full sets holds up to their collisions, some 1e-9 for two documents of ten thousand words.

Edge cases: a null text or one without words has no shingle and links with nothing; fewer than
four words are one shingle; sets below four shingles link with their equals only, since 3 / 4 is
below 0.8; repeated rows and ids are each answered and equal texts share a component; a null id is
the smallest one only where all are null, and is kept only there or where it is alone without
words; a long text is one set, whole; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, IntegerType, LongType, StructType

from .common import written
from .graph import merged
from .ngram_join import SKETCH_WORDS, _likely, keyed_apart, verified

SIZE = 4
BINS, ROWS = 128, 4
BANDS = BINS // ROWS
#: Sets below this size can only reach the similarity with their equals.
SMALLEST = 4
STARS = 3
#: Words that a worker remembers the hashes of.
REMEMBERED = 400_000

_BIN_SHIFT = np.uint64(64 - BINS.bit_length() + 1)
_random = np.random.Generator(np.random.PCG64(20_011))
#: Row i: the order in which bin i, if empty, asks the other bins.
BORROW = np.argsort(_random.random((BINS, BINS)), axis=1)
FACTORS = _random.integers(1 << 62, 1 << 63, SIZE, dtype=np.uint64) | np.uint64(1)
BAND_FACTORS = _random.integers(1 << 62, 1 << 63, ROWS, dtype=np.uint64) | np.uint64(1)
BAND_SEEDS = _random.integers(1, 1 << 63, BANDS, dtype=np.uint64)


def _mixed(x: np.ndarray) -> np.ndarray:
    """A bijective scrambling of 64-bit numbers: two xor-shift-multiply steps."""
    x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    return x ^ (x >> np.uint64(32))


class _Words(dict):
    """Hashes of words, each computed once as long as it is remembered."""

    def __missing__(self, word: bytes) -> int:
        import xxhash

        self[word] = h = xxhash.xxh64_intdigest(word)
        return h


_words = _Words()


def shingle_hashes(text: bytes | None) -> np.ndarray:
    """Sorted distinct 64-bit hashes of a text's shingles."""
    words = (text or b"").lower().split()  # of bytes: A-Z, and ASCII white space
    if not words:
        return np.empty(0, np.uint64)
    if len(_words) > REMEMBERED:
        _words.clear()
    h = np.fromiter(map(_words.__getitem__, words), np.uint64, len(words))
    if len(words) < SIZE:
        return _mixed(np.array([np.sum(h * FACTORS[: len(h)], dtype=np.uint64) + np.uint64(len(h))], np.uint64))
    n = len(h) - SIZE + 1
    return np.unique(_mixed(sum((h[k : k + n] * FACTORS[k] for k in range(1, SIZE)), h[:n] * FACTORS[0])))


def signature(hashes: np.ndarray) -> np.ndarray:
    """The value of every bin, empty ones densified; hashes are sorted and not empty."""
    bins = (hashes >> _BIN_SHIFT).astype(np.int64)
    first = np.flatnonzero(np.diff(bins, prepend=-1))
    filled, values = np.zeros(BINS, bool), np.zeros(BINS, np.uint64)
    filled[bins[first]] = True
    values[bins[first]] = hashes[first]
    empty = np.flatnonzero(~filled)
    if len(empty):
        order = BORROW[empty]
        values[empty] = values[order[np.arange(len(empty)), filled[order].argmax(axis=1)]]
    return values


def buckets(hashes: np.ndarray) -> np.ndarray:
    """One hash a band."""
    return _mixed((signature(hashes).reshape(BANDS, ROWS) * BAND_FACTORS).sum(axis=1, dtype=np.uint64) + BAND_SEEDS)


def parity(hashes: np.ndarray) -> np.ndarray:
    """The parity of the set in 512 cells: two of them differ in at most as many cells as the sets in shingles."""
    cells = np.bincount((hashes & np.uint64(64 * SKETCH_WORDS - 1)).astype(np.int64), minlength=64 * SKETCH_WORDS) & 1
    return np.packbits(cells.astype(np.uint8)).view(np.uint64)


def _lists(parts: list[np.ndarray]) -> pa.Array:
    ends = np.cumsum([0, *map(len, parts)], dtype=np.int32)
    return pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate([np.empty(0, np.uint64), *parts]).view(np.int64)))


NUMBERS = ArrayType(LongType(), False)


@F.arrow_udf(StructType().add("n", IntegerType()).add("key", LongType()).add("check", LongType()).add("sigs", NUMBERS).add("sketch", NUMBERS))
def _described(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
    none = np.empty(0, np.uint64)
    for texts in batches:
        sizes, keys, checks, sigs, sketches = [], [], [], [], []
        for text in texts:
            s = shingle_hashes(text.as_py())
            large = len(s) >= SMALLEST
            sizes.append(len(s))
            keys.append(np.bitwise_xor.reduce(_mixed(s + np.uint64(1))))
            checks.append(np.bitwise_xor.reduce(_mixed(s ^ FACTORS[0])))
            sigs.append(buckets(s) if large else none)
            sketches.append(parity(s) if large else none)
        whole = lambda numbers: pa.array(np.array(numbers, np.uint64).view(np.int64))
        yield pa.StructArray.from_arrays([pa.array(sizes, pa.int32()), whole(keys), whole(checks), _lists(sigs), _lists(sketches)], ["n", "key", "check", "sigs", "sketch"])


@F.arrow_udf(NUMBERS)
def _full_set(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
    for texts in batches:
        yield _lists([shingle_hashes(t.as_py()) for t in texts])


def described(docs: DataFrame) -> DataFrame:
    """doc_id, text_hash, n, key, check, sigs and sketch of every row."""
    rows = docs.select("doc_id", F.xxhash64("text").alias("text_hash"), _described(F.col("text").cast("binary")).alias("d"))
    return rows.select("doc_id", "text_hash", "d.*")


def _alike(n1: str, n2: str) -> str:
    """The sizes of two sets that can reach the similarity."""
    return f"5 * least({n1}, {n2}) >= 4 * greatest({n1}, {n2})"


def _star(entries: DataFrame, number: int) -> tuple[DataFrame, DataFrame]:
    """(pairs, left): pairs a, b of each bucket's leader with its members of other components; and the entries without leaders and finished buckets.

    In the first round a class has the same rank in all its buckets, so that a group of near copies
    has few leaders; later ranks differ from bucket to bucket.
    """
    rank = F.xxhash64("key") if number == 0 else F.xxhash64("key", "sig", F.lit(number))
    leads = entries.groupBy("sig").agg(F.min(F.struct(rank.alias("h"), "key", "n", "root")).alias("lead"), F.min("root").alias("lo"), F.max("root").alias("hi"))
    met = entries.join(leads.filter("lo <> hi").select("sig", "lead"), "sig").filter(F.col("key") != F.col("lead.key"))
    pairs = met.filter(F.expr("root <> lead.root AND " + _alike("n", "lead.n")))
    return pairs.select(F.least("key", "lead.key").alias("a"), F.greatest("key", "lead.key").alias("b")).distinct(), met.select("sig", "key", "n")


def _rest(entries: DataFrame, sketches: DataFrame) -> DataFrame:
    """Pairs a, b of a bucket in different components, as far as sizes and sketches let them link."""
    rows = entries.join(sketches, "key")
    x, y = (rows.select("sig", *[F.col(c).alias(f"{side}_{c}") for c in ("key", "n", "root", "sketch")]) for side in "xy")
    differ = sum((F.bit_count(F.get("x_sketch", F.lit(w)).bitwiseXOR(F.get("y_sketch", F.lit(w)))) for w in range(SKETCH_WORDS)), F.lit(0))
    near = F.expr("x_key < y_key AND x_root <> y_root AND " + _alike("x_n", "y_n")) & (9 * differ <= F.col("x_n") + F.col("y_n"))
    return x.join(y, (x["sig"] == y["sig"]) & near).select(F.col("x_key").alias("a"), F.col("y_key").alias("b")).distinct()


def _sets(docs: DataFrame, kept: DataFrame) -> DataFrame:
    """key, n, s: the full sets of the classes in kept, from one text each."""
    texts = _likely(docs.select(F.xxhash64("text").alias("text_hash"), "text"), kept).groupBy("text_hash").agg(F.first("text").alias("text"))
    return texts.join(kept, "text_hash").select("key", "n", _full_set(F.col("text").cast("binary")).alias("s"))


def _placed(entries: DataFrame, roots: DataFrame | None) -> DataFrame:
    if roots is None:
        return entries.withColumn("root", F.col("key"))
    return entries.join(roots.withColumnRenamed("node", "key"), "key", "left").withColumn("root", F.coalesce("root", "key"))


def linked(docs: DataFrame, stars: int = STARS) -> tuple[DataFrame, DataFrame]:
    """(rows, roots): a row a document with text_hash, n and key; and key, root of the classes that have a link."""
    docs = docs.select("doc_id", "text")
    rows = keyed_apart(written(described(docs)))
    classes = rows.filter(F.size("sigs") > 0).groupBy("key", "n").agg(F.min("text_hash").alias("text_hash"), F.first("sigs").alias("sigs"), F.first("sketch").alias("sketch"))
    classes = written(classes)
    spread = classes.select("key", "n", F.posexplode("sigs").alias("band", "h")).select(F.xxhash64("band", "h").alias("sig"), "key", "n")
    lively = spread.groupBy("sig").agg(F.count(F.lit(1)).alias("c")).filter("c > 1")
    entries = written(spread.join(lively.select("sig"), "sig"))
    sets = written(_sets(docs, classes.join(entries.select("key").distinct(), "key", "left_semi").select("key", "n", "text_hash")))
    roots = None
    for number in range(stars + 1):
        placed = _placed(entries, roots)
        if number < stars:
            pairs, entries = _star(placed, number)
            entries = written(entries)
        else:
            pairs = _rest(placed, classes.select("key", "sketch"))
        pairs = written(pairs)
        if roots is None or not pairs.isEmpty():
            roots = merged(roots, written(verified(pairs, sets)))
        if entries.isEmpty():
            break
    return rows.select("doc_id", "text_hash", "n", "key"), roots.withColumnRenamed("node", "key")


def near_duplicates(docs: DataFrame, stars: int = STARS) -> DataFrame:
    """doc_id, n_shingles, component_id (the smallest doc_id reachable by links, itself included) and kept of every row."""
    rows, roots = linked(docs, stars)
    classes = rows.filter("n > 0").groupBy("key").agg(F.min("doc_id").alias("own")).join(roots, "key", "left").withColumn("root", F.coalesce("root", "key"))
    least = classes.groupBy("root").agg(F.min("own").alias("component_id"))
    by_key = classes.join(least, "root").select("key", "component_id")
    answer = rows.join(by_key, "key", "left").withColumn("component_id", F.when(F.col("n") > 0, F.col("component_id")).otherwise(F.col("doc_id")))
    return answer.select("doc_id", F.col("n").cast("bigint").alias("n_shingles"), "component_id", F.col("doc_id").eqNullSafe(F.col("component_id")).alias("kept"))
