"""Jaccard join over word shingles with token-combination prefixes.

A document's tokens are its distinct five-word shingles; two documents link when the Jaccard
similarity of their token sets is at least 0.8. The result is exact, and no group of near copies
is ever expanded into all its pairs.

1. Equal sets form one class, by two 64-bit fingerprints of the set: the second tells where the
   first is shared by different sets, which then get keys of their own.
2. A class in which more than a fifth of the tokens occur in no other class has no partner. That
   is decided on all tokens of short sets and on a fixed region of token hashes for long ones
   (only the region is counted, and only unshared tokens within it count against a class).
3. Of the classes that are left, tokens are counted and ordered, rare before frequent. A set of n
   tokens may lack n - ceil(0.8 n) of its partner's, so its prefix is one token longer than that.
   Rare tokens of the prefix are indexed singly. Frequent ones (in more than `FREQUENT` sets) are
   indexed by k at a time. Small sets (4 to 15 tokens) take k = 3 and a prefix two tokens longer:
   linked sets of that size share at least four tokens, so three at least in that prefix. Larger
   sets take k = 2, and their frequent tokens fall in M token classes, of which only pairs of one
   class are indexed; the prefix is extended by M tokens, one a class, which keeps the pigeonhole
   argument: whatever tokens are missing, two linked sets share a rare prefix token or two frequent
   ones of a class. M grows with the size band. Sets below 4 tokens link with their equals only.
4. Candidates come in rounds. First every index entry's members are compared with one leader (the
   member with fewest tokens of its own, later a random one), at most `LEADERS` a set; links are
   contracted to components. At last all pairs of an entry that still lie in different components
   and whose sizes, own tokens and parity sketches allow a link are verified. Pairs within a
   component can't change the result.

Tokens are 64-bit hashes of shingles; apart from their collisions (some 1e-9 for two documents of
ten thousand words) the result is exact.

Edge cases: a long text is one set of narrow rows and moves as one row; a null text or one without words has no token and links with nothing; fewer than five
words are one token; repeated rows and ids are each answered, equal texts share a component; a
null id never is the smallest one unless all are null; an empty table gives no rows; other
columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import fingerprint, shingles, written
from .graph import merged

#: Sets below this size are counted by all tokens, others by the region (of 1024 parts).
WHOLE, REGION = 128, 307
#: Up to so many classes, a bitmap of 16 bits a class (a broadcast table of at most a million rows) lets their texts through before texts move.
FILTER_CLASSES = 1 << 22
#: 64-bit words of a set's parity sketch.
SKETCH_WORDS = 8
FREQUENT = 32
#: Frequent tokens of sets below 16 tokens are indexed by so many at a time; sets below SMALLEST link with their equals only.
SMALL_K, SMALLEST = 3, 4
LEADERS = 3
ROUNDS = 2


def _in_region(token: Column) -> Column:
    return token.bitwiseAND(F.lit(1023)) < REGION


def _need(n: Column) -> Column:
    """The fewest tokens a set of n shares with a partner: ceil(0.8 n), in whole numbers."""
    return F.floor((n * 4 + 4) / 5).cast("int")


def _can_link(n1: Column, own1: Column, n2: Column, own2: Column, more: Column | int = 0) -> Column:
    """Whether sets of these sizes can reach the similarity: 9 * |difference| <= n1 + n2.

    own tokens, which no other set has, are in the difference, and so are `more`.
    """
    return 9 * (own1 + own2 + more) <= n1 + n2


def token_sets(docs: DataFrame) -> DataFrame:
    """doc_id, text hash, n, key and check (fingerprints of the set) and the tokens to be counted, of every row."""
    sets = docs.select("doc_id", F.xxhash64("text").alias("text_hash"), shingles(F.col("text")).alias("s"))
    n = F.size("s")
    listed = F.when(F.floor(n * 4 / 5) < WHOLE, F.col("s")).otherwise(F.filter("s", _in_region))
    return sets.select("doc_id", "text_hash", n.alias("n"), fingerprint(F.col("s")).alias("key"), fingerprint(F.transform("s", lambda t: F.xxhash64(t, F.lit(1)))).alias("check"), listed.alias("listed"))


def keyed_apart(rows: DataFrame) -> DataFrame:
    """rows with keys that differ wherever the sets do, by both fingerprints and the size."""
    mark = F.xxhash64("check", "n")
    shared = rows.groupBy("key").agg(F.min(mark).alias("lo"), F.max(mark).alias("hi")).filter("lo <> hi").select("key", F.lit(True).alias("clash"))
    if shared.isEmpty():
        return rows.drop("check")
    own = rows.join(shared, "key", "left").withColumn("key", F.when(F.col("clash"), F.xxhash64("key", "check", "n")).otherwise(F.col("key")))
    return written(own.drop("clash", "check"))


def survivors(rows: DataFrame) -> DataFrame:
    """key, n and one text_hash of each class that can have a partner."""
    tokens = rows.filter("n > 0").select("key", F.explode("listed").alias("token"))
    single = tokens.groupBy("token").agg(F.min("key").alias("key"), F.max("key").alias("other")).filter("key = other")
    own = single.groupBy("key").agg(F.count(F.lit(1)).alias("own"), F.count_if(_in_region(F.col("token"))).alias("own_region"))
    classes = rows.filter("n > 0").groupBy("key", "n").agg(F.min("text_hash").alias("text_hash"))
    unshared = F.coalesce(F.when(F.col("n") < WHOLE, F.col("own")).otherwise(F.col("own_region")), F.lit(0))
    return classes.join(own, "key", "left").filter(unshared <= F.col("n") - _need(F.col("n"))).select("key", "n", "text_hash")


def _likely(texts: DataFrame, kept: DataFrame, limit: int = FILTER_CLASSES) -> DataFrame:
    """texts without most of those whose text_hash isn't in kept, by a one-hash Bloom filter; all of texts where kept is too large for one."""
    n = kept.count()
    if n > limit:
        return texts
    words = max(1024, n // 4)
    slot = F.pmod("text_hash", F.lit(words * 64))
    bit = F.expr("shiftleft(1L, cast(pmod(text_hash, 64) as int))")
    bits = kept.groupBy(F.floor(slot / 64).alias("w")).agg(F.bit_or(bit).alias("bits"))
    met = texts.withColumn("w", F.floor(slot / 64)).join(F.broadcast(bits), "w")
    return met.filter(F.getbit("bits", F.pmod("text_hash", F.lit(64)).cast("int")) == 1).drop("w", "bits")


def sets_of(docs: DataFrame, kept: DataFrame) -> DataFrame:
    """key, n, s: the token sets of the classes in kept, from one text each."""
    texts = _likely(docs.select(F.xxhash64("text").alias("text_hash"), "text"), kept)
    single = texts.groupBy("text_hash").agg(F.first("text").alias("text"))
    return single.join(kept, "text_hash").select("key", "n", shingles(F.col("text")).alias("s"))


def _pairs(frequent: Column, scheme: Column, m: Column) -> Column:
    """Hashes of the pairs of frequent tokens of one token class."""
    return F.flatten(
        F.transform(
            frequent,
            lambda a, i: F.transform(
                F.filter(F.slice(frequent, i + 2, F.size(frequent)), lambda b: F.pmod(b, m) == F.pmod(a, m)), lambda b: F.xxhash64(scheme, a, b)
            ),
        )
    )


def _triples(frequent: Column) -> Column:
    """Hashes of all triples of a small set's frequent tokens."""
    rest = lambda i: F.slice(frequent, i + 2, F.size(frequent))
    return F.flatten(
        F.transform(
            frequent,
            lambda a, i: F.flatten(F.transform(rest(i), lambda b, j: F.transform(F.slice(frequent, i + j + 3, F.size(frequent)), lambda c: F.xxhash64(F.lit(1), a, b, c)))),
        )
    )


def shared_tokens(sets: DataFrame, frequent: int = FREQUENT) -> DataFrame:
    """For each set that can have a partner: own (tokens no other set has), m (prefix tokens after those), bands, l and sketch.

    l has the other tokens by count and hash, as far as a prefix reaches. The sketch is the parity
    of those tokens in 512 cells: two sketches differ in at most as many cells as the sets in tokens.
    """
    tokens = sets.select("key", "n", F.explode("s").alias("token"))
    counts = tokens.groupBy("token").agg(F.count(F.lit(1)).cast("int").alias("f")).filter("f > 1")
    cell = F.expr("shiftleft(1L, cast(pmod(shiftright(token, 8), 64) as int))")
    words = [F.coalesce(F.bit_xor(F.when(F.pmod("token", F.lit(SKETCH_WORDS)) == w, cell)), F.lit(0).cast("bigint")) for w in range(SKETCH_WORDS)]
    ordered = tokens.join(counts, "token").groupBy("key", "n").agg(
        F.array_sort(F.collect_list(F.struct("f", "token"))).alias("l"), *[w.alias(f"k{i}") for i, w in enumerate(words)]
    )
    rows = ordered.withColumn("own", F.col("n") - F.size("l")).withColumn("m", F.col("n") - _need(F.col("n")) + 1 - F.col("own")).filter("m > 0")
    rows = rows.withColumn("band", F.floor(F.log2(F.col("n").cast("double")) / 2).cast("int"))
    return rows.withColumn("l", F.slice("l", F.lit(1), F.col("m") + F.greatest(F.lit(SMALL_K - 1), _classes(F.col("band"))))).withColumn("crowded", F.exists(F.slice("l", F.lit(1), F.col("m")), lambda t: t["f"] > frequent))


def _classes(band: Column) -> Column:
    """Token classes of a size band: an eighth of its smallest size."""
    return F.floor(F.pow(F.lit(4.0), band) / 8).cast("int")


def index(rows: DataFrame, frequent: int = FREQUENT) -> DataFrame:
    """sig, key, n, own: the index entries of `shared_tokens`."""
    rows = rows.filter(F.col("n") >= SMALLEST)
    below = F.floor(F.col("n") * 4 / 5) < F.pow(F.lit(4.0), F.col("band"))
    schemes = F.when(below & (F.col("band") > 1), F.array(F.col("band"), F.col("band") - 1)).otherwise(F.array("band"))
    rows = rows.withColumn("schemes", schemes).withColumn("prefix", F.slice("l", F.lit(1), F.col("m")))
    rare = F.transform(F.filter("prefix", lambda t: t["f"] <= frequent), lambda t: F.xxhash64(t["token"]))

    def frequent_of(reach: Column) -> Column:
        return F.transform(F.filter(F.slice("l", F.lit(1), F.col("m") + reach), lambda t: t["f"] > frequent), lambda t: t["token"])

    def scheme_entries(c: Column) -> Column:
        return F.when(c == 1, _triples(frequent_of(F.lit(SMALL_K - 1)))).otherwise(_pairs(frequent_of(_classes(c)), c, _classes(c)))

    crowded = F.when(F.col("crowded"), F.flatten(F.transform("schemes", scheme_entries))).otherwise(F.array().cast("array<bigint>"))
    entries = rows.select(F.explode(F.array_distinct(F.concat(rare, crowded))).alias("sig"), "key", "n", "own")
    lively = entries.groupBy("sig").agg(F.count(F.lit(1)).alias("c")).filter("c > 1")
    return entries.join(lively.select("sig"), "sig")


def verified(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """The pairs (a, b) whose sets reach the similarity, as edges u, v."""
    left, right = (sets.select(F.col("key").alias(k), F.col("n").alias(f"n_{k}"), F.col("s").alias(f"s_{k}")) for k in "ab")
    both = pairs.join(left, "a").join(right, "b").select("a", "b", "n_a", "n_b", F.size(F.array_intersect("s_a", "s_b")).alias("c"))
    return both.filter("100 * c >= 80 * (n_a + n_b - c)").select(F.col("a").alias("u"), F.col("b").alias("v"))


def _ordered(a: str, b: str) -> list[Column]:
    return [F.least(a, b).alias("a"), F.greatest(a, b).alias("b")]


def _leader_pairs(entries: DataFrame, number: int) -> DataFrame:
    """Pairs of an entry's leader with members of other components; at most LEADERS for a member."""
    rank = F.col("own") if number == 0 else F.lit(0)
    leads = entries.groupBy("sig").agg(
        F.min(F.struct(rank.alias("r"), F.xxhash64("key", "sig", F.lit(number)).alias("h"), "key", "n", "own", "root")).alias("lead"),
        F.min("root").alias("lo"), F.max("root").alias("hi"),
    ).filter("lo <> hi")
    met = entries.join(leads.select("sig", "lead"), "sig").filter(
        (F.col("root") != F.col("lead.root")) & _can_link(F.col("n"), F.col("own"), F.col("lead.n"), F.col("lead.own"))
    )
    few = met.groupBy("key").agg(F.slice(F.array_sort(F.collect_set(F.struct("lead.r", "lead.h", F.col("lead.key").alias("other")))), 1, LEADERS).alias("l"))
    return few.select("key", F.explode("l.other").alias("other")).select(*_ordered("key", "other")).distinct()


def _other_pairs(entries: DataFrame, sketches: DataFrame) -> DataFrame:
    """All pairs of an entry that lie in different components and can link by their sketches; one of each is outside the entry's largest component."""
    parts = entries.groupBy("sig", "root").agg(F.count(F.lit(1)).alias("c"))
    largest = parts.groupBy("sig").agg(F.max(F.struct("c", "root")).alias("top"), F.count(F.lit(1)).alias("roots")).filter("roots > 1")
    words = [f"k{i}" for i in range(SKETCH_WORDS)]
    rows = entries.join(largest.select("sig", F.col("top.root").alias("top")), "sig").join(sketches.select("key", *words), "key")
    columns = ("key", "n", "own", "root", "top", *words)
    x, y = (rows.select("sig", *[F.col(c).alias(f"{side}_{c}") for c in columns]) for side in "xy")
    x = x.filter("x_root <> x_top")
    once = (F.col("x_root") < F.col("y_root")) | (F.col("y_root") == F.col("x_top"))
    differ = sum((F.bit_count(F.col(f"x_{w}").bitwiseXOR(F.col(f"y_{w}"))) for w in words), F.lit(0))
    near = _can_link(F.col("x_n"), F.col("x_own"), F.col("y_n"), F.col("y_own"), differ)
    return x.join(y, (x["sig"] == y["sig"]) & (F.col("x_root") != F.col("y_root")) & once & near).select(*_ordered("x_key", "y_key")).distinct()


def linked(docs: DataFrame, rounds: int = ROUNDS) -> tuple[DataFrame, DataFrame]:
    """(rows, roots): a row a document with text_hash, n and key; and key, root of the classes that have a link."""
    docs = docs.select("doc_id", "text")
    rows = keyed_apart(written(token_sets(docs)))
    kept = written(survivors(rows))
    sets = written(sets_of(docs, kept))
    sketches = written(shared_tokens(sets))
    entries = written(index(sketches))
    roots = None
    for number in range(rounds + 1):
        placed = entries.withColumn("root", F.col("key"))
        if roots is not None:
            placed = entries.join(roots.withColumnRenamed("node", "key"), "key", "left").withColumn("root", F.coalesce("root", "key"))
        pairs = _leader_pairs(placed, number) if number < rounds else _other_pairs(placed, sketches)
        pairs = written(pairs)
        if roots is None or not pairs.isEmpty():
            roots = merged(roots, written(verified(pairs, sets)))
    return rows.drop("listed"), roots.withColumnRenamed("node", "key")


def join(docs: DataFrame) -> DataFrame:
    """doc_id, text_hash, n_shingles, component_id (the smallest doc_id reachable by links) and group (its own number, null without words) of every row."""
    rows, roots = linked(docs)
    classes = rows.filter("n > 0").groupBy("key").agg(F.min("doc_id").alias("least"))
    shared = classes.join(roots, "key")
    least = shared.groupBy("root").agg(F.min("least").alias("component_id"))
    by_key = classes.join(roots, "key", "left").join(least, "root", "left").select("key", F.coalesce("component_id", "least").alias("component_id"), F.coalesce("root", "key").alias("group"))
    return rows.join(by_key, "key", "left").select(
        "doc_id", "text_hash", F.col("n").cast("bigint").alias("n_shingles"), F.when(F.col("n") > 0, F.col("component_id")).otherwise(F.col("doc_id")).alias("component_id"),
        F.when(F.col("n") > 0, F.col("group")).alias("group"),
    )


def deduplicated(docs: DataFrame) -> DataFrame:
    """docs with one document of each group of linked or equal ones, the one of the smallest id; those without words all stay.

    Texts move once, to meet the rows that stay. Only where a row is there twice in full, which the narrow rows tell, they move again to lose the repeats.
    """
    answer = written(join(docs))
    least = answer.filter("n_shingles > 0").groupBy("group").agg(F.min(F.struct(F.col("doc_id").isNull().alias("unnamed"), "doc_id", "text_hash")).alias("k"))
    keep = least.select(F.col("k.doc_id").alias("_id"), F.col("k.text_hash").alias("_hash"))
    repeats = answer.filter("n_shingles > 0").groupBy("doc_id", "text_hash").agg(F.count(F.lit(1)).alias("c")).filter("c > 1")
    rows = docs.withColumn("_hash", F.xxhash64("text"))
    texts = rows.join(keep, rows["doc_id"].eqNullSafe(keep["_id"]) & (rows["_hash"] == keep["_hash"]), "left_semi")
    if not repeats.isEmpty():
        texts = texts.dropDuplicates(["doc_id", "_hash"])
    wordless = rows.filter(F.coalesce(~F.col("text").rlike(r"[^\x20\x09-\x0D]"), F.lit(True)))
    return texts.unionByName(wordless).select(*docs.columns)
