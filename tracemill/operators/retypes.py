"""Openers typed again: clusters of near-duplicate openings of one project within some days of each other.

Two sessions link if their openers' sets of word pairs are at least half alike (Jaccard) and they began
within the window. Equal sets are one class. Classes meet in blocks of two neighbouring windows, each of which
has all pairs that begin in its first one: there a class of which more than half occurs in no other class has
no partner, the others meet by the rare part of their word pairs, rare within the block, and are verified on
whole sets. Within a class, and for each pair of
linked classes, sessions are put in the order of time: neighbours within the window connect all that the
window connects, so a group of n copies gives n - 1 edges; how many sessions each one links to is counted
by two running positions, never by listing pairs.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import materialized
from .graph import components
from .sequences import asof

#: Parts of a block's word pairs that are looked at apart, and how many word pairs a task looks at.
PARTS, A_TASK = 8, 1 << 22
#: The window, the floor, what is too short to compare, and words that carry no task.
WINDOW_US, FLOOR = 7 * 24 * 3600 * 1_000_000, 0.5
MIN_CHARS, MIN_TOKENS = 40, 6
STOP_WORDS = (
    "the", "and", "for", "you", "your", "please", "can", "this", "that", "with", "from", "into", "are", "was", "were", "have", "has", "had", "but", "not",
    "all", "any", "our", "out", "get", "now", "then", "them", "they", "its", "let", "add", "use", "need", "want", "also", "still", "just", "some", "more",
)


def content_words(text: Column) -> Column:
    """The words of an opener that tell its task: no paths, numbers, single letters or filler."""
    low = F.lower(text)
    bare = F.when(F.contains(low, F.lit("/")), F.regexp_replace(F.regexp_replace(low, "`+", " "), r"\S*/\S*", " ")).otherwise(low)
    return F.filter(F.split(bare, "[^a-z]+"), lambda w: (F.length(w) >= 2) & ~w.isin(*STOP_WORDS))


def word_pairs(words: Column, salt: Column) -> Column:
    """Distinct hashes of neighbouring words; another salt (project) makes other hashes."""
    n = F.size(words) - 1
    return F.array_distinct(F.zip_with(F.slice(words, F.lit(1), n), F.slice(words, F.lit(2), n), lambda a, b: F.xxhash64(salt, a, b)))


def openers(sessions: DataFrame) -> DataFrame:
    """session_id, us, key (class of equal sets) and s of the sessions that can be compared.

    sessions: session_id, project, us, opener, one row each. Left out: commands (`/...`), openers that are too
    short, and rows without project or time.
    """
    said = F.trim("opener")
    usable = sessions.filter(F.col("project").isNotNull() & F.col("us").isNotNull() & (F.length(said) >= MIN_CHARS) & ~F.col("opener").rlike(r"^\s*/"))
    sets = F.transform(F.array(content_words(F.col("opener"))), lambda w: F.when(F.size(w) >= MIN_TOKENS, F.sort_array(word_pairs(w, F.col("project").cast("string")))))
    rows = usable.select("session_id", "us", F.explode(F.filter(sets, lambda s: s.isNotNull())).alias("s"))  # exploded, so that the words are computed once
    return rows.withColumn("key", F.concat_ws("-", F.xxhash64("s").cast("string"), F.xxhash64(F.lit(1), "s").cast("string")))  # two fingerprints tell sets apart


def _may_lack(n: Column, floor: float) -> Column:
    """How many word pairs of a set of n a partner may lack."""
    return F.floor(n * (1 - floor) + 1e-9).cast("int")


def _meeting(rows: DataFrame, window_us: int, floor: float) -> DataFrame:
    """rep (a class's smallest session), key, n, block: the classes that may have a partner in a block.

    Word pairs move as arrays of 32 bits; where two of them look alike, a class is kept that need not be.
    """
    week = F.floor(F.col("us") / window_us)
    placed = rows.select("session_id", "key", "s", F.explode(F.array(week, week - 1)).alias("block"))
    of = lambda part: F.transform(F.filter("s", lambda g: F.pmod(g, F.lit(PARTS)) == part), lambda g: F.shiftright(g, 32).cast("int"))
    parts = F.explode(F.array(*[F.struct(F.lit(i).alias("part"), of(i).alias("l")) for i in range(PARTS)])).alias("p")
    found = rows.agg(F.sum(F.size("s"))).first()[0] or 0
    tasks = max(int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")), 2 * found // A_TASK)  # by what comes out of the arrays, not by their bytes
    dealt = rows.select("us", F.xxhash64("key").alias("c"), parts).select(F.explode(F.array(week, week - 1)).alias("block"), "c", "p.part", "p.l").repartition(tasks, "block", "part")
    single = dealt.select("block", "part", "c", F.explode("l").alias("g")).groupBy("block", "part", "g").agg(F.min("c").alias("c"), F.max("c").alias("last")).filter("c = last")
    own = single.groupBy("c", "block").agg(F.count(F.lit(1)).alias("own"))
    least = rows.groupBy("key").agg(F.min("session_id").alias("rep"))
    every = placed.select("key", F.xxhash64("key").alias("c"), F.size("s").alias("n"), "block").distinct().join(own, ["c", "block"], "left")
    return every.filter(F.coalesce("own", F.lit(0)) <= _may_lack(F.col("n"), floor)).join(least, "key").select("rep", "key", "n", "block")


def linked_classes(rows: DataFrame, window_us: int, floor: float) -> DataFrame:
    """x, y: pairs of classes that are alike and have sessions in the same or neighbouring windows."""
    alive = materialized(_meeting(rows, window_us, floor))
    named = alive.select("key", F.col("rep").alias("session_id")).distinct()
    sets = materialized(rows.join(named, ["key", "session_id"]).dropDuplicates(["key"]).select("key", F.col("session_id").alias("rep"), "s"))
    grams = alive.select("rep", "n", "block").join(sets.select("rep", "s"), "rep").select("rep", "n", "block", F.explode("s").alias("g")).repartition("block", "g")  # dealt once for both uses
    counts = grams.groupBy("block", "g").agg(F.count(F.lit(1)).alias("f")).filter("f > 1")
    lists = grams.join(counts, ["block", "g"]).groupBy("rep", "block", "n").agg(F.sort_array(F.collect_list(F.struct(F.col("f").cast("int").alias("f"), "g"))).alias("l"))
    own = lists.withColumn("own", F.col("n") - F.size("l")).withColumn("m", _may_lack(F.col("n"), floor) + 1 - F.col("own"))  # so many are lacking at most, and one more is shared
    heads = materialized(own.filter("m > 0").select("rep", "n", "own", "block", F.explode(F.slice("l", F.lit(1), F.col("m"))["g"]).alias("g")))
    right = heads.select(F.col("rep").alias("y"), F.col("n").alias("ny"), F.col("own").alias("oy"), "g", "block")
    alike = (F.least("n", "ny") >= floor * F.greatest("n", "ny") - 1e-9) & ((1 + floor) * (F.col("own") + F.col("oy")) <= (1 - floor) * (F.col("n") + F.col("ny")) + 1e-9)
    pairs = heads.join(right, ["block", "g"]).filter((F.col("rep") < F.col("y")) & alike).select(F.col("rep").alias("x"), "y").distinct()
    side = lambda k: sets.select(F.col("rep").alias(k), F.col("key").alias(f"k{k}"), F.col("s").alias(f"s{k}"))
    both = pairs.join(side("x"), "x").join(side("y"), "y")
    counted = both.select("kx", "ky", F.size(F.array_intersect("sx", "sy")).alias("c"), (F.size("sx") + F.size("sy")).alias("total"))
    return counted.filter(F.col("c") >= floor * (F.col("total") - F.col("c")) - 1e-9).select(F.col("kx").alias("x"), F.col("ky").alias("y"))


def _within(met: DataFrame, window_us: int) -> DataFrame:
    """session_id, n: how many rows of the other class of its pair (of its own class, where first is null) a row meets within the window."""
    order = Window.partitionBy("pair").orderBy("us", "session_id").rowsBetween(Window.unboundedPreceding, 0)
    running = lambda flag: F.sum(F.coalesce(flag, F.lit(True)).cast("long")).over(order)
    counted = met.withColumn("upto", F.struct(running(F.col("first")).alias("firsts"), running(~F.col("first")).alias("others")))
    last = counted.groupBy("pair", "us").agg(F.max("upto").alias("upto"))
    at = lambda shift: last.select("pair", (F.col("us") - shift).alias("at_us"), "upto")
    high = asof(counted.drop("upto"), at(window_us), ["pair"], "us", "at_us", "upto", out="high")  # the last one at most the window later
    both = asof(high.drop("high_time"), at(-window_us - 1), ["pair"], "us", "at_us", "upto", out="low")
    met_of = lambda name: F.coalesce(F.col("high")[name], F.lit(0)) - F.coalesce(F.col("low")[name], F.lit(0))
    return both.select("session_id", F.when(F.col("first"), met_of("others")).when(~F.col("first"), met_of("firsts")).otherwise(met_of("firsts") - 1).alias("n"))


def retype_clusters(sessions: DataFrame, window_us: int = WINDOW_US, floor: float = FLOOR) -> DataFrame:
    """session_id, cluster (its smallest session_id), size and links (sessions it links to) of every session with a link."""
    rows = materialized(openers(sessions))
    pairs = materialized(linked_classes(rows, window_us, floor))
    narrow = rows.select("session_id", "us", "key")
    sides = pairs.select(F.concat_ws("/", "x", "y").alias("pair"), F.explode(F.array(F.struct(F.col("x").alias("key"), F.lit(True).alias("first")), F.struct(F.col("y").alias("key"), F.lit(False).alias("first")))).alias("e"))
    often = narrow.groupBy("key").agg(F.count(F.lit(1)).alias("c")).filter("c > 1").select("key")
    met = materialized(sides.select("pair", "e.key", "e.first").join(narrow, "key").unionByName(narrow.join(often, "key").withColumn("pair", F.col("key")).withColumn("first", F.lit(None).cast("boolean"))))

    order = Window.partitionBy("pair").orderBy("us", "session_id")
    near = (F.col("us") - F.lag("us").over(order) <= window_us) & (F.col("first").isNull() | (F.col("first") != F.lag("first").over(order)))
    edges = met.select("session_id", F.lag("session_id").over(order).alias("before"), near.alias("near")).filter("near").select(F.col("session_id").alias("u"), F.col("before").alias("v"))
    roots = components(edges)

    links = _within(met, window_us).groupBy("session_id").agg(F.sum("n").cast("bigint").alias("links"))
    sized = roots.groupBy("root").agg(F.count(F.lit(1)).alias("size"))
    return roots.join(sized, "root").join(links, roots["node"] == links["session_id"]).select("session_id", F.col("root").alias("cluster"), "size", "links")
