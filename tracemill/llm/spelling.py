"""Spelling variants of a corpus's words: forward and reversed sorted dictionaries, scanned in blocks.

Words are runs of letters with their corpus counts. Two words are near if they differ by exactly
one inserted, deleted or replaced character.

1. One edit leaves a half intact: of two near words, the shorter of length l, the first or the last
   l // 2 characters are the same. So every word stands in the forward dictionary below its first
   half and in the reversed one below its last half, once as the shorter word (l is its length)
   and once as the longer (l is one less).
2. A block of more than `BLOCK` entries is subdivided: what lies between the part known to be equal
   in front (a characters) and at the end (b characters) holds the edit and again has an intact
   half, so the block's entries go on to longer shared prefixes and longer shared suffixes. Blocks
   in which only one character is left are not divided further; the alphabet bounds them.
3. The dictionaries are range-partitioned by block and scanned: the words of a block, few by
   construction, are compared with each other by edit distance. Every near pair is found in some
   block, whatever is skewed; a pair that several blocks find counts once.

A word's form is its near word of the largest count (ties: the smallest in code-point order), if
that is at least twice its own; its root is where following forms ends. Counts at least double on
the way, so chains are short, and pointers are doubled until none moves.

Edge cases: null texts have no words; a null doc_id counts as an empty one; a text of any length
is read whole; repeated rows count each; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import ascii_lower, written

#: Letters of the words, after A-Z are lower-cased.
LETTERS = "[a-zÀ-ÿ]+"
LEAST_LENGTH, LEAST_COUNT = 5, 3
#: A run in whose document-and-run checksum this divides loses a character.
SLIP = 97
#: Entries of a block that is not subdivided.
BLOCK = 64
#: A form's count is at least so many times the word's.
RATIO = 2


def runs(docs: DataFrame) -> DataFrame:
    """word: every run of letters of every text, with the slips of its document; short ones left out."""
    letters = F.regexp_extract_all(ascii_lower(F.coalesce("text", F.lit(""))), F.lit(LETTERS), F.lit(0))
    found = docs.select(F.concat(F.coalesce(F.col("doc_id").cast("string"), F.lit("")), F.lit(":")).alias("of"), F.explode(letters).alias("run"))
    found = found.withColumn("size", F.length("run")).filter(F.col("size") >= LEAST_LENGTH)
    found = found.withColumn("h", F.crc32(F.concat("of", "run").cast("binary")))
    at = (F.col("h") % F.col("size")).cast("int")
    slipped = F.concat(F.substring(F.col("run"), F.lit(1), at), F.substring(F.col("run"), at + 2, F.col("size")))
    return found.select(F.when(F.col("h") % SLIP == 0, slipped).otherwise(F.col("run")).alias("word")).filter(F.length("word") >= LEAST_LENGTH)


def dictionary(docs: DataFrame) -> DataFrame:
    """word, n of every word that occurs often enough."""
    return runs(docs).groupBy("word").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") >= LEAST_COUNT)


def _halved(entries: DataFrame) -> DataFrame:
    """Each entry in the next longer shared prefix and shared suffix."""
    half = F.floor((F.col("l") - F.col("a") - F.col("b")) / 2).cast("int")
    ways = F.array(F.struct((F.col("a") + half).alias("a"), F.col("b")), F.struct(F.col("a"), (F.col("b") + half).alias("b")))
    return entries.withColumn("way", F.explode(ways)).select("word", "n", "l", "longer", "way.a", "way.b").distinct()


def _known() -> Column:
    """What all words of a block share: its first a and its last b characters (read from the reversed word)."""
    front = F.substring(F.col("word"), F.lit(1), F.col("a"))
    return F.concat(front, F.lit("|"), F.substring(F.reverse("word"), F.lit(1), F.col("b"))).alias("known")


def blocks(words: DataFrame, limit: int = BLOCK) -> DataFrame:
    """l, a, b, known, word, n, longer: each word's entries in blocks that are small enough to be scanned."""
    place = ["l", "a", "b", "known"]
    roles = F.explode(F.array(F.lit(False), F.lit(True))).alias("longer")
    start = words.select("word", "n", roles).withColumn("l", F.length("word") - F.col("longer").cast("int"))
    entries, done = _halved(start.withColumn("a", F.lit(0)).withColumn("b", F.lit(0))), None
    while True:
        entries = written(entries.withColumn("known", _known()))
        # a block with one word, or with none of the length l, has no pair
        sizes = entries.groupBy(place).agg(F.count(F.lit(1)).alias("c"), F.min("longer").alias("all_longer")).filter("c > 1 AND NOT all_longer")
        found = entries.join(sizes.drop("all_longer"), place)
        small = (F.col("c") <= limit) | (F.col("l") - F.col("a") - F.col("b") <= 1)
        ready = found.filter(small).drop("c")
        done = ready if done is None else done.unionByName(ready)
        skewed = written(found.filter(~small).drop("c"))
        if skewed.isEmpty():
            return done
        entries = _halved(skewed)


def near_pairs(words: DataFrame, limit: int = BLOCK) -> DataFrame:
    """x, n_x, y, n_y: every pair of near words once, x being the shorter or the smaller one."""
    place = ["l", "a", "b", "known"]
    sorted_blocks = blocks(words, limit).repartitionByRange(*place)
    scanned = sorted_blocks.groupBy(place).agg(F.collect_list(F.struct("word", "n", "longer")).alias("block"))

    def partners(x: Column) -> Column:
        near = lambda y: (y["longer"] | (x["word"] < y["word"])) & (F.levenshtein(x["word"], y["word"], 1) == 1)
        return F.transform(F.filter("block", near), lambda y: F.struct(x["word"].alias("x"), x["n"].alias("n_x"), y["word"].alias("y"), y["n"].alias("n_y")))

    pairs = F.flatten(F.transform(F.filter("block", lambda x: ~x["longer"]), partners))
    return scanned.select(F.explode(pairs).alias("p")).select("p.*").distinct()


def _rooted(forms: DataFrame) -> DataFrame:
    """word, root for every word with a form: pointers doubled until none moves."""
    now = written(forms.select("word", F.col("form").alias("root")))
    while True:
        onward = now.select(F.col("word").alias("root"), F.col("root").alias("next"))
        moved = written(now.join(onward, "root", "left").select("word", F.coalesce("next", "root").alias("root"), F.col("next").isNotNull().alias("moved")))
        now = moved.drop("moved")
        if moved.filter("moved").isEmpty():
            return now


def variants(docs: DataFrame, limit: int = BLOCK) -> DataFrame:
    """word, form, root, n, n_near, form_n of every word."""
    words = written(dictionary(docs))
    pairs = written(near_pairs(words, limit))
    sides = pairs.select(F.col("x").alias("word"), F.col("n_x").alias("n"), F.col("y").alias("other"), F.col("n_y").alias("m"))
    sides = sides.unionByName(pairs.select(F.col("y").alias("word"), F.col("n_y").alias("n"), F.col("x").alias("other"), F.col("n_x").alias("m")))
    best = sides.groupBy("word", "n").agg(F.count(F.lit(1)).alias("n_near"), F.min(F.struct((-F.col("m")).alias("less"), F.col("other"))).alias("best"))
    strong = -F.col("best.less") >= RATIO * F.col("n")
    formed = written(best.select("word", "n_near", F.when(strong, F.col("best.other")).alias("form"), F.when(strong, -F.col("best.less")).alias("form_n")))
    roots = _rooted(formed.filter("form IS NOT NULL"))
    answer = words.join(formed, "word", "left").join(roots, "word", "left")
    return answer.select("word", "form", F.coalesce("root", "word").alias("root"), "n", F.coalesce("n_near", F.lit(0)).cast("bigint").alias("n_near"), "form_n")
