"""A stored search index: postings by term, read by term.

A text's vector has its stems' counts, and `CONCEPT_WEIGHT` for every stem that belongs to a concept; a
query meets a text by cosine similarity of these vectors, and by the share of its stems that occur in the
text anywhere, as a part of a word too, with a bonus where the whole query does. The index keeps postings
of stems and concepts, postings of whole words, the vocabulary, and every text's norm. Postings lie in
folders by a hash of their term, so that a query reads the folders of its terms only; words that contain a
stem are looked up in the vocabulary, which is small beside the postings. Texts are read only to confirm a
bonus, for those that hold all of the query's words.
"""

from __future__ import annotations

import re
import zlib

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Endings, words that say nothing, concepts with their terms, and the weights of the blend.
ENDING = "(?:ing|ed|es|s)$"
STOP_WORDS = ("a", "an", "and", "are", "as", "at", "be", "by", "for", "from", "how", "i", "in", "is", "it", "my", "of", "on", "or", "the", "to", "what", "with")
CONCEPTS = {
    "auth_access": ("auth", "authentication", "oauth", "login", "credential", "token", "session", "csrf", "permission", "access"),
    "cost_usage": ("budget", "cap", "cost", "limit", "plan", "price", "quota", "spend", "token", "usage"),
    "debug_failure": ("bug", "crash", "error", "exception", "fail", "failure", "fix", "regression", "stack", "timeout"),
    "deploy_ops": ("container", "deploy", "docker", "image", "kubernetes", "podman", "publish", "release", "rollout", "service"),
    "responsive_ui": ("mobile", "narrow", "overflow", "responsive", "table", "viewport", "width"),
    "search_retrieval": ("embed", "embedding", "find", "fts", "lookup", "query", "retrieval", "search", "semantic"),
}
CONCEPT_WEIGHT, LEXICAL, SEMANTIC, BONUS, THRESHOLD, LIMIT = 2.25, 0.68, 0.32, 0.75, 0.12, 100
BUCKETS = 64
#: Up to so many words that hold a part of the query go to every executor.
BROADCAST_WORDS = 200_000


def _stemmed(word: str) -> str:
    return re.sub(ENDING, "", word)


#: A term in two concepts belongs to the later one.
CONCEPT_OF = {_stemmed(term): name for name, terms in CONCEPTS.items() for term in terms}


def query_terms(query: str) -> list[str]:
    """The stems of a query, with repeats."""
    stems = [_stemmed(w) for w in re.split("[^a-z0-9]+", query.strip().lower())]
    return [s for s in stems if len(s) > 1 and s not in STOP_WORDS]


def _bucket(term: str | Column):
    return zlib.crc32(term.encode()) % BUCKETS if isinstance(term, str) else (F.crc32(term.cast("binary")) % BUCKETS).cast("int").alias("bucket")


def build(df: DataFrame, key: str, text: str, folder: str) -> None:
    """Write the index of df below folder: stems, words, vocabulary, norms and texts. Null texts and those without words are found by nothing.

    Texts are dealt by key once; words, stems and concepts are counted where they lie and written in one
    pass, a folder a kind and bucket, so that postings are never shuffled.
    """
    spark = df.sparkSession
    dealt = df.select(F.col(key).alias("key"), F.lower(text).alias("text")).repartition("key")
    counts = dealt.select("key", F.explode(F.split("text", "[^a-z0-9]+")).alias("word")).filter("word <> ''").groupBy("key", "word").agg(F.count(F.lit(1)).cast("double").alias("tf"))
    stem = F.regexp_replace("word", ENDING, "")
    some = counts.withColumn("stem", F.when((F.length(stem) > 1) & ~stem.isin(*STOP_WORDS), stem))
    concept = F.create_map(*[F.lit(x) for kv in CONCEPT_OF.items() for x in kv])[F.col("stem")]
    kinds = F.array(
        F.struct(F.lit("words").alias("kind"), F.col("word").alias("term"), F.col("tf").alias("w")),
        F.struct(F.lit("stems").alias("kind"), F.col("stem").alias("term"), F.col("tf").alias("w")),
        F.struct(F.lit("stems").alias("kind"), F.concat(F.lit("concept:"), concept).alias("term"), (F.col("tf") * CONCEPT_WEIGHT).alias("w")),
    )
    both = some.select("key", F.explode(kinds).alias("p")).select("key", "p.*").filter("term IS NOT NULL").groupBy("key", "kind", "term").agg(F.sum("w").alias("w"))
    placed = both.select("key", "term", "w", "kind", _bucket(F.col("term"))).sortWithinPartitions("kind", "bucket", "term")
    placed.write.mode("overwrite").partitionBy("kind", "bucket").option("compression", "zstd").parquet(f"{folder}/postings")
    _postings(spark, folder, "words").groupBy("term").agg(F.count(F.lit(1)).alias("texts")).withColumnRenamed("term", "word").write.mode("overwrite").parquet(f"{folder}/vocabulary")
    _postings(spark, folder, "stems").groupBy("key").agg(F.sum(F.col("w") * F.col("w")).alias("norm2")).write.mode("overwrite").parquet(f"{folder}/norms")
    df.select(F.col(key).alias("key"), F.lower(text).alias("text")).write.mode("overwrite").parquet(f"{folder}/texts")


def _postings(spark: SparkSession, folder: str, kind: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/postings").filter(F.col("kind") == kind).drop("kind")


def search(spark: SparkSession, folder: str, query: str, k: int = LIMIT) -> DataFrame:
    """key, score, lexical, semantic and match (hybrid, semantic or full-text) of the k best texts, ties by key; a blank query finds nothing."""
    terms, whole = query_terms(query), query.strip().lower()
    distinct = list(dict.fromkeys(terms))
    weights = {t: float(terms.count(t)) for t in distinct}
    for t in terms:
        if t in CONCEPT_OF:
            weights[f"concept:{CONCEPT_OF[t]}"] = weights.get(f"concept:{CONCEPT_OF[t]}", 0.0) + CONCEPT_WEIGHT
    parts = list(dict.fromkeys(w for w in re.split("[^a-z0-9]+", whole) if w))
    vocabulary = spark.read.parquet(f"{folder}/vocabulary")

    def holding(wanted: list[str]) -> DataFrame:
        """key, part: which of the wanted strings a text has in some word."""
        empty = spark.createDataFrame([], "part string, word string, bucket int")
        hits = F.array_compact(F.array(*[F.when(F.contains("word", F.lit(p)), F.lit(p)) for p in wanted])) if wanted else None
        found = vocabulary.select("word", F.explode(hits).alias("part")).select("part", "word", _bucket(F.col("word"))) if wanted else empty
        found = F.broadcast(found) if found.count() <= BROADCAST_WORDS else found  # then postings stay where they lie
        return _postings(spark, folder, "words").withColumnRenamed("term", "word").join(found, ["bucket", "word"]).select("key", "part").distinct()

    overlap = holding(distinct).join(spark.createDataFrame([(t, n) for t, n in ((t, terms.count(t)) for t in distinct)], "part string, times int"), "part").groupBy("key").agg(F.sum("times").alias("hits"))
    texts = spark.read.parquet(f"{folder}/texts")
    if parts:
        holders = holding(parts).groupBy("key").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") == len(parts)).select("key")
        texts = texts.join(holders, "key", "left_semi")
    exact = texts.filter(F.contains("text", F.lit(whole))).select("key", F.lit(BONUS).alias("bonus")) if whole else texts.limit(0).select("key", F.lit(BONUS).alias("bonus"))
    postings = _postings(spark, folder, "stems").filter(F.col("bucket").isin(*{_bucket(t) for t in weights}) & F.col("term").isin(*weights)) if weights else _postings(spark, folder, "stems").limit(0)
    weight = F.create_map(*[F.lit(x) for kv in weights.items() for x in kv])[F.col("term")] if weights else F.lit(0.0)
    dots = postings.groupBy("key").agg(F.sum(F.col("w") * weight).alias("dot"))
    own = sum(w * w for w in weights.values()) or 1.0
    cosine = dots.join(spark.read.parquet(f"{folder}/norms"), "key").select("key", (F.col("dot") / F.sqrt(F.col("norm2") * own)).alias("semantic"))
    rows = overlap.join(exact, "key", "full").join(cosine, "key", "full")
    rows = rows.select("key", F.least(F.lit(1.0), F.coalesce("bonus", F.lit(0.0)) + F.coalesce("hits", F.lit(0)) / max(1, len(terms))).alias("lexical"), F.coalesce("semantic", F.lit(0.0)).alias("semantic"))
    rows = rows.filter((F.col("lexical") > 0) | (F.col("semantic") >= THRESHOLD))
    match = F.when((F.col("lexical") > 0) & (F.col("semantic") >= THRESHOLD), "hybrid").when(F.col("semantic") >= THRESHOLD, "semantic").otherwise("full-text")
    return rows.select("key", (LEXICAL * F.col("lexical") + SEMANTIC * F.col("semantic")).alias("score"), "lexical", "semantic", match.alias("match")).orderBy(F.desc("score"), "key").limit(k)
