"""Statistics: correlation, concordance, ranks, paired tests, regression, clustering."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..operators import stats as X
from .registry import Tables, query


@query("""SELECT round(corr(n_chars, quality), 6) AS r, count(*) AS n, round(avg(n_chars) FILTER (quality = 1) - avg(n_chars) FILTER (quality = 0), 4) AS gap FROM documents JOIN labels USING (doc_id)""")
def prompt_corr(t: Tables) -> DataFrame:
    """Pearson's correlation of length and quality, and the gap of means."""
    d = t.documents.select("doc_id", "n_chars").join(t.labels, "doc_id")
    gap = F.avg(F.when(F.col("quality") == 1, F.col("n_chars"))) - F.avg(F.when(F.col("quality") == 0, F.col("n_chars")))
    return d.agg(F.round(X.pearson("n_chars", "quality"), 6).alias("r"), F.count(F.lit(1)).alias("n"), F.round(gap, 4).alias("gap"))


@query("""WITH x AS (SELECT source, avg(n_chars) AS a, avg(quality) AS b FROM documents JOIN labels USING (doc_id) GROUP BY 1)
  SELECT count(*) FILTER ((p.a - q.a) * (p.b - q.b) > 0) AS concordant, count(*) FILTER ((p.a - q.a) * (p.b - q.b) < 0) AS discordant, count(*) FILTER ((p.a - q.a) * (p.b - q.b) = 0) AS ties FROM x p JOIN x q ON p.source < q.source""")
def concordance(t: Tables) -> DataFrame:
    """Pairs of sources that agree or disagree in order. The pairs are of the few aggregated rows."""
    x = t.documents.select("doc_id", "n_chars", "source").join(t.labels, "doc_id").groupBy("source").agg(F.avg("n_chars").alias("a"), F.avg("quality").alias("b"))
    return X.concordance(x, "source", "a", "b")


@query("""WITH f AS (SELECT doc_id, toxic, n_chars > 3000 AS long, lang = 'en' AS english, text LIKE '%@%' AS contact FROM documents JOIN labels USING (doc_id)),
  u AS (SELECT toxic, feature, present FROM f UNPIVOT (present FOR feature IN (long, english, contact)))
  SELECT feature, count(*) FILTER (present) AS n, round(avg(toxic) FILTER (present), 6) AS rate, round(avg(toxic) FILTER (present) - avg(toxic), 6) AS lift FROM u GROUP BY 1""")
def risky_features(t: Tables) -> DataFrame:
    """How much more often an outcome comes with a feature than on the whole."""
    f = t.documents.select("doc_id", (F.col("n_chars") > 3000).alias("long"), (F.col("lang") == "en").alias("english"), F.col("text").contains("@").alias("contact")).join(t.labels, "doc_id")
    u = f.unpivot("toxic", ["long", "english", "contact"], "feature", "present")
    rate = F.avg(F.when(F.col("present"), F.col("toxic")))
    return u.groupBy("feature").agg(F.count_if("present").alias("n"), F.round(rate, 6).alias("rate"), F.round(rate - F.avg("toxic"), 6).alias("lift"))


@query("""WITH d AS (SELECT o_orderpriority AS task, avg(o_totalprice) FILTER (o_orderstatus = 'F') - avg(o_totalprice) FILTER (o_orderstatus = 'O') AS delta, year(o_orderdate) AS y FROM orders GROUP BY ALL),
  p AS (SELECT *, abs(delta) AS a FROM d WHERE delta IS NOT NULL AND delta <> 0), r AS (SELECT *, rank() OVER (ORDER BY a) + (count(*) OVER (PARTITION BY a) - 1) / 2.0 AS r FROM p)
  SELECT count(*) AS pairs, sum(r) FILTER (delta > 0) AS w_plus, sum(r) FILTER (delta < 0) AS w_minus FROM r""")
def wilcoxon_ranks(t: Tables) -> DataFrame:
    """Signed rank sums with mean ranks of ties, over the few pairs of groups."""
    by = lambda s: F.avg(F.when(F.col("o_orderstatus") == s, F.col("o_totalprice")))
    d = t.orders.groupBy("o_orderpriority", F.year("o_orderdate")).agg((by("F") - by("O")).alias("delta"))
    return X.signed_ranks(d, "delta").select("pairs", "w_plus", "w_minus")


@query("""WITH d AS (SELECT o_custkey, round(avg(o_totalprice) FILTER (o_orderstatus = 'F') / 1000) - round(avg(o_totalprice) FILTER (o_orderstatus = 'O') / 1000) AS delta FROM orders GROUP BY ALL),
  a AS (SELECT abs(delta) AS a, count(*) AS t, count(*) FILTER (delta < 0) AS neg FROM d WHERE delta IS NOT NULL AND delta <> 0 GROUP BY 1),
  r AS (SELECT *, coalesce(sum(t) OVER (ORDER BY a ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) + (t + 1) / 2.0 AS r FROM a),
  w AS (SELECT sum(t)::DOUBLE AS n, sum(r * neg) AS w_minus, sum(t * t * t - t) AS ties FROM r)
  SELECT n::BIGINT AS pairs, w_minus, round((w_minus - n * (n + 1) / 4 - 0.5) / sqrt(n * (n + 1) * (2 * n + 1) / 24 - ties / 48), 6) AS z FROM w""")
def wilcoxon_test(t: Tables) -> DataFrame:
    """The one-sided signed-rank test with ties over a pair a customer."""
    by = lambda s: F.round(F.avg(F.when(F.col("o_orderstatus") == s, F.col("o_totalprice"))) / 1000)
    d = t.orders.groupBy("o_custkey").agg((by("F") - by("O")).alias("delta"))
    return X.signed_rank_test(d, "delta").select("pairs", "w_minus", F.round("z", 6).alias("z"))


@query("""WITH d AS (SELECT o_custkey, avg(o_totalprice) FILTER (o_orderstatus = 'O') AS c, avg(o_totalprice) FILTER (o_orderstatus = 'F') AS x FROM orders GROUP BY 1 HAVING c IS NOT NULL AND x IS NOT NULL)
  SELECT count(*) AS n, round(median(x - c), 4) AS delta, round(100 * median(x - c) / median(c), 6) AS pct FROM d""")
def paired_medians(t: Tables) -> DataFrame:
    """The median difference of pairs, in dollars and in percent of the control."""
    by = lambda s: F.avg(F.when(F.col("o_orderstatus") == s, F.col("o_totalprice")))
    d = t.orders.groupBy("o_custkey").agg(by("O").alias("control"), by("F").alias("treatment")).filter("control IS NOT NULL AND treatment IS NOT NULL")
    return X.paired_medians(d, "control", "treatment").select("n", F.round("delta", 4).alias("delta"), F.round("pct", 6).alias("pct"))


@query("""SELECT round(regr_slope(o_totalprice, x), 6) AS slope, round(regr_intercept(o_totalprice, x), 4) AS intercept, round(regr_r2(o_totalprice, x), 8) AS r2, count(*) AS n
  FROM (SELECT o_totalprice, dayofyear(o_orderdate)::DOUBLE AS x FROM orders)""")
def ols_trend(t: Tables) -> DataFrame:
    """Least squares of one term by moments."""
    d = t.orders.select("o_totalprice", F.dayofyear("o_orderdate").cast("double").alias("x"))
    return d.agg(
        F.round(F.regr_slope("o_totalprice", "x"), 6).alias("slope"), F.round(F.regr_intercept("o_totalprice", "x"), 4).alias("intercept"),
        F.round(F.regr_r2("o_totalprice", "x"), 8).alias("r2"), F.count(F.lit(1)).alias("n"),
    )


@query("""WITH e AS (SELECT label, unnest(embedding)::DOUBLE AS x, generate_subscripts(embedding, 1) AS i FROM embeddings), c AS (SELECT label, i, avg(x) AS m FROM e GROUP BY ALL)
  SELECT label, round(sqrt(sum(m * m)), 6) AS norm, count(*) AS dims FROM c GROUP BY 1""")
def centroid_norms(t: Tables) -> DataFrame:
    """The mean vector of each cluster and its length."""
    e = t.embeddings.select("label", F.posexplode("embedding").alias("i", "x"))
    c = e.groupBy("label", "i").agg(F.avg(F.col("x").cast("double")).alias("m"))
    return c.groupBy("label").agg(F.round(F.sqrt(F.sum(F.col("m") * F.col("m"))), 6).alias("norm"), F.count(F.lit(1)).alias("dims"))


@query("""WITH q AS (SELECT embedding::DOUBLE[] AS v FROM embeddings WHERE vec_id = 0) SELECT vec_id, round(list_cosine_similarity(embedding::DOUBLE[], q.v), 6) AS similarity FROM embeddings, q ORDER BY list_cosine_similarity(embedding::DOUBLE[], q.v) DESC, vec_id LIMIT 10""")
def cosine_topk(t: Tables) -> DataFrame:
    """A top-k report: the ten vectors nearest to one query vector, which is a single row."""
    q = t.embeddings.filter("vec_id = 0").select(F.col("embedding").alias("q"))
    s = t.embeddings.join(F.broadcast(q)).withColumn("s", X.cosine("embedding", "q"))  # one row
    return s.orderBy(F.desc("s"), "vec_id").limit(10).select("vec_id", F.round("s", 6).alias("similarity"))


@query()
def kmeans_plans(t: Tables) -> DataFrame:
    """Clusters of document shapes, by Spark's own k-means from a fixed seed."""
    d = t.documents.filter("text IS NOT NULL").select("doc_id", F.log1p("n_chars").alias("a"), F.log1p(F.regexp_count("text", F.lit("\n"))).alias("b"))
    return X.kmeans(d, "doc_id", ["a", "b"], 4, seed=1)


@query()
def paired_bootstrap(t: Tables) -> DataFrame:
    """A seeded bootstrap of a paired mean difference, one row a resample on the executors, then its interval."""
    by = lambda s: F.avg(F.when(F.col("o_orderstatus") == s, F.col("o_totalprice")))
    d = t.orders.groupBy("o_orderpriority", F.year("o_orderdate").alias("y")).agg((by("F") - by("O")).alias("delta")).filter("delta IS NOT NULL")
    return X.bootstrap_mean(d, ["o_orderpriority", "y"], "delta", 2000, seed=1)
