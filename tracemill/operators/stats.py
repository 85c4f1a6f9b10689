"""Statistics over aggregated tables, in Spark's own functions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import materialized
from .quantiles import exact_quantiles


def pearson(a: str | Column, b: str | Column) -> Column:
    """Pearson's correlation; null where one side does not vary."""
    a, b = (F.col(c) if isinstance(c, str) else c for c in (a, b))
    both = a.isNotNull() & b.isNotNull()
    x, y = F.when(both, a), F.when(both, b)
    return F.try_divide(F.covar_pop(x, y), F.stddev_pop(x) * F.stddev_pop(y))


def concordance(df: DataFrame, key: str, a: str, b: str) -> DataFrame:
    """Counts of concordant, discordant and tied pairs of rows; for small, aggregated tables."""
    q = df.select(*[F.col(c).alias(f"_{c}") for c in (key, a, b)])
    sign = (F.col(a) - F.col(f"_{a}")) * (F.col(b) - F.col(f"_{b}"))
    pairs = df.join(q, F.col(key) < F.col(f"_{key}"))
    return pairs.agg(F.count_if(sign > 0).alias("concordant"), F.count_if(sign < 0).alias("discordant"), F.count_if(sign == 0).alias("ties"))


def signed_ranks(df: DataFrame, delta: str) -> DataFrame:
    """Pairs that differ, the rank sums of positive and negative differences, and the tie term sum(t^3 - t); ties share their mean rank.

    Ranks are computed over the distinct sizes of differences, each with its number of pairs, after
    a first aggregation; sizes are numbered in blocks (`row_offsets`), so no task sees them all.
    """
    p = df.filter(F.col(delta).isNotNull() & ~F.isnan(delta) & (F.col(delta) != 0)).select(F.abs(delta).cast("double").alias("_a"), (F.col(delta) > 0).alias("_up"))
    sizes = p.groupBy("_a").agg(F.count(F.lit(1)).alias("_t"), F.count_if("_up").alias("_plus"))
    ranked = running_total(sizes, "_a", "_t").withColumn("_r", F.col("_before") + (F.col("_t") + 1) / 2.0)
    return ranked.agg(
        F.coalesce(F.sum("_t"), F.lit(0)).alias("pairs"), F.sum(F.when(F.col("_plus") > 0, F.col("_r") * F.col("_plus"))).alias("w_plus"),
        F.sum(F.when(F.col("_t") > F.col("_plus"), F.col("_r") * (F.col("_t") - F.col("_plus")))).alias("w_minus"), F.coalesce(F.sum(F.col("_t") * F.col("_t") * F.col("_t") - F.col("_t")), F.lit(0)).alias("tie_term"),
    )


def running_total(df: DataFrame, order: str, amount: str, ties: tuple[str, ...] = (), descending: bool = False, blocks: int = 64) -> DataFrame:
    """df with _before: the sum of amount over the rows that come earlier by order (a number) and ties.

    The value range is cut into blocks at approximate quantiles; block sums give offsets, and the
    window runs within a block, so a table is never sorted in one task.
    """
    cuts = df.agg(F.percentile_approx(order, [i / blocks for i in range(1, blocks)], 1000).alias("_c"))
    block = F.size(F.filter("_c", lambda c: c < F.col(order)))
    rows = df.crossJoin(F.broadcast(cuts)).withColumn("_block", F.coalesce(-block if descending else block, F.lit(0))).drop("_c")  # one row
    sums = rows.groupBy("_block").agg(F.sum(amount).alias("_sum"))
    earlier = Window.orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)  # a row a block
    offsets = sums.select("_block", F.coalesce(F.sum("_sum").over(earlier), F.lit(0)).alias("_offset"))
    first = F.col(order).desc() if descending else F.col(order).asc()
    inside = Window.partitionBy("_block").orderBy(first, *ties).rowsBetween(Window.unboundedPreceding, -1)
    rows = rows.join(F.broadcast(offsets), "_block")  # at most as many rows as blocks
    return rows.withColumn("_before", F.col("_offset") + F.coalesce(F.sum(amount).over(inside), F.lit(0))).drop("_block", "_offset")


def normal_cdf(z: Column) -> Column:
    """The standard normal distribution by Abramowitz and Stegun's formula 7.1.26."""
    x = F.abs(z) / F.sqrt(F.lit(2.0))
    u = 1 / (1 + 0.3275911 * x)
    poly = u * (0.254829592 + u * (-0.284496736 + u * (1.421413741 + u * (-1.453152027 + u * 1.061405429))))
    erf = 1 - poly * F.exp(-x * x)
    return F.when(z >= 0, (1 + erf) / 2).otherwise((1 - erf) / 2)


def signed_rank_test(df: DataFrame, delta: str, min_pairs: int = 12, alpha: float = 0.05) -> DataFrame:
    """pairs, w_minus, z, p and a verdict for deltas treatment - control, one-sided: does the treatment cost less?

    The normal approximation with continuity and tie corrections. Without a pair that differs p is 1;
    below min_pairs of them nothing is proven.
    """
    r = signed_ranks(df, delta)
    n, w = F.col("pairs").cast("double"), F.coalesce("w_minus", F.lit(0.0))
    variance = n * (n + 1) * (2 * n + 1) / 24 - F.col("tie_term") / 48
    z = F.when((n > 0) & (variance > 0), (w - n * (n + 1) / 4 - 0.5) / F.sqrt(variance))
    r = r.withColumn("z", z).withColumn("p", F.when(F.col("z").isNotNull(), F.least(F.lit(1.0), F.greatest(F.lit(0.0), 1 - normal_cdf(F.col("z"))))).otherwise(F.lit(1.0)))
    verdict = F.when(F.col("pairs") < min_pairs, "not-yet-provable").when(F.col("p") < alpha, "proven").otherwise("null")
    return r.withColumn("verdict", verdict)


def paired_medians(df: DataFrame, control: str, treatment: str) -> DataFrame:
    """n, the median of treatment - control, and that as a percentage of the median control (null where that is 0)."""
    pairs = materialized(df.select(F.col(control).alias("base"), (F.col(treatment) - F.col(control)).alias("delta")))
    median = lambda c: exact_quantiles(pairs, [], c, [0.5]).select(F.col("q")[0].alias(c))
    m = pairs.agg(F.count(F.lit(1)).alias("n"))
    for c in ("delta", "base"):
        m = m.join(F.broadcast(median(c)), F.lit(True), "left")  # one row
    return m.select("n", "delta", F.when(F.col("base") != 0, 100 * F.col("delta") / F.col("base")).alias("pct"))


def bootstrap_mean(df: DataFrame, key: list[str], value: str, resamples: int, seed: int) -> DataFrame:
    """n, the mean, and the 2.5 and 97.5 percentiles of resampled means.

    Each resample draws every row Poisson(1) times, by the row's and resample's hash, which needs no row number and is the same on every run.
    """
    u = F.pmod(F.xxhash64(*key, "_b", F.lit(seed)), F.lit(1_000_000)) / 1_000_000
    cuts = [0.36787944, 0.73575888, 0.91969860, 0.98101184, 0.99634015, 0.99940582]
    times = sum((F.when(u > c, 1).otherwise(0) for c in cuts), F.lit(0))
    draws = df.select(*key, value, F.explode(F.sequence(F.lit(1), F.lit(resamples))).alias("_b")).withColumn("_k", times)
    means = draws.groupBy("_b").agg((F.sum(F.col(value) * F.col("_k")) / F.nullif(F.sum("_k"), F.lit(0))).alias("_m"))
    q = means.agg(F.percentile("_m", F.array(F.lit(0.025), F.lit(0.975))).alias("q"))
    whole = df.agg(F.count(F.lit(1)).alias("n"), F.avg(value).alias("mean"))
    return whole.join(F.broadcast(q)).select("n", F.round("mean", 4).alias("mean"), F.round(F.col("q")[0], 4).alias("low"), F.round(F.col("q")[1], 4).alias("high"))  # one row each


def cosine(a: str, b: str) -> Column:
    """Cosine similarity of two arrays of numbers."""
    dot = lambda x, y: F.aggregate(F.zip_with(x, y, lambda p, q: p.cast("double") * q.cast("double")), F.lit(0.0), lambda s, v: s + v)
    return dot(a, b) / (F.sqrt(dot(a, a)) * F.sqrt(dot(b, b)))


def kmeans(df: DataFrame, key: str, features: list[str], k: int, seed: int) -> DataFrame:
    """key and cluster."""
    from pyspark.ml.clustering import KMeans
    from pyspark.ml.feature import StandardScaler, VectorAssembler

    rows = VectorAssembler(inputCols=features, outputCol="_v").transform(df)
    rows = StandardScaler(inputCol="_v", outputCol="_x").fit(rows).transform(rows)
    model = KMeans(k=k, seed=seed, featuresCol="_x", predictionCol="cluster").fit(rows)
    return model.transform(rows).select(key, "cluster")


def ols(df: DataFrame, target: str, terms: list[str], ridge: float = 0.0) -> tuple[dict[str, float], float, int]:
    """Coefficients (with `intercept`), R squared and the number of rows of a least-squares fit.

    The moments of all pairs of terms are sums in one pass over the rows; only that square table, as
    large as the number of terms squared, is solved on the driver. Rows with a null are left out; a
    singular system raises ValueError.
    """
    import numpy as np

    x = [F.lit(1.0), *[F.col(f"`{t}`").cast("double") for t in terms]]
    rows = df.dropna(subset=[target, *[t for t in terms]])
    y = F.col(target).cast("double")
    k = len(x)
    sums = [F.sum(x[i] * x[j]).alias(f"g{i}_{j}") for i in range(k) for j in range(i, k)] + [F.sum(c * y).alias(f"m{i}") for i, c in enumerate(x)] + [F.sum(y * y).alias("yy")]
    r = rows.agg(*sums).first()
    if r["g0_0"] is None or r["g0_0"] < k:
        raise ValueError("fewer rows than terms")
    gram = np.array([[r[f"g{min(i, j)}_{max(i, j)}"] for j in range(k)] for i in range(k)]) + ridge * np.eye(k)
    scale = np.sqrt(np.diag(gram))
    if (scale == 0).any() or np.linalg.matrix_rank(gram / np.outer(scale, scale), tol=1e-10) < k:
        raise ValueError("terms depend on each other")
    moment = np.array([r[f"m{i}"] for i in range(k)])
    beta = np.linalg.solve(gram / np.outer(scale, scale), moment / scale) / scale
    n = r["g0_0"]
    spread = r["yy"] - r["m0"] ** 2 / n
    error = r["yy"] - 2 * beta @ moment + beta @ gram @ beta
    return dict(zip(["intercept", *terms], map(float, beta))), float(1 - error / spread) if spread > 0 else 0.0, int(n)


def bootstrap_median(df: DataFrame, key: list[str], value: str, resamples: int, seed: int, alpha: float = 0.05) -> DataFrame:
    """One row, low and high: the interval of the medians of resamples, each drawing every row Poisson(1) times by hash.

    A resample's median is the value at which the running number of draws passes half of them.
    """
    u = F.pmod(F.xxhash64(*key, "_b", F.lit(seed)), F.lit(1_000_000)) / 1_000_000
    times = sum((F.when(u > c, 1).otherwise(0) for c in (0.36787944, 0.73575888, 0.91969860, 0.98101184, 0.99634015, 0.99940582)), F.lit(0))
    draws = df.select(*key, value, F.explode(F.sequence(F.lit(1), F.lit(resamples))).alias("_b")).withColumn("_k", times).filter("_k > 0")
    medians = draws.groupBy("_b").agg(F.percentile(value, F.lit(0.5), F.col("_k")).alias("_m"))
    return medians.agg(F.percentile("_m", F.lit(alpha / 2)).alias("low"), F.percentile("_m", F.lit(1 - alpha / 2)).alias("high"))
