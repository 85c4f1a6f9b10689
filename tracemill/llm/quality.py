"""Quality rules: fixed text statistics, and a logistic regression over hashed n-grams.

The regression sees the relative frequencies of hashed word one- and two-grams and of hashed
character five-grams (code points), learns from labelled rows (quality 0 or 1) and is calibrated by Platt's method
on rows it did not learn from; a document is kept where its calibrated probability reaches a
fixed threshold and the base rule does not fail it. Scoring runs in Arrow batches: with
relative frequencies a text's value is the mean of its n-grams' weights.

The training rows are a bounded sample: of each label at most `PER_LABEL` ids, by id hash. Ids may
be of any type. Repeated windows of words are told by 64-bit hashes of rolled word hashes, so
n_repeat_words holds up to their collisions (some 1e-10 for a text of 100,000 words).

Edge cases: a null text has no words and fails the base rule; texts without n-grams score by the
intercept; labels that are null, or of ids that aren't among the documents, are not used; with
labels of one kind only, the verdict is that kind's for every text. An id with several labels
counts by the best of them, one with several texts learns from the first by code point. Texts of
any length are scored whole, in pieces. Null and repeated ids are each answered; an empty table
gives no rows; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import sampled_ids

PER_LABEL = 1000
HALF = 1 << 12  # hashed features of words, and as many of characters
THRESHOLD = 0.1
MIN_WORDS, MAX_REPEAT_PERCENT, WINDOW = 20, 30, 8
SPACES, SYMBOLS = " \t\n\x0b\x0c\r", "#*$%&|<>"
#: Characters hashed at a time, and how many make an n-gram.
PIECE, GRAM = 1 << 20, 5
_MIX = np.uint64(0x9E3779B97F4A7C15)

COUNTS = "n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long"


def _hash_words(words: list[bytes]) -> np.ndarray:
    """64-bit hashes, the same in every process."""
    known: dict[bytes, int] = {}
    out = np.empty(len(words), np.uint64)
    for i, w in enumerate(words):
        h = known.get(w)
        if h is None:
            h = known[w] = (int.from_bytes(w, "little") * 0x9E3779B97F4A7C15 + len(w)) % 0xFFFFFFFFFFFFFFC5
        out[i] = h
    return out


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(31))) * _MIX
    return x ^ (x >> np.uint64(29))


def repeated_words(h: np.ndarray, window: int = WINDOW) -> int:
    """Words that lie in a window of so many words found twice or more in the text."""
    n = len(h) - window + 1
    if n < 2:
        return 0
    roll = np.zeros(n, np.uint64)
    for k in range(window):
        roll = _mixed(roll) + h[k : k + n]
    order = np.argsort(roll, kind="stable")
    same = roll[order][1:] == roll[order][:-1]
    if not same.any():
        return 0
    again = np.zeros(n, bool)
    again[order[1:][same]] = True
    again[order[:-1][same]] = True
    edge = np.zeros(len(h) + 1, np.int64)
    at = np.flatnonzero(again)
    np.add.at(edge, at, 1)
    np.add.at(edge, at + window, -1)
    return int((np.cumsum(edge)[:-1] > 0).sum())


def statistics(text: str | None) -> tuple[tuple[int, int, int, int, int], np.ndarray, str]:
    """The five counts of a text, its words' hashes and the text."""
    text = text or ""
    words = text.encode("utf-8", "surrogatepass").split()  # of bytes: at ASCII white space only
    h = _hash_words(words)
    if not words:
        return (0, 0, 0, 0, 0), h, text
    lines = [x for x in text.split("\n") if x.strip(SPACES)]
    chars = len(text) - sum(map(text.count, SPACES))
    return (len(words), chars, sum(map(text.count, SYMBOLS)), len(lines) - len(set(lines)), repeated_words(h)), h, text


def cells(h: np.ndarray, text: str) -> Iterator[np.ndarray]:
    """The hashed features' cells, with repeats: word one- and two-grams, then character n-grams in pieces."""
    mask = np.uint64(HALF - 1)
    one = _mixed(h)
    yield (one >> np.uint64(40) & mask).astype(np.int64)
    if len(h) > 1:
        yield (_mixed(one[:-1] * np.uint64(3) + one[1:]) >> np.uint64(40) & mask).astype(np.int64)
    for start in range(0, len(text), PIECE):
        points = np.frombuffer(text[start : start + PIECE + GRAM - 1].encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)
        n = len(points) - GRAM + 1
        if n > 0:
            code = points[:n]
            for k in range(1, GRAM):
                code = code * _MIX + points[k : k + n]
            yield (_mixed(code) >> np.uint64(52) & mask).astype(np.int64) + HALF


@dataclass
class Model:
    weights: np.ndarray
    bias: float
    slope: float = 1.0
    offset: float = 0.0

    def probability(self, h: np.ndarray, text: str) -> float:
        total = {0: [0.0, 0], 1: [0.0, 0]}
        for c in cells(h, text):
            if len(c):
                part = total[int(c[0] >= HALF)]
                part[0] += float(self.weights[c].sum(dtype=np.float64))
                part[1] += len(c)
        value = self.bias + sum(s / n for s, n in total.values() if n)
        return float(1 / (1 + np.exp(-np.clip(self.slope * value + self.offset, -40, 40))))


def features(h: np.ndarray, text: str) -> np.ndarray:
    """Relative frequencies of word cells and of character cells."""
    counts = np.zeros(2 * HALF)
    for c in cells(h, text):
        counts += np.bincount(c, minlength=2 * HALF)
    for half in (counts[:HALF], counts[HALF:]):
        half /= max(half.sum(), 1)
    return counts.astype(np.float32)


def _descend(x: np.ndarray, y: np.ndarray, weight: np.ndarray, l2: float, steps: int, rate: float) -> tuple[np.ndarray, float]:
    """Logistic regression by full-batch Adam."""
    w, b = np.zeros(x.shape[1], np.float64), 0.0
    m, v = np.zeros(x.shape[1] + 1), np.zeros(x.shape[1] + 1)
    for t in range(1, steps + 1):
        p = 1 / (1 + np.exp(-np.clip(x @ w.astype(x.dtype) + b, -40, 40)))
        e = weight * (p - y)
        g = np.append(x.T @ e.astype(x.dtype) + l2 * w, e.sum())
        m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
        step = rate * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.999**t)) + 1e-9)
        w, b = w - step[:-1], b - step[-1]
    return w, b


def fit(x: np.ndarray, y: np.ndarray, scale: float = 300.0) -> Model:
    """Learn from four rows of five, calibrate on the fifth; x is small, so it runs on the driver."""
    if len(y) == 0 or y.min() == y.max():
        return Model(np.zeros(2 * HALF, np.float32), 20.0 if len(y) == 0 or y[0] else -20.0)
    fold = np.arange(len(y)) % 5 == 4
    if y[fold].min(initial=1) == y[fold].max(initial=0) or y[~fold].min() == y[~fold].max():
        fold = np.zeros(len(y), bool)
    own = ~fold
    balance = np.where(y == 1, 0.5 / max((y[own] == 1).sum(), 1), 0.5 / max((y[own] == 0).sum(), 1))
    w, b = _descend(x[own] * np.float32(scale), y[own], balance[own], 1e-5, 300, 0.02)
    rest = fold if fold.any() else own
    value = (x[rest] * np.float32(scale)) @ w.astype(np.float32) + b
    even = np.where(y[rest] == 1, 0.5 / (y[rest] == 1).sum(), 0.5 / (y[rest] == 0).sum())
    platt, offset = _descend(value[:, None].astype(np.float64), y[rest], even, 1e-3, 400, 0.05)
    return Model((w * scale).astype(np.float32), float(b), float(max(platt[0], 1e-3)), float(offset))


def training_set(docs: DataFrame, labels: DataFrame, per_label: int = PER_LABEL) -> tuple[np.ndarray, np.ndarray]:
    """Features and labels of the sample: at most per_label ids a label, the lowest by id hash."""
    known = labels.filter(F.col("doc_id").isNotNull() & F.col("quality").isin(0, 1)).groupBy("doc_id").agg(F.max("quality").alias("quality"))
    ids = sampled_ids(known, "quality", per_label)
    if not ids:
        return np.zeros((0, 2 * HALF), np.float32), np.zeros(0)
    few = docs.sparkSession.createDataFrame([(i, q) for q, i in ids], known.schema)

    def vectors(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for rows in batches:
            out = [features(*statistics(t)[1:]).tobytes() for t in rows["text"]]
            yield pd.DataFrame({"place": rows["place"], "quality": rows["quality"], "x": out})

    chosen = docs.select("doc_id", "text").join(F.broadcast(few), "doc_id")  # at most per_label ids of each label
    one = chosen.groupBy("doc_id", "quality").agg(F.min("text").alias("text"))  # of a repeated id, one text
    placed = one.select(F.xxhash64("doc_id").alias("place"), F.col("quality").cast("int").alias("quality"), "text")
    rows = sorted(placed.mapInPandas(vectors, "place long, quality int, x binary").collect(), key=lambda r: (r["place"], r["quality"], bytes(r["x"])))
    x = np.frombuffer(b"".join(bytes(r["x"]) for r in rows), np.float32).reshape(len(rows), 2 * HALF)
    return x, np.array([r["quality"] for r in rows], np.float64)


def scorer(spark, model: Model):
    """A pandas UDF from text to its counts and the probability that it is of good quality."""
    shared = spark.sparkContext.broadcast(model)

    @F.pandas_udf(f"{COUNTS}, probability double")
    def score(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        m = shared.value
        names = [c.split()[0] for c in COUNTS.split(", ")]
        for texts in batches:
            rows = []
            for text in texts:
                counts, h, whole = statistics(text)
                rows.append((*counts, m.probability(h, whole)))
            yield pd.DataFrame(rows, columns=[*names, "probability"])

    return score


def judge(docs: DataFrame, labels: DataFrame, model: Model | None = None, threshold: float = THRESHOLD) -> DataFrame:
    """doc_id, the counts, base_failed, kept and probability of every row."""
    model = model or fit(*training_set(docs, labels))
    score = scorer(docs.sparkSession, model)
    rows = docs.select("doc_id", score("text").alias("s")).select("doc_id", "s.*")
    failed = (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEAT_PERCENT * F.col("n_words"))
    return rows.withColumn("base_failed", failed).select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed",
        (~F.col("base_failed") & (F.col("probability") >= threshold)).alias("kept"), "probability",
    )
