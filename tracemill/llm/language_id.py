"""Language identification with string kernels.

The kernel of two texts is the number of n-grams (n = 1, 2, 3 blended) present in both, over the
root of the product of their numbers of n-grams; only presence counts, not frequency. Nyström's
method makes it cheap: a text is described by its kernel values to a few landmark texts, mapped
by the inverse root of the landmarks' own kernel matrix, and one-versus-rest ridge regression on
those features gives a value for each language. Scoring a batch is two matrix products: presence
by landmarks, then kernel values by languages.

Characters fall in `ALPHABET` classes: the landmarks' most frequent letters, one class for other
letters, one for everything else (which parts words). All n-grams that a landmark has count; there
are at most `ALPHABET` + `ALPHABET`^2 + `ALPHABET`^3, and products go over them in blocks of columns.

The training rows are a bounded sample: of each language at most `PER_LANGUAGE` ids, the ones of
the lowest id hashes, and at most `SAMPLE` rows in all (one a language where there are more
languages). Tasks read their texts whole and send which n-grams they have, some kilobytes a text
however long it is. Landmarks are at most `MAX_LANDMARKS`; of more languages than that the first by
code point have one, and all are still told apart by their kernel values.

Edge cases: of languages with equal values the first by code point wins; a text that is null or has no letter gets `und` and score 0; with no training row
at all every text does. Null ids are not held out and never train. Repeated rows and ids are
each answered; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import zlib
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import sampled_ids, written

PER_LANGUAGE, SAMPLE = 300, 6_000
LANDMARKS_PER_LANGUAGE = 48
#: Landmarks of all languages together; the broadcast matrix has a bit for each of their n-grams, 32 MB at most.
MAX_LANDMARKS = 960
ALPHABET = 64
#: All n-grams of one, two and three classes.
CODES = ALPHABET + ALPHABET**2 + ALPHABET**3
OFFSETS = (0, ALPHABET, ALPHABET + ALPHABET**2)
RIDGE = 1e-2
UNKNOWN = "und"
#: Characters handled at a time, rows and cells of a presence matrix, and columns that are multiplied at a time.
PIECE, BLOCK, CELLS, COLUMNS = 1 << 20, 128, 1 << 22, 1 << 15


@dataclass
class Kernel:
    """Landmarks as presence vectors over their own n-grams."""

    classes: np.ndarray  # of every code point
    columns: list[np.ndarray]  # of every n-gram of one, two, three classes; -1 for those no landmark has
    width: int
    landmarks: np.ndarray | None = None  # landmarks x width, packed bits
    piece: int = PIECE

    def presence(self, texts: list[str]) -> np.ndarray:
        """texts x width, 1 where the text has the n-gram.

        Long texts go in pieces that overlap by two characters; only the text's own ends are padded, so pieces add no n-gram.
        """
        out = np.zeros((len(texts), self.width), np.float32)
        flat = out.reshape(-1)
        for row, text in enumerate(texts):
            for start in range(0, len(text), self.piece):
                points = np.frombuffer(text[start : start + self.piece + 2].encode("utf-32-le", "surrogatepass"), np.uint32)
                ends = start + self.piece + 2 >= len(text)
                c = np.concatenate(([0] * (start == 0), self.classes[points], [0] * ends)).astype(np.int64)
                code = c
                for n, columns in enumerate(self.columns):
                    if n:
                        code = code[:-1] * ALPHABET + c[n:]
                    found = columns[code]
                    flat[row * self.width + found[found >= 0]] = 1
        return out

    def marks(self, lo: int) -> np.ndarray:
        """COLUMNS columns of the landmarks from lo (a multiple of 8), turned; kept where there are no others."""
        found = self.__dict__.get("_marks")
        if found is None:
            found = np.unpackbits(self.landmarks[:, lo // 8 : (lo + COLUMNS) // 8], axis=1, count=min(COLUMNS, self.width - lo)).astype(np.float32).T
            if self.width <= COLUMNS:
                self.__dict__["_marks"] = found
        return found

    def kernel_values(self, own: np.ndarray) -> np.ndarray:
        """rows x landmarks, from rows x width of presence."""
        product, sizes = np.zeros((len(own), len(self.landmarks)), np.float32), np.zeros(len(self.landmarks), np.float32)
        for lo in range(0, self.width, COLUMNS):
            marks = self.marks(lo)
            product += own[:, lo : lo + COLUMNS] @ marks
            sizes += marks.sum(0)
        return product / np.sqrt(np.maximum(own.sum(1), 1)[:, None] * np.maximum(sizes, 1)[None])

    def rows_at_once(self) -> int:
        return max(1, min(BLOCK, CELLS // max(1, self.width)))

    def values(self, texts: list[str]) -> np.ndarray:
        """texts x landmarks."""
        step = self.rows_at_once()
        parts = [self.kernel_values(self.presence(texts[i : i + step])) for i in range(0, len(texts), step)]
        return np.concatenate(parts) if parts else np.zeros((0, len(self.landmarks)), np.float32)


@dataclass
class Model:
    kernel: Kernel | None
    weights: np.ndarray | None  # landmarks x languages
    languages: list[str]

    def scores(self, texts: list[str]) -> np.ndarray:
        return self.kernel.values(texts) @ self.weights


def _letters(text: str) -> str:
    return "".join(c for c in text.lower() if c.isalpha())


def classes_of(counts: Counter) -> np.ndarray:
    """The class of every code point, from the landmarks' letter counts."""
    frequent = [c for c, _ in sorted(counts.items(), key=lambda x: (-x[1], x[0]))[: ALPHABET - 2]]
    classes = np.zeros(0x110000, np.uint8)
    for point in range(0x110000):
        if not 0xD800 <= point < 0xE000 and chr(point).isalpha():
            classes[point] = ALPHABET - 1
    for k, c in enumerate(frequent, 1):
        classes[ord(c)] = k
        if len(c.upper()) == 1:
            classes[ord(c.upper())] = k
    return classes


def every_code(classes: np.ndarray) -> Kernel:
    """A kernel without landmarks that tells all n-grams."""
    return Kernel(classes, [np.arange(base, base + ALPHABET**n) for base, n in zip(OFFSETS, (1, 2, 3))], CODES)


def landmark_places(langs: list[str], per_language: int = LANDMARKS_PER_LANGUAGE) -> list[int]:
    """The rows that are landmarks: the first of each language, by language."""
    languages = sorted(set(langs))[:MAX_LANDMARKS]
    each = max(1, min(per_language, MAX_LANDMARKS // max(1, len(languages))))
    at = {lang: [i for i, x in enumerate(langs) if x == lang][:each] for lang in languages}
    return [i for lang in languages for i in at[lang]]


def solve(classes: np.ndarray, langs: list[str], packed: np.ndarray, places: list[int], ridge: float = RIDGE) -> Model:
    """A model from the packed n-gram bits (rows x CODES / 8) of the sample's texts; they are few, so it runs on the driver."""
    held = np.zeros(CODES, np.int32)  # landmarks that have the n-gram
    for i in places:
        held += np.unpackbits(packed[i], count=CODES)
    held[list(OFFSETS)] = 0  # white space and signs alone say nothing
    chosen = np.flatnonzero(held)
    number = np.full(CODES, -1, np.int32)
    number[chosen] = np.arange(len(chosen))
    own = lambda rows: np.stack([np.unpackbits(packed[i], count=CODES)[chosen] for i in rows])
    marks = np.stack([np.packbits(np.unpackbits(packed[i], count=CODES)[chosen]) for i in places])
    kernel = Kernel(classes, [number[base : base + ALPHABET**n] for base, n in zip(OFFSETS, (1, 2, 3))], len(chosen), marks)
    step = kernel.rows_at_once()
    k = np.concatenate([kernel.kernel_values(own(range(i, min(i + step, len(langs)))).astype(np.float32)) for i in range(0, len(langs), step)])
    value, vector = np.linalg.eigh(k[places].astype(np.float64))
    keep = value > 1e-6 * value[-1]
    root = vector[:, keep] / np.sqrt(value[keep])  # landmarks x rank
    features = k @ root
    languages = sorted(set(langs))
    sizes = Counter(langs)
    goal = np.where(np.array(langs)[:, None] == np.array(languages)[None], 1.0, -1.0)
    scale = np.array([len(langs) / (len(languages) * sizes[lang]) for lang in langs])[:, None]
    gram = features.T @ (scale * features) + ridge * len(langs) * np.eye(features.shape[1]) / features.shape[1]
    return Model(kernel, (root @ np.linalg.solve(gram, features.T @ (scale * goal))).astype(np.float32), languages)


def fit(rows: list[tuple[str, str]], landmarks_per_language: int = LANDMARKS_PER_LANGUAGE, ridge: float = RIDGE) -> Model:
    """A model from (language, text) rows in memory."""
    if not rows:
        return Model(None, None, [])
    langs = [lang for lang, _ in rows]
    places = landmark_places(langs, landmarks_per_language)
    probe = every_code(classes_of(Counter(c for i in places for c in _letters(rows[i][1]))))
    return solve(probe.classes, langs, np.stack([np.packbits(probe.presence([t])[0] > 0) for _, t in rows]), places, ridge)


def held_out(id_col: str = "doc_id") -> Column:
    return F.coalesce(F.crc32(F.col(id_col).cast("string")) % 4 == 2, F.lit(False))


def trained(docs: DataFrame, per_language: int = PER_LANGUAGE, landmarks_per_language: int = LANDMARKS_PER_LANGUAGE) -> Model:
    """A model from the sample of docs: its texts stay with the tasks, which send letter counts of the landmarks and n-gram bits of all rows."""
    known = docs.filter(~held_out() & F.col("doc_id").isNotNull() & F.col("lang").isNotNull())
    n_languages = known.select("lang").distinct().count()
    usable = known.filter(F.col("text").rlike(r"\p{L}"))
    few = sampled_ids(usable, "lang", max(1, min(per_language, SAMPLE // max(1, n_languages))))
    if not few:
        return Model(None, None, [])
    langs = [lang for lang, _ in few]
    places = landmark_places(langs, landmarks_per_language)
    marked = set(places)
    schema = usable.select("lang", "doc_id").schema.add("place", "integer").add("mark", "boolean")
    wanted = docs.sparkSession.createDataFrame([(*row, k, k in marked) for k, row in enumerate(few)], schema)
    chosen = usable.select("lang", "doc_id", "text").join(F.broadcast(wanted), ["lang", "doc_id"])  # at most SAMPLE rows, or one a language
    texts = written(chosen.groupBy("place", "mark").agg(F.min("text").alias("text")))  # of a repeated id, one text

    def letters(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for rows in batches:
            n = Counter(c for t in rows["text"] for c in _letters(t))
            yield pd.DataFrame({"letter": list(n), "n": list(n.values())})

    counted = texts.filter("mark").select("text").mapInPandas(letters, "letter string, n long").groupBy("letter").agg(F.sum("n").alias("n")).collect()  # a row a letter
    classes = classes_of(Counter({r["letter"]: r["n"] for r in counted}))
    shared = docs.sparkSession.sparkContext.broadcast(classes)

    def bits(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        probe = every_code(shared.value)
        for rows in batches:
            yield pd.DataFrame({"place": rows["place"], "bits": [zlib.compress(np.packbits(probe.presence([t])[0] > 0).tobytes(), 1) for t in rows["text"]]})

    sent = {r["place"]: bytes(r["bits"]) for r in texts.select("place", "text").mapInPandas(bits, "place int, bits binary").collect()}
    packed = np.stack([np.frombuffer(zlib.decompress(sent[k]), np.uint8) for k in range(len(few))])
    return solve(classes, langs, packed, places)


def predictor(spark, model: Model):
    """A pandas UDF from text to (lang_pred, score)."""
    shared = spark.sparkContext.broadcast(model)

    @F.pandas_udf("lang_pred string, score double")
    def predict(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        m = shared.value
        for texts in batches:
            names = np.full(len(texts), UNKNOWN, object)
            scores = np.zeros(len(texts))
            known = [i for i, t in enumerate(texts) if t is not None and m.languages]
            step = m.kernel.rows_at_once() if known else BLOCK
            for start in range(0, len(known), step):
                rows = known[start : start + step]
                values = m.scores([texts.iat[i] for i in rows])
                best = values.argmax(1)
                names[rows] = np.array(m.languages, object)[best]
                scores[rows] = np.clip((values[np.arange(len(rows)), best].astype(np.float64) + 1) / 2, 0, 1)
            yield pd.DataFrame({"lang_pred": names, "score": scores})

    return predict


def _predicted(docs: DataFrame, model: Model | None) -> DataFrame:
    predict = predictor(docs.sparkSession, model or trained(docs))
    return docs.withColumn("_p", predict(F.when(F.col("text").rlike(r"\p{L}"), F.col("text"))))


def identify(docs: DataFrame, model: Model | None = None) -> DataFrame:
    """docs with held_out, lang_pred and score, in place of columns of these names."""
    own = [c for c in docs.columns if c not in ("held_out", "lang_pred", "score")]
    return _predicted(docs, model).select(*own, held_out().alias("held_out"), F.col("_p.lang_pred").alias("lang_pred"), F.col("_p.score").alias("score"))


def accepted(docs: DataFrame, min_score: float, model: Model | None = None) -> DataFrame:
    """The rows of docs, as they are, that have a language and at least min_score for it."""
    return _predicted(docs, model).filter((F.col("_p.lang_pred") != UNKNOWN) & (F.col("_p.score") >= min_score)).select(*docs.columns)
