"""Token counts by a two-tier lookup on the map side.

A byte-level BPE cuts text into pre-tokens and merges within each, so a text's token count is
the sum of its pre-tokens' lengths. Tier one is a broadcast table of frequent pre-tokens and
their lengths: the vocabulary's own entries, which are the byte sequences that were frequent
enough to be merged, in that order, up to `table_size`. Its size is bounded by the vocabulary
whatever the corpus is, and no pass over the texts is needed to make it. Tier two encodes what
the table lacks and keeps the length in the worker's cache, where a corpus's own frequent
pre-tokens stay. There is no exchange at all; results depend on neither tier.

In front of both a worker remembers whole words with their space: between two characters that
are not white space, a single space always begins a pre-token, so a text with single spaces is
the sum of its words, and only words that are new are cut by the tokenizer's pattern.

A special token's string inside a text is one token, as the tokenizer library has it by default.

Edge cases: a null text counts as an empty one (0 bytes, 0 tokens); a text of any length is
counted whole; ids pass through unread, so null and repeated ids are fine; an empty table gives
no rows; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType

TABLE_SIZE = 65_536
#: Entries in a generation of a worker's memory, and the longest string among them.
CACHE_SIZE, CACHED_LENGTH = 200_000, 32


def vocabulary_path(name: str = "byte_bpe_50k.json") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


class PreTokens:
    """Cuts texts as the tokenizer does, special strings apart."""

    def __init__(self, path: str):
        import public_tokenizers
        import regex
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        special = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.special = regex.compile("|".join(map(regex.escape, sorted(special, key=len, reverse=True)))) if special else None
        self.find = regex.compile(public_tokenizers.PATTERN).findall

    def plain_parts(self, text: str) -> list[str]:
        """The text between special strings; their number is one less."""
        return [text] if self.special is None or not self.special.search(text) else self.special.split(text)

    def length(self, pre_token: str) -> int:
        return len(self.tokenizer.encode(pre_token, add_special_tokens=False).ids)

    def frequent(self, size: int) -> dict[str, int]:
        """The first `size` vocabulary entries that are a pre-token by themselves, with their lengths."""
        ids = sorted(self.tokenizer.get_vocab(with_added_tokens=False).values())[:size]
        texts = dict.fromkeys(t for t in self.tokenizer.decode_batch([[i] for i in ids], skip_special_tokens=False) if "�" not in t and self.find(t) == [t])
        encoded = self.tokenizer.encode_batch(list(texts), add_special_tokens=False)
        return {t: len(e.ids) for t, e in zip(texts, encoded)}


class Memory:
    """Counts by string in two generations of at most `size` entries; what is asked for moves to the younger, so frequent strings stay."""

    def __init__(self, size: int):
        self.size, self.young, self.old = size, {}, {}

    def get(self, text: str) -> int | None:
        n = self.young.get(text)
        if n is None:
            n = self.old.get(text)
            if n is not None:
                self.keep(text, n)
        return n

    def keep(self, text: str, n: int) -> int:
        if len(text) <= CACHED_LENGTH:
            if len(self.young) >= self.size:
                self.young, self.old = {}, self.young
            self.young[text] = n
        return n


class Counter:
    """Counts texts with the table and a worker's own memory of words and pre-tokens."""

    def __init__(self, cutter: PreTokens, table: dict[str, int], cache_size: int):
        self.cutter, self.table = cutter, table
        self.lengths, self.words = Memory(cache_size), Memory(cache_size)

    def _pre_token(self, t: str) -> int:
        n = self.table.get(t)
        if n is None:
            n = self.lengths.get(t)
        return self.lengths.keep(t, self.cutter.length(t)) if n is None else n

    def _cut(self, text: str) -> int:
        return sum(map(self._pre_token, self.cutter.find(text)))

    def _part(self, text: str) -> int:
        words = text.split(" ")
        if len(words) == 1 or not words[0] or words[0][-1].isspace() or not words[-1] or words[-1][0].isspace():
            return self._cut(text)
        inner = words[1:-1]
        found = list(map(self.words.young.get, inner))
        if None in found:
            for i, n in enumerate(found):
                if n is None:
                    w = inner[i]
                    n = found[i] = self.words.get(w)
                    if n is not None:
                        continue
                    if not w or w[0].isspace() or w[-1].isspace():
                        return self._cut(text)  # white space beside a space goes by other rules
                    found[i] = self.words.keep(w, self._cut(" " + w))
        return self._cut(words[0]) + sum(found) + self._cut(" " + words[-1])

    def count(self, text: str) -> int:
        parts = self.cutter.plain_parts(text)
        return len(parts) - 1 + sum(map(self._part, parts))


#: One per worker process, by vocabulary.
_cutters: dict[str, PreTokens] = {}
_counters: dict[tuple[str, int, int], Counter] = {}


def _cutter(path: str) -> PreTokens:
    if path not in _cutters:
        _cutters[path] = PreTokens(path)
    return _cutters[path]


def counter(spark, path: str, table_size: int = TABLE_SIZE, cache_size: int = CACHE_SIZE):
    """A pandas UDF from text to its number of tokens. The broadcast table has at most table_size entries."""
    shared = spark.sparkContext.broadcast(_cutter(path).frequent(table_size))

    @F.pandas_udf(LongType())
    def n_tokens(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        key = (path, table_size, cache_size)
        if key not in _counters:
            _counters[key] = Counter(_cutter(path), shared.value, cache_size)
        count = _counters[key].count
        for texts in batches:
            yield pd.Series([count(t) if t else 0 for t in texts], dtype="int64")

    return n_tokens


def token_counts(docs: DataFrame, limit: int = 512, vocabulary: str | None = None, table_size: int = TABLE_SIZE) -> DataFrame:
    """doc_id, n_bytes, n_tokens and over_limit of every row."""
    count = counter(docs.sparkSession, vocabulary or vocabulary_path(), table_size)
    rows = docs.select("doc_id", F.coalesce(F.octet_length("text"), F.lit(0)).cast("bigint").alias("n_bytes"), count("text").alias("n_tokens"))
    return rows.withColumn("over_limit", F.col("n_tokens") > limit)
