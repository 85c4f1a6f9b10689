"""Alignment of two tokenizers' tokens over the corpus, with what token pairs are linked how often.

Python tokenizes and cuts up what is tokenized. A worker cuts a text at single spaces between two
characters that are not white space: there a token of either tokenizer begins whatever stands around.
New pieces are tokenized and aligned in numpy, all at once, and remembered. Blocks of documents come
back: the distinct pieces of a block with the text and the links of their groups, and for every
document the numbers of its pieces. All else are higher-order functions and joins.

1. The pieces' bytes lie one after the other, and both tokenizers' tokens end at offsets in them.
   Where one side's token ends at an offset that is marked by the other side, it ends a group; so a
   piece costs a look a token, however long it is.
2. Every A token of a group links to every B token of it. An id pair counts once a document; the
   counts are summed before they are shuffled. Pairs are broadcast to the links up to
   `BROADCAST_PAIRS` rows, else joined, where Spark splits hot pairs.

Edge cases: texts that are null, empty, or whose tokens' bytes differ from a space and the text
(with U+2581 in them, for one) have no tokens, zeros, and an empty string for the hash; a long text
is one document, whole; a null or repeated id is a document of its own each time; an empty table
gives no rows; other columns are ignored.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, IntegerType, LongType, StringType, StructType

from .common import written

#: Up to so many id pairs with their counts (some 40 MB) go to every executor.
BROADCAST_PAIRS = 1 << 20
#: Characters of a block's texts, and links (one a token or more) that a worker remembers.
BLOCK, REMEMBERED = 1 << 20, 1 << 19
#: Blocks are large rows, and a reader takes up to 4096 rows of a row group at once: so many are one.
ROW_GROUP = {"parquet.block.row.count.limit": "8"}
#: Links are packed as the A id times this plus the B id.
PACK = 1 << 31
#: Pieces whose bytes are compared at once.
STRETCH = 1024
#: Longer pieces go to the tokenizer library by themselves.
LONG_PIECE = 1000

_cut = re.compile(r"(?<=\S) (?=\S)").split


def vocabulary_paths() -> tuple[str, str]:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")


def byte_letters() -> dict[str, int]:
    """The byte of each letter of a byte-level vocabulary: visible Latin-1 characters stand for themselves, the others follow from 256 on."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    hidden = [b for b in range(256) if b not in shown]
    return {chr(b): b for b in shown} | {chr(256 + i): b for i, b in enumerate(hidden)}


class ByteLevel:
    """Ids of a byte-level BPE vocabulary file, special tokens' strings being plain text.

    Where the file's merges are in the order of their ids, short pieces go through a faster encoder
    of the same vocabulary; ids are the same.
    """

    def __init__(self, path: str):
        import json

        import public_tokenizers
        import tiktoken

        self.path, self._library = path, None
        with open(path, encoding="utf-8") as f:
            told = json.load(f)
        letters = byte_letters()
        vocabulary = told["model"]["vocab"] | {t["content"]: t["id"] for t in told.get("added_tokens") or []}
        self.bytes = {i: bytes(letters[c] for c in t) if all(c in letters for c in t) else t.encode() for t, i in vocabulary.items()}
        self.sizes = np.zeros(max(self.bytes) + 1, np.int32)
        self.sizes[list(self.bytes)] = [len(x) for x in self.bytes.values()]
        pairs = [m.split(" ") if isinstance(m, str) else m for m in told["model"].get("merges", [])]
        merged = [vocabulary[x + y] for x, y in pairs]
        cutting = told.get("pre_tokenizer") or {}
        plain = merged == sorted(set(merged)) and told.get("normalizer") is None and cutting.get("type") == "ByteLevel" and not cutting.get("add_prefix_space") and cutting.get("use_regex", True)
        ranks = {self.bytes[i]: i for t, i in told["model"]["vocab"].items() if all(c in letters for c in t)}
        self.quick = tiktoken.Encoding("pieces", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={}) if plain else None

    @property
    def library(self):
        """The file's own library, loaded where it is needed."""
        if self._library is None:
            from tokenizers import Tokenizer

            self._library = Tokenizer.from_file(self.path)
            self._library.encode_special_tokens = True
        return self._library

    def ids(self, pieces: list[str], plain: int, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all pieces, each with a space before it, and how many each has.

        The first `plain` ones have no white space at an end, so a token begins at each space that is put between
        them: they are encoded in one go and told apart by their bytes (lengths, the spaces included).
        """
        if self.quick is None:
            rest, joined = [e.ids for e in self.library.encode_batch([f" {p}" for p in pieces], add_special_tokens=False)], np.empty(0, np.int32)
            plain = 0
        else:
            joined = np.array(self.quick.encode_ordinary(" " + " ".join(pieces[:plain])) if plain else [], np.int32)
            encode = lambda p: self.quick.encode_ordinary(p) if len(p) <= LONG_PIECE else self.library.encode(p, add_special_tokens=False).ids
            rest = [encode(f" {p}") for p in pieces[plain:]]
        last = np.searchsorted(np.cumsum(self.sizes[joined], dtype=np.int64), np.cumsum(lengths[:plain], dtype=np.int64))
        counts = np.concatenate([np.diff(last, prepend=-1), np.fromiter(map(len, rest), np.int64, len(rest))])
        return np.concatenate([joined, np.fromiter(chain.from_iterable(rest), np.int32)]), counts.astype(np.int64)


def aligned(ids: list[np.ndarray], counts: list[np.ndarray], sizes: list[np.ndarray]) -> tuple[np.ndarray, pa.Array, pa.Array]:
    """groups (their number), text (ids by group) and links of every piece.

    ids and sizes are those of all pieces' tokens, by side, and counts the tokens a piece; both sides give the same bytes.
    """
    ends = [np.cumsum(s, dtype=np.int64) for s in sizes]
    marked = np.zeros((2, max([0, *(e[-1] for e in ends if len(e))]) + 1), bool)
    for side, e in enumerate(ends):
        marked[side, e] = True
    cuts = [marked[1 - side, e] for side, e in enumerate(ends)]
    group = [np.cumsum(c) - c for c in cuts]
    tokens = [np.bincount(g, minlength=c.sum()) for g, c in zip(group, cuts)]  # of a side, by group
    first = [np.cumsum(n) - n for n in tokens]
    pieces_ends = [np.concatenate([[0], np.cumsum(n)]) for n in counts]

    per_token = tokens[1][group[0]]
    linked = np.concatenate([[0], np.cumsum(per_token)])
    a = np.repeat(np.arange(len(ids[0])), per_token)
    b = np.arange(linked[-1]) - np.repeat(linked[:-1] - first[1][group[0]], per_token)
    links = ids[0][a] * np.int64(PACK) + ids[1][b]

    # A row a token, in the order of the text: its decimals, and what follows it.
    decimals = np.arange(max([0, *(i.max() for i in ids if len(i))]) + 1).astype("S")
    decimals = decimals.view(np.uint8).reshape(len(decimals), -1)
    letters = np.zeros((len(ids[0]) + len(ids[1]), decimals.shape[1] + 1), np.uint8)
    for side, after in enumerate("|;"):
        place = np.arange(len(ids[side])) + (first[1][group[0]] if side == 0 else (first[0] + tokens[0])[group[1]])
        letters[place, :-1] = decimals[ids[side]]
        letters[place, -1] = np.where(cuts[side], ord(after), ord(","))
    text_ends = pieces_ends[0] + pieces_ends[1]
    letters[text_ends[1:][np.diff(text_ends) > 0] - 1, -1] = 0
    shown = letters != 0
    written_to = np.concatenate([[0], np.cumsum(shown.sum(axis=1))])[text_ends]
    text = pa.StringArray.from_buffers(len(counts[0]), pa.py_buffer(written_to.astype(np.int32)), pa.py_buffer(letters[shown]))
    groups = np.diff(np.concatenate([[0], np.cumsum(cuts[0])])[pieces_ends[0]])
    return groups, text, pa.ListArray.from_arrays(pa.array(linked[pieces_ends[0]].astype(np.int32)), pa.array(links, pa.int64()))


class Tokenizers:
    """Both tokenizers, and the aligned tokens of the pieces a worker has met."""

    def __init__(self, path_a: str, path_b: str):
        import sentencepiece

        self.a = ByteLevel(path_a)
        self.b = sentencepiece.SentencePieceProcessor(model_file=path_b)
        self.bytes_b = [self._piece(i) for i in range(self.b.get_piece_size())]
        self.sizes_b = np.array([len(x) for x in self.bytes_b], np.int32)
        self.forget()

    def _piece(self, i: int) -> bytes:
        piece = self.b.id_to_piece(i)
        return bytes([int(piece[3:5], 16)]) if self.b.is_byte(i) else piece.replace("▁", " ").encode()

    def forget(self) -> None:
        self.known: dict[str, int] = {}
        #: Of every piece: A tokens, B tokens and groups; text and links.
        self.counts = [np.empty(0, np.int64)] * 3
        self.words = [pa.array([], pa.string()), pa.array([], pa.list_(pa.int64()))]
        #: 1: tokens that do not give the piece; 2: white space at an end or nothing, so that a cut there may be wrong.
        self.marks = np.empty(0, np.uint8)

    def _wrong(self, tokens: list[list[int]], lengths: np.ndarray, encoded: list[bytes]) -> np.ndarray:
        """Whether B's tokens do not give a piece; pieces are compared in stretches and singly only in a stretch that differs."""
        want = np.fromiter(map(len, encoded), np.int64, len(encoded)) + 1
        wrong = lengths != want
        for lo in range(0, len(tokens), STRETCH):
            part = tokens[lo : lo + STRETCH]
            if wrong[lo : lo + STRETCH].any() or b"".join(map(self.bytes_b.__getitem__, chain.from_iterable(part))) != b" " + b" ".join(encoded[lo : lo + STRETCH]):
                wrong[lo : lo + STRETCH] = [b"".join([self.bytes_b[i] for i in t]) != b" " + e for t, e in zip(part, encoded[lo : lo + STRETCH])]
        return wrong

    def _meet(self, pieces: list[str]) -> None:
        odd = [not p or p[0].isspace() or p[-1].isspace() for p in pieces]
        first = [p for p, o in zip(pieces, odd) if not o and len(p) <= LONG_PIECE]
        rest = [p for p, o in zip(pieces, odd) if o or len(p) > LONG_PIECE]
        pieces = first + rest
        encoded = [p.encode() for p in pieces]
        lengths = np.fromiter(map(len, encoded), np.int64, len(encoded)) + 1
        marks = np.zeros(len(pieces), np.uint8)
        marks[len(first) :] = [2 if not p or p[0].isspace() or p[-1].isspace() else 0 for p in rest]
        tokens = self.b.encode(pieces, num_threads=1)
        counts = np.fromiter(map(len, tokens), np.int64, len(tokens))
        both = self.a.ids(pieces, len(first), lengths), (np.fromiter(chain.from_iterable(tokens), np.int32, counts.sum()), counts)
        of_a, of_b = both[0][1], both[1][1]
        sizes = [self.a.sizes[both[0][0]], self.sizes_b[both[1][0]]]
        ends = np.cumsum(of_b)
        total = np.concatenate([[0], np.cumsum(sizes[1], dtype=np.int64)])
        marks |= self._wrong(tokens, total[ends] - total[ends - of_b], encoded).astype(np.uint8)
        if not self.a.quick:
            ids, ends = both[0][0], np.cumsum(of_a)
            whole = [b"".join(map(self.a.bytes.__getitem__, ids[e - n : e].tolist())) for e, n in zip(ends, of_a)]
            marks |= np.array([x != b" " + e for x, e in zip(whole, encoded)], np.uint8)
        right = marks & 1 == 0
        kept = [np.repeat(right, n) for n in (of_a, of_b)]
        groups, *words = aligned([ids[k] for (ids, _), k in zip(both, kept)], [of_a * right, of_b * right], [s[k] for s, k in zip(sizes, kept)])
        self.counts = [np.concatenate(x) for x in zip(self.counts, (of_a, of_b, groups))]
        self.words = [pa.concat_arrays(x) for x in zip(self.words, words)]
        self.known.update(zip(pieces, range(len(self.marks), len(self.marks) + len(pieces))))
        self.marks = np.concatenate([self.marks, marks])

    def _numbers(self, cut: list[list[str]]) -> np.ndarray:
        new = set(chain.from_iterable(cut)).difference(self.known)
        if new:
            self._meet(list(new))
        return np.fromiter(map(self.known.__getitem__, chain.from_iterable(cut)), np.int64, sum(map(len, cut)))

    def block(self, texts: list[str | None]) -> tuple[list[np.ndarray], list[np.ndarray], list[pa.Array]]:
        """For every text the numbers of its pieces, and of its A tokens, B tokens and groups; and text and links of the pieces."""
        if len(self.words[1].values) > REMEMBERED:
            self.forget()
        cut = [t.split(" ") if t else [] for t in texts]
        at = self._numbers(cut)
        owner = np.repeat(np.arange(len(texts)), [len(p) for p in cut])
        odd = np.unique(owner[self.marks[at] > 1])
        if len(odd):  # white space beside a space: these spaces are no cuts
            for i in odd:
                cut[i] = _cut(texts[i])
            at = self._numbers(cut)
            owner = np.repeat(np.arange(len(texts)), [len(p) for p in cut])
        bad = np.bincount(owner, self.marks[at] & 1, len(texts)) > 0
        at, owner = at[~bad[owner]], owner[~bad[owner]]
        pieces, numbers = np.unique(at, return_inverse=True)
        per_text = np.split(numbers.astype(np.int32), np.cumsum(np.bincount(owner, minlength=len(texts)))[:-1]) if len(texts) else []
        counts = [np.bincount(owner, n[at], len(texts)).astype(np.int64) for n in self.counts]
        return per_text, counts, [w.take(pa.array(pieces)) for w in self.words]


#: One per worker process, by vocabularies.
_tokenizers: dict[tuple[str, str], Tokenizers] = {}


def _ranges(sizes: list[int]) -> Iterator[tuple[int, int]]:
    """Ranges of rows of at most BLOCK characters, or of one row."""
    start = total = 0
    for i, n in enumerate(sizes):
        if total + n > BLOCK and i > start:
            yield start, i
            start, total = i, 0
        total += n
    if start < len(sizes):
        yield start, len(sizes)


def _one(values: pa.Array) -> pa.Array:
    """An array of one list, which has all values."""
    return pa.ListArray.from_arrays(pa.array([0, len(values)], pa.int32()), values)


def tokenized(docs: DataFrame, path_a: str, path_b: str) -> DataFrame:
    """Rows of docs (doc_id, row, n_a, n_b, n_groups, pieces: numbers of words), and text and links of the words."""
    rows = docs.select("doc_id", "text")
    doc = StructType([rows.schema["doc_id"]])
    for name in ("row", "n_a", "n_b", "n_groups"):
        doc = doc.add(name, LongType())
    schema = StructType().add("docs", ArrayType(doc.add("pieces", ArrayType(IntegerType(), False)), False))
    schema = schema.add("text", ArrayType(StringType(), False)).add("links", ArrayType(ArrayType(LongType(), False), False))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if (path_a, path_b) not in _tokenizers:
            _tokenizers[path_a, path_b] = Tokenizers(path_a, path_b)
        both = _tokenizers[path_a, path_b]
        row = TaskContext.get().partitionId() << 40
        for batch in batches:
            sizes = [s or 0 for s in pa.compute.utf8_length(batch.column("text")).to_pylist()]
            for lo, hi in _ranges(sizes):
                part = batch.slice(lo, hi - lo)
                per_text, counts, words = both.block(part.column("text").to_pylist())
                ends = np.cumsum([0, *map(len, per_text)], dtype=np.int32)
                pieces = pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate([np.empty(0, np.int32), *per_text])))
                named = pa.StructArray.from_arrays([part.column("doc_id"), pa.array(np.arange(row, row + hi - lo)), *map(pa.array, counts), pieces], names=["doc_id", "row", "n_a", "n_b", "n_groups", "pieces"])
                out = pa.RecordBatch.from_arrays([_one(named), *map(_one, words)], names=["docs", "text", "links"])
                del part, per_text, counts, words, pieces, named  # one block at a time
                yield out
                del out
                pa.default_memory_pool().release_unused()
                row += hi - lo

    return rows.mapInArrow(run, schema)


def blocks(docs: DataFrame, path_a: str, path_b: str) -> DataFrame:
    """A row a block: docs (doc_id, row, n_a, n_b, n_groups, groups_sha256, pieces) and the links of the pieces."""

    def hashed(d: Column) -> Column:
        text = F.array_join(F.transform(d["pieces"], lambda p: F.get("text", p)), ";")
        digest = F.when(F.size(d["pieces"]) > 0, F.sha2(text, 256)).otherwise("").alias("groups_sha256")
        return F.struct(*[d[n].alias(n) for n in ("doc_id", "row", "n_a", "n_b", "n_groups")], digest, d["pieces"].alias("pieces"))

    return tokenized(docs, path_a, path_b).select(F.transform("docs", hashed).alias("docs"), "links")


def pair_counts(found: DataFrame) -> DataFrame:
    """pair, count (documents that have it linked) and best (whether no pair of its A id has more)."""
    of_doc = lambda d: F.flatten(F.transform(F.array_distinct(d["pieces"]), lambda p: F.get("links", p)))
    held = found.select(F.explode(F.transform("docs", of_doc)).alias("held")).select(F.explode(F.array_distinct("held")).alias("pair"))
    counts = held.groupBy("pair").agg(F.count(F.lit(1)).alias("count"))
    counts = written(counts.withColumn("a", F.expr(f"pair div {PACK}")))
    most = counts.groupBy("a").agg(F.max("count").alias("most"))
    return written(counts.join(most, "a").select("pair", "count", (F.col("count") == F.col("most")).cast("int").alias("best")))


def align(docs: DataFrame, paths: tuple[str, str] | None = None, broadcast_pairs: int = BROADCAST_PAIRS) -> DataFrame:
    """doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum and groups_sha256 of every row."""
    found = written(blocks(docs, *(paths or vocabulary_paths())), ROW_GROUP)
    pairs = pair_counts(found)
    of_doc = lambda d: F.struct(d["row"].alias("row"), F.flatten(F.transform(d["pieces"], lambda p: F.get("links", p))).alias("links"))
    links = found.select(F.explode(F.transform("docs", of_doc)).alias("d")).select("d.row", F.explode("d.links").alias("pair"))
    if pairs.count() <= broadcast_pairs:
        met = links.withColumn("m", F.lit(1)).join(F.broadcast(pairs), "pair")
    else:  # once a pair and document
        met = links.groupBy("row", "pair").agg(F.count(F.lit(1)).alias("m")).join(pairs, "pair")
    sums = met.groupBy("row").agg(F.sum("m").alias("n_links"), F.sum(F.col("m") * F.col("best")).alias("n_best"), F.sum(F.col("m") * F.col("count")).alias("count_sum"))
    rows = found.select(F.explode("docs").alias("d")).select("d.doc_id", "d.row", "d.n_a", "d.n_b", "d.n_groups", "d.groups_sha256")
    zero = lambda name: F.coalesce(name, F.lit(0)).cast("bigint").alias(name)
    return rows.join(sums, "row", "left").select("doc_id", "n_a", "n_b", "n_groups", zero("n_links"), zero("n_best"), zero("count_sum"), "groups_sha256")
