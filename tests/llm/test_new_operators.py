"""Near duplicates, spelling variants and token alignment against plain versions, and their edge cases."""

import hashlib
import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest

from tracemill.llm import alignment, minhash, spelling

DOCS = "doc_id long, text string, lang string, source string, n_chars long, n int, word string, row long, key string, h int"


def docs(spark, texts):
    return spark.createDataFrame([(i, t, "en", "a", 0, 1, "x", 7, "y", 3) for i, t in texts], DOCS)


ODD = [(1, None), (2, ""), (3, " \n\t "), (4, "one"), (None, "one two three four five six"), (5, "one two three four five six"), (5, "one two three four five six"), (6, "Ä" * 3000), (7, "ONE")]


def sets_of(texts):
    out = {}
    for i, t in texts:
        ws = (t or "").encode().lower().split()
        out[i] = {tuple(ws[k : k + 4]) for k in range(max(1, len(ws) - 3))} if ws else set()
    return out


def plain_components(sets):
    root = {i: i for i in sets}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    ids = sorted(sets)
    for n, i in enumerate(ids):
        for j in ids[n + 1 :]:
            both = len(sets[i] & sets[j])
            if both and 100 * both >= 80 * len(sets[i] | sets[j]):
                a, b = sorted((find(i), find(j)))
                root[b] = a
    return {i: find(i) for i in ids}


def corpus(seed, n):
    """Texts of every length with chains of edits, shared passages and equal copies."""
    r = random.Random(seed)
    letters = [f"w{k}" for k in range(300)]
    common = r.choices(letters, k=40)
    out = []
    while len(out) < n:
        base = r.choices(letters, k=r.choice([1, 2, 3, 4, 5, 6, 7, 9, 12, 20, 60, 200]))
        if r.random() < 0.3:
            base = common + base
        out.append(base)
        for _ in range(r.choice([0, 0, 1, 3, 8])):
            base = list(base)
            for _ in range(r.choice([0, 1, 1, 2, 3])):
                at = r.randrange(len(base))
                base[at : at + r.choice([0, 1])] = [r.choice(letters)]
            out.append(base)
    return [(i, " ".join(w).upper() if i % 7 == 0 else "  ".join(w)) for i, w in enumerate(out[:n])]


@pytest.mark.parametrize("seed", [1, 2])
def test_near_duplicates_match_all_pairs(spark, seed):
    texts = corpus(seed, 400)
    sets = sets_of(texts)
    want = plain_components(sets)
    got = {r["doc_id"]: r for r in minhash.near_duplicates(docs(spark, texts), stars=1 + seed).collect()}
    assert {i: r["component_id"] for i, r in got.items()} == want
    assert all(r["n_shingles"] == len(sets[i]) and r["kept"] == (want[i] == i) for i, r in got.items())


def test_near_duplicates_of_odd_rows(spark):
    got = minhash.near_duplicates(docs(spark, ODD)).collect()
    assert len(got) == len(ODD)
    by = {r["doc_id"]: r for r in got}
    assert [by[i]["n_shingles"] for i in (1, 2, 3, 4, 5, 6)] == [0, 0, 0, 1, 3, 1]
    assert by[None]["component_id"] == 5 and not by[None]["kept"] and by[7]["component_id"] == 4 and not by[7]["kept"]
    assert all(by[i]["kept"] for i in (1, 2, 3, 4, 5, 6))
    assert minhash.near_duplicates(docs(spark, [])).count() == 0


def test_signature_of_small_sets_agrees_as_often_as_they_are_alike():
    r = np.random.Generator(np.random.PCG64(5))
    for n in (5, 40, 2000):
        agree = []
        for _ in range(150):
            s = np.unique(r.integers(0, 1 << 63, n, dtype=np.uint64) * np.uint64(2))
            agree.append(np.mean(minhash.signature(s) == minhash.signature(s[r.random(len(s)) < 0.8] if n > 5 else np.delete(s, r.integers(len(s))))))
        assert abs(np.mean(agree) - 0.8) < 0.04


def test_parity_never_differs_more_than_the_sets():
    r = np.random.Generator(np.random.PCG64(6))
    for _ in range(50):
        s, t = (set(r.integers(0, 500, r.integers(1, 400)).tolist()) for _ in "ab")
        x, y = (minhash.parity(np.array(sorted(v), np.uint64)) for v in (s, t))
        assert sum(int(v).bit_count() for v in x ^ y) <= len(s ^ t)


def plain_variants(texts):
    import re

    n = Counter()
    for i, t in texts:
        for run in re.findall("[A-Za-zÀ-ÿ]+", t or ""):
            run = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in run)
            h = zlib.crc32(f"{'' if i is None else i}:{run}".encode())
            if h % 97 == 0:
                run = run[: h % len(run)] + run[h % len(run) + 1 :]
            n[run] += 1
    n = {w: k for w, k in n.items() if len(w) >= 5 and k >= 3}

    def near(a, b):
        if len(a) > len(b):
            a, b = b, a
        if len(a) == len(b):
            return sum(x != y for x, y in zip(a, b)) == 1
        return len(b) == len(a) + 1 and any(b[:k] + b[k + 1 :] == a for k in range(len(b)))

    close = {w: [v for v in n if near(w, v)] for w in n}
    form = {w: min(vs, key=lambda v: (-n[v], v)) for w, vs in close.items() if vs}
    form = {w: v for w, v in form.items() if n[v] >= 2 * n[w]}

    def root(w):
        while w in form:
            w = form[w]
        return w

    return {(w, form.get(w), root(w), n[w], len(close[w]), n.get(form.get(w))) for w in n}


@pytest.mark.parametrize("limit", [2, 64])
def test_variants_match_all_pairs(spark, limit):
    r = random.Random(3)
    words = ["".join(r.choices("abÄé", k=r.choice([5, 5, 6, 7, 9, 14]))) for _ in range(60)] + ["aaaaa", "aaaaaa", "aaaaaaa", "abababababab"]
    for w in list(words):
        at = r.randrange(len(w))
        words += [w[:at] + w[at + 1 :], w[:at] + "b" + w[at:], w[:at] + "é" + w[at + 1 :]]
    texts = [(i, " ".join(r.choices(words, weights=[1 + 200 // (k + 1) for k in range(len(words))], k=60)) + (" WORDY, Wordy;wordy x÷yzzzq" if i % 3 else "")) for i in range(120)]
    texts += [(None, "wordy wordy zzzzz"), (5, None), (6, "")]
    got = spelling.variants(docs(spark, texts), limit)
    assert {tuple(x) for x in got.select("word", "form", "root", "n", "n_near", "form_n").collect()} == plain_variants(texts)


def test_variants_of_nothing(spark):
    assert spelling.variants(docs(spark, [])).count() == 0
    assert spelling.variants(docs(spark, [(1, None), (2, "a b c"), (3, "\t")])).count() == 0


@pytest.fixture(scope="module")
def libraries():
    import sentencepiece
    from tokenizers import Tokenizer

    a, b = alignment.vocabulary_paths()
    t = Tokenizer.from_file(a)
    t.encode_special_tokens = True
    return t, sentencepiece.SentencePieceProcessor(model_file=b)


def plain_alignment(libraries, texts):
    t, s = libraries
    letters = alignment.byte_letters()
    rows, held = [], Counter()
    for i, text in texts:
        a, b = (t.encode(" " + text, add_special_tokens=False).ids, s.encode(text)) if text else ([], [])
        bytes_a = [bytes(letters[c] for c in t.id_to_token(x)) for x in a]
        bytes_b = [bytes([int(s.id_to_piece(x)[3:5], 16)]) if s.is_byte(x) else s.id_to_piece(x).replace("▁", " ").encode() for x in b]
        whole = (" " + (text or "")).encode()
        if not text or b"".join(bytes_a) != whole or b"".join(bytes_b) != whole:
            a, b, bytes_a, bytes_b = [], [], [], []
        ends_a, ends_b = (np.cumsum([len(x) for x in y]).tolist() for y in (bytes_a, bytes_b))
        cuts = sorted(set(ends_a) & set(ends_b))
        groups = [([], []) for _ in cuts]
        for side, (ids, ends) in enumerate(((a, ends_a), (b, ends_b))):
            for x, e in zip(ids, ends):
                groups[next(k for k, c in enumerate(cuts) if c >= e)][side].append(x)
        links = [(x, y) for g in groups for x in g[0] for y in g[1]]
        held.update(set(links))
        rows.append((i, a, b, groups, links))
    best = defaultdict(int)
    for (x, _), c in held.items():
        best[x] = max(best[x], c)
    out = []
    for i, a, b, groups, links in rows:
        text = ";".join(",".join(map(str, g[0])) + "|" + ",".join(map(str, g[1])) for g in groups)
        out.append((i, len(a), len(b), len(groups), len(links), sum(held[k] == best[k[0]] for k in links), sum(held[k] for k in links), hashlib.sha256(text.encode()).hexdigest() if a else ""))
    return out


TEXTS = [
    "The quick brown fox", "the  double space", " leading and trailing ", "line\nbreaks \n and\ttabs\r\n", "naïve Ünïcödé 日本語 текст 🙂🙂 done", "▁ is a piece of its own",
    "x" * 500, "aaaaaaa" * 40 + " b", "<|endoftext|> and <s> </s> <unk> <0x0A>", "", None, " ", "\n", "a", "2024-01-01 12:30:59 $#@!", "don't won't I'm", "The quick brown fox", "a　b  c  d\x1ce f",
]


def test_alignment_matches_the_libraries(spark, libraries, monkeypatch):
    r = random.Random(4)
    texts = list(enumerate(TEXTS)) + [(None, "no id"), (3, "again three")]
    texts += [(100 + i, "".join(r.choice(["the", " ", " ", "  ", "\n", "é", "q", "-", "1", "ing", "日"]) for _ in range(r.randrange(1, 80)))) for i in range(60)]
    want = sorted(plain_alignment(libraries, texts), key=repr)
    for limit in (alignment.BROADCAST_PAIRS, 0):
        got = alignment.align(docs(spark, texts).repartition(3), broadcast_pairs=limit)
        assert got.columns == ["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]
        assert sorted(map(tuple, got.collect()), key=repr) == want


def test_alignment_of_a_long_text_without_spaces(spark, libraries):
    texts = [(1, "abcdefghij" * 20_000), (2, "".join(chr(97 + k * k % 26) for k in range(30_000)))]
    got = alignment.align(docs(spark, texts)).collect()
    t, s = libraries
    assert {r["doc_id"]: (r["n_a"], r["n_b"]) for r in got} == {i: (len(t.encode(" " + x, add_special_tokens=False).ids), len(s.encode(x))) for i, x in texts}
    assert alignment.align(docs(spark, [])).count() == 0


def test_small_blocks_and_forgetting_change_nothing(libraries, monkeypatch):
    both = alignment.Tokenizers(*alignment.vocabulary_paths())
    texts = [t for t in TEXTS if t]
    whole = both.block(texts)[2][0].to_pylist()
    monkeypatch.setattr(alignment, "REMEMBERED", 0)
    assert both.block(texts)[2][0].to_pylist() == whole or sorted(both.block(texts)[2][0].to_pylist()) == sorted(whole)
    monkeypatch.setattr(alignment, "BLOCK", 10)
    assert list(alignment._ranges([4, 5, 30, 1, 9, 1])) == [(0, 2), (2, 3), (3, 5), (5, 6)]
    assert both.a.quick is not None
    quick = alignment.Tokenizers(*alignment.vocabulary_paths())
    plain = alignment.Tokenizers(*alignment.vocabulary_paths())
    plain.a.quick = None  # by the file's own library alone
    long = ["y" * 1500 + " end", "one two  three", *texts]
    assert [x.tolist() for x in quick.block(long)[1]] == [x.tolist() for x in plain.block(long)[1]]
