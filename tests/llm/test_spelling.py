"""Near words against all pairs, counts against a plain loop."""

from __future__ import annotations

import random
import re
from collections import Counter
from zlib import crc32

import pytest

from rowaccord.llm import spelling as s


def near(a, b):
    """Exactly one inserted, deleted or replaced code point."""
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b, strict=True)) == 1
    a, b = sorted((a, b), key=len)
    return len(b) == len(a) + 1 and any(b[:i] + b[i + 1 :] == a for i in range(len(b)))


def all_pairs(words, ratio=5):
    """The contract by brute force: {word: (form, root, n, n_near, form_n)}."""
    close = {w: [v for v in words if near(w, v)] for w in words}
    form = {}
    for w, n in words.items():
        best = min(close[w], key=lambda v: (-words[v], v), default=None)
        form[w] = best if best is not None and words[best] >= ratio * n else None
    out = {}
    for w, n in words.items():
        root = w
        while form[root] is not None:
            root = form[root]
        out[w] = (form[w], root, n, len(close[w]), words[form[w]] if form[w] else None)
    return out


def plain_counts(rows):
    found = Counter()
    for doc_id, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in run)
            h = crc32(f"{'' if doc_id is None else doc_id}:{run}".encode())
            if h % 199 == 0:
                run = run[: h % len(run)] + run[h % len(run) + 1 :]
            found[run] += 1
    return {w: n for w, n in found.items() if len(w) >= 6 and n >= 5}


def vocabulary(seed, n=250, letters="abcé"):
    """Words of few letters, so that most have near words, orders of the same letters and long chains of forms."""
    rng = random.Random(seed)
    words = {"aaaaaa": 90_000, "aaaaaaa": 9_000, "aaaaaaaa": 900, "aaaaaaab": 100, "baaaaaab": 10, "bbaaaaab": 10}
    while len(words) < n:
        words["".join(rng.choice(letters) for _ in range(rng.choice([6, 6, 7, 8])))] = rng.choice([5, 5, 6, 30, 30, 200, 1000])
    return words


@pytest.mark.parametrize("seed", range(3))
@pytest.mark.parametrize("parts", [3, 8])
def test_forms(spark, seed, parts):
    words = vocabulary(seed, letters="abcdefghijé" if seed else "abÿ")
    df = spark.createDataFrame(list(words.items()), "word string, n bigint")
    got = {r.word: (r.form, r.root, r.n, r.n_near, r.form_n) for r in s.spelling_forms(df, parts=parts).collect()}
    assert got == all_pairs(words)


def test_edits_of_one_word(spark):
    word, alphabet = "àbcdef", "abcdefgÿ"
    words = {word: 5000}
    for i in range(len(word) + 1):
        words |= {word[:i] + c + word[i:]: 7 for c in alphabet}
        words |= {word[:i] + c + word[i + 1 :]: 7 for c in alphabet if i < len(word) and c != word[i]}
    df = spark.createDataFrame(list(words.items()), "word string, n bigint")
    got = {r.word: r for r in s.spelling_forms(df).collect()}
    assert got[word].n_near == len(words) - 1 and got[word].form is None
    assert all(r.form == r.root == word for w, r in got.items() if w != word)


def test_counts(spark):
    rng = random.Random(1)
    stock = ["Strasse", "straße", "ÀÉÎõü", "Àéîõüç", "abcdef", "ABCDEF", "abcde", "İstanbul", "a×b÷cdé", "ſtrange", "x" * 500, "KKelvin"]
    rows = [(i, " ,.-1".join(rng.choice(stock) for _ in range(rng.randint(0, 40)))) for i in range(600)]
    rows += [(None, "abcdef " * 9), (1, None), (2, ""), (3, "same text text"), (3, "same text text"), (10**12, "straßen" * 30_000)]
    df = spark.createDataFrame([(i, t, 0, "x") for i, t in rows], "doc_id bigint, text string, n int, word string")
    got = {r.word: r.n for r in s.word_counts(df.repartition(3)).collect()}
    assert got == plain_counts(rows)
    assert any(crc32(f"{i}:{w}".encode()) % 199 == 0 for i in range(600) for w in ("strasse", "straße", "abcdef"))


def test_variants_of_texts(spark):
    rows = [(i, "colour colours colour " + ("color colr " if i % 7 == 0 else "") + "Colour") for i in range(100)]
    df = spark.createDataFrame(rows, "doc_id bigint, text string")
    got = {r.word: (r.form, r.root, r.n, r.n_near, r.form_n) for r in s.spelling_variants(df).collect()}
    assert got == all_pairs(plain_counts(rows))
    assert s.spelling_variants(df.limit(0)).collect() == []
    assert s.spelling_variants(df.selectExpr("doc_id", "cast(null as string) as text")).collect() == []
