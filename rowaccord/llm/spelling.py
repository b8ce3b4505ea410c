"""Grouping spelling variants: words one edit apart, found by PartEnum signatures of their letters.

A word's letters as a multiset are a set of (letter, occurrence) elements, a binary vector. One insertion or deletion
changes one element, one replacement at most two, so near words are at Hamming distance two or less. The elements are
dealt by hash to a number of parts. Vectors at distance two or less differ in at most two parts, hence agree on all
others: each choice of two parts to leave out gives one signature, the choice and the elements of the other parts, and
near words share at least one. Words of the same letters in another order share all, so each signature also names an
end of the word: of words of at least six letters one edit leaves the first three or the last three as they are.
Signatures are joined by equality; each pair found is verified by its edit distance, so collisions cost time only and
nothing is missed.

The counts come from one pass over the texts in which every batch passes on its distinct words only.
"""

from __future__ import annotations

import re
from collections import Counter
from itertools import combinations
from zlib import crc32

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import by_batch, id_and_text, settled

#: What counts as a word, how often it must occur, and how much more frequent its form is.
LETTERS = 6
OCCURRENCES = 5
RATIO = 5
#: One run in this many, by a hash of the document and the run, loses a character.
NOISE = 199

#: Parts of a vector. More parts give more signatures per word, of more letters each.
PARTS = 8



def add_words(words: Counter[str], doc_id: str, text: str, letters: int) -> None:
    """Count a text's words of at least ``letters`` code points, or one less where a run loses one.

    A-Z are lower-cased as bytes, which leaves all other letters alone. Shorter runs cannot give words, as a run
    only loses characters; an expression that wants so many letters starts at a run's first one or nowhere in it.
    """
    lowered = text.encode().lower().decode()
    runs = Counter(map(re.Match.group, re.finditer(f"[a-zÀ-ÿ]{{{letters},}}", lowered)))
    start = crc32(f"{doc_id}:".encode())
    for run in [r for r in runs if not crc32(r.encode(), start) % NOISE]:
        at = crc32(run.encode(), start) % len(run)
        words[run[:at] + run[at + 1 :]] += runs.pop(run)
    words.update(runs)


def word_counts(
    docs: DataFrame, letters: int = LETTERS, occurrences: int = OCCURRENCES, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """``word, n`` of all words of at least ``letters`` code points that occur ``occurrences`` times in the texts.

    Null texts hold no words; a null id is hashed as an empty text; repeated rows count each time. Other columns are
    not read. An empty table gives an empty table.
    """

    def count(columns: dict[str, list]) -> dict[str, list]:
        words: Counter[str] = Counter()
        for doc_id, text in zip(columns["id"], columns["text"], strict=True):
            add_words(words, doc_id, text, letters)
        return {"word": list(words), "n": list(words.values())}

    texts = id_and_text(docs, id_col, text_col).where("text IS NOT NULL")
    named = texts.select(F.coalesce(F.col("id").cast("string"), F.lit("")).alias("id"), "text")
    partial = by_batch(named, count, "word string, n bigint").where(F.length("word") >= letters)
    return partial.groupBy("word").agg(F.sum("n").alias("n")).where(F.col("n") >= occurrences)


def signatures(words: DataFrame, letters: int = LETTERS, parts: int = PARTS) -> DataFrame:
    """``word, n`` with each of the word's PartEnum signatures as ``signature`` (long)."""
    spelled = words.select("word", "n", F.array_sort(F.split("word", "")).alias("letters"))
    # In sorted letters an occurrence's number is its place less the place of the first one.
    elements = spelled.withColumn("elements", F.expr("transform(letters, (c, i) -> xxhash64(c, i - array_position(letters, c)))"))
    part = f"transform(sequence(0, {parts - 1}), p -> aggregate(filter(elements, e -> pmod(e, {parts}) = p), 0L, (x, e) -> x ^ e))"
    hashed = elements.select("word", "n", F.expr(part).alias("part"), F.expr("aggregate(elements, 0L, (x, e) -> x ^ e)").alias("whole"))
    # An edit lies behind the first letters // 2 code points of both words, or before the last ones.
    choices = ", ".join(f"struct({p} AS p, {q} AS q, {first} AS first)" for p, q in combinations(range(parts), 2) for first in ("true", "false"))
    chosen = hashed.select("*", F.inline(F.expr(f"array({choices})")))
    end = f"CASE WHEN first THEN left(word, {letters // 2}) ELSE right(word, {letters // 2}) END"
    return chosen.select("word", "n", F.expr(f"xxhash64(p, q, first, {end}, whole ^ part[p] ^ part[q])").alias("signature"))


def near_pairs(words: DataFrame, letters: int = LETTERS, parts: int = PARTS) -> DataFrame:
    """``word, near, n, near_n``: each two words exactly one edit apart, both ways, from ``word, n``.

    No word may have fewer than ``letters`` code points.
    """
    signed = signatures(words, letters, parts)
    # Both sides are the same plan under the same names, so the signatures are made and shuffled once.
    pairs = signed.alias("a").join(signed.alias("b"), F.expr("a.signature = b.signature AND a.word < b.word AND levenshtein(a.word, b.word, 1) = 1"))
    pairs = pairs.selectExpr("a.word", "b.word AS near", "a.n", "b.n AS near_n").distinct()
    return pairs.union(pairs.select("near", "word", "near_n", "n"))


def spelling_forms(words: DataFrame, ratio: int = RATIO, letters: int = LETTERS, parts: int = PARTS) -> DataFrame:
    """``word, form, root, n, n_near, form_n`` of each word of ``word, n``.

    A word's form is its most frequent near word (of several the first in code-point order) if that occurs at least
    ``ratio`` times as often, else null. Its root is where forms lead to, the word itself if it has none; counts grow
    along forms, so they end. No word may have fewer than ``letters`` code points. An empty table gives an empty table.
    """
    words = settled(words, "spelling-words")
    pairs = near_pairs(words, letters, parts)
    best = F.min(F.struct((-F.col("near_n")).alias("less"), F.col("near")))
    near = pairs.groupBy("word").agg(F.count("*").alias("n_near"), best.alias("best"))
    found = words.join(near, "word", "left").withColumn("form_n", -F.col("best.less"))
    has_form = F.col("form_n") >= F.col("n") * ratio
    found = found.select(
        "word",
        "n",
        F.coalesce("n_near", F.lit(0)).alias("n_near"),
        F.when(has_form, F.col("best.near")).alias("form"),
        F.when(has_form, F.col("form_n")).alias("form_n"),
    )
    found = settled(found, "spelling-forms")
    return found.join(_roots(found), "word").select("word", "form", "root", "n", "n_near", "form_n")


def _roots(found: DataFrame) -> DataFrame:
    """``word, root``: every round replaces a root by its root, so chains halve until none is left."""
    roots = found.select("word", F.coalesce("form", "word").alias("root"))
    while True:
        step = roots.select(F.col("word").alias("root"), F.col("root").alias("next"))
        moved = settled(roots.join(step, "root").select("word", F.col("next").alias("root"), (F.col("next") != F.col("root")).alias("moved")), "spelling-roots")
        roots = moved.select("word", "root")
        if moved.where("moved").isEmpty():
            return roots


def spelling_variants(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Spelling variants among the words of all texts: see :func:`word_counts` and :func:`spelling_forms`."""
    return spelling_forms(word_counts(docs, id_col=id_col, text_col=text_col))
