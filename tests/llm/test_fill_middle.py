"""Cuts against plain slicing of tokens, outputs against the contract, and the way back to the text."""

from __future__ import annotations

import hashlib
import random
import re

import pytest
from pyspark.sql import functions as F

from rowaccord.llm.fill_middle import SkipList, cuts, fill_in_middle, restored


def units(text):
    return re.findall(r"[A-Za-z]+|[^A-Za-z]", text)


def plain_output(doc_id, text):
    """The contract word by word: n, form, widths and output."""
    w, digits = units(text), hashlib.sha256(f"1:{doc_id}".encode()).hexdigest()
    h1, h2, h3, h4 = (int(digits[8 * i : 8 * i + 8], 16) for i in range(4))
    a, b = sorted((h1 % (len(w) + 1), h2 % (len(w) + 1)))
    p, m, s = "".join(w[:a]), "".join(w[a:b]), "".join(w[b:])
    if not text or any(x in text for x in ("<P>", "<S>", "<M>")) or h3 % 100 >= 90:
        return len(w), "plain", None, None, text
    if h4 % 100 < 20:
        return len(w), "spm", len(p), len(m), f"<S>{s}<P>{p}<M>{m}"
    return len(w), "psm", len(p), len(m), f"<P>{p}<S>{s}<M>{m}"


def odd_texts(seed, n=150):
    rng = random.Random(seed)
    fixed = ["", " ", "word", "a b", "<P>", "x<M>y", "<", "<<P", "S><P", "é" * 40, "日本 語😀x", "\n\n", "a" * 5000, "ab " * 3000, "İıß ÀZ", "😀"[:0]]
    return fixed + ["".join(rng.choice("aBz <>PSM\né😀1@[`{") for _ in range(rng.randint(1, 60))) for _ in range(n)]


@pytest.mark.parametrize("seed", range(3))
def test_every_rank_is_reached(seed):
    for text in odd_texts(seed, 40):
        w, found = units(text), SkipList(text)
        assert (found.n, found.points) == (len(w), len(text))
        ranks = range(len(w) + 1) if len(w) < 300 else random.Random(seed).sample(range(len(w) + 1), 50)
        assert [found.reach(r) for r in ranks] == [len("".join(w[:r])) for r in ranks]


def test_lanes_thin_out_and_keep_both_widths():
    text = "a b " * 50_000
    found = SkipList(text)
    assert len(found.lanes) > 5 and len(found.lanes[-1].units) <= 8
    for lane in found.lanes:
        assert (lane.units.sum(), lane.points.sum()) == (found.n, len(text))


def test_steps_of_a_search_are_few():
    steps = 0

    class Counted:
        def __init__(self, lane):
            self.units, self.points, self.below = lane.units.tolist(), lane.points.tolist(), lane.below.tolist()

        def __len__(self):
            return len(self.units)

    found = SkipList("x " * 200_000)
    for rank in (1, 99_999, 250_001, 399_999):
        node = passed = 0
        for lane in map(Counted, reversed(found.lanes)):
            while node < len(lane) and passed + lane.units[node] <= rank:
                passed, node, steps = passed + lane.units[node], node + 1, steps + 1
            if node == len(lane):
                break
            node = lane.below[node]
        assert passed == rank
    assert steps < 4 * 120


def test_rows_against_the_contract(spark):
    rows = [(i, t, "note") for i, t in enumerate(odd_texts(7))] + [(900, None, "x"), (5, "b a c", "again"), (5, "b a c", "again")]
    df = spark.createDataFrame(rows, "doc_id bigint, text string, output string")
    out = fill_in_middle(df).withColumn("back", restored(F.col("output"), F.col("form"))).collect()
    want = sorted((i, *plain_output(i, t or ""), t or "") for i, t, _ in rows)
    assert sorted((r.doc_id, r.n, r.form, r.prefix_chars, r.middle_chars, r.output, r.back) for r in out) == want
    assert {r.form for r in out} == {"plain", "psm", "spm"}


def test_null_ids_names_and_empty_tables(spark):
    df = spark.createDataFrame([(None, "some words here"), (None, None)], "key string, body string")
    got = {r.n: r for r in fill_in_middle(df, "key", "body").collect()}
    assert got[5][1:] == plain_output("", "some words here") and got[0].form == "plain" and got[5].key is None
    assert fill_in_middle(df.limit(0), "key", "body").collect() == []


def test_plain_by_draw():
    forms = [cuts(i, "a b c d")[3] for i in range(3000)]
    assert 240 < forms.count("plain") < 360 and 430 < forms.count("spm") < 650
