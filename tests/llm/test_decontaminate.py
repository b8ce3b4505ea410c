"""Contaminated words against a scan of all windows."""

from __future__ import annotations

import random
import re

import pytest

from rowaccord.llm import decontaminate as d

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def words(text):
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    return WORD.findall(low)


def brute(docs, items):
    out = []
    for i, text in docs:
        w = words(text)
        hit, found = set(), set()
        for item, t in items:
            b = words(t)
            n = min(10, len(b))
            for s in range(len(b) - n + 1 if n else 0):
                for p in range(len(w) - n + 1):
                    if w[p : p + n] == b[s : s + n]:
                        hit.update(range(p, p + n))
                        found.add(str(item))
        out.append((i, len(w), len(hit), sorted(found), bool(hit)))
    return sorted(out)


def tables(rng):
    word = lambda: rng.choice(["Ä", "ß", "é1", "x", "Y", "zz", "The", "of", "9"]) + str(rng.randrange(4))
    text = lambda n: "".join(word() + rng.choice([" ", ", ", "\n", "--", " <b>"]) for _ in range(n))
    items = [(i, text(n)) for i, n in enumerate([30, 10, 11, 9, 4, 1, 25, 12])] + [(20, None), (21, " .. "), (22, "")]
    items += [(30, items[0][1]), (31, items[0][1].upper()), (1, items[1][1])]
    docs = [(100 + i, text(rng.randrange(0, 60))) for i in range(30)]
    for i, (_, t) in enumerate(items):
        docs.append((i, text(5) + (t or "") + text(7)))
        docs.append((40 + i, ((t or "") + " ") * 3))
    docs += [(70, None), (71, ""), (72, "..."), (73, items[2][1]), (73, items[2][1]), (73, "other")]
    return docs, items


@pytest.mark.parametrize("limit", [d.BROADCAST_WINDOWS, 0])
def test_all_windows(spark, monkeypatch, limit):
    monkeypatch.setattr(d, "BROADCAST_WINDOWS", limit)
    docs, items = tables(random.Random(4))
    left = spark.createDataFrame([(*r, "c", 1) for r in docs], "doc_id bigint, text string, item string, rid int")
    right = spark.createDataFrame([(*r, 1.0) for r in items], "item_id bigint, text string, win double")
    got = d.contamination(left, right).collect()
    assert sorted((r["doc_id"], r["n_words"], r["n_hit"], r["item_ids"], r["contaminated"]) for r in got) == brute(docs, items)


def test_remove(spark):
    passage = " ".join(f"q{i}" for i in range(12))
    rows = [(1, f"Before, it: {passage}. After!"), (2, passage), (3, "clean  text\n"), (4, None), (None, "  Lead " + passage.upper() + " x y z a b c d e f g h i j k l m")]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string")
    items = spark.createDataFrame([(7, passage)], "item_id bigint, text string")
    got = {r["doc_id"]: r["text"] for r in d.remove_spans(docs, items, least_share=0.9).collect()}
    assert got == {1: "Before, it: After!", 3: "clean  text\n", 4: None, None: "  Lead x y z a b c d e f g h i j k l m"}
    assert d.remove_spans(docs, items.limit(0)).count() == 5
    assert d.contamination(docs.limit(0), items).collect() == []
    assert [r["n_hit"] for r in d.contamination(docs, items.limit(0)).collect()] == [0] * 5


def test_remove_keeps_columns_of_any_name(spark):
    passage = " ".join(f"q{i}" for i in range(12))
    names = ["_key", "_runs", "_hit", "_leak", "rid", "a.b"]
    docs = spark.createDataFrame([(1, f"x y z {passage}", *names), (None, None, *names)], "doc_id bigint, text string, " + ", ".join(f"`{c}` string" for c in names))
    got = d.remove_spans(docs, spark.createDataFrame([(7, passage)], "item_id bigint, text string"), least_share=0.9)
    assert got.columns == docs.columns
    assert sorted(map(tuple, got.collect()), key=str) == [(1, "x y z ", *names), (None, None, *names)]
