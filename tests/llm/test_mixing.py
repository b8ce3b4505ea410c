"""Targets against the loop that shares excess again, plans against a plain queue, running totals against sums."""

from __future__ import annotations

import hashlib
import random
import re

import pytest
from pyspark.sql import functions as F

from rowaccord.llm import mixing as m


def looped_targets(sizes, weights, share=1.5, repeats=2):
    """Sources in order, their sizes and weights; the excess over a bound goes to the others until there is none."""
    budget, target, fixed = share * sum(sizes), [0.0] * len(sizes), set()
    while True:
        free = [i for i in range(len(sizes)) if i not in fixed and weights[i] > 0]
        left = budget - sum(target[i] for i in fixed)
        for i in free:
            target[i] = left * weights[i] / sum(weights[j] for j in free)
        over = [i for i in free if target[i] > repeats * sizes[i]]
        if not over:
            return target
        for i in over:
            target[i] = repeats * sizes[i]
            fixed.add(i)


def queued(rows, weights=(5, 2, 1), share=1.5, repeats=2):
    """Words taken of each (id, source, text), by one sorted list."""
    size = [len(re.findall(r"[^\x20\x09-\x0D]+", t or "")) for _, _, t in rows]
    names = sorted({s for _, s, _ in rows}, key=lambda s: (s is None, s or ""))
    by_source = [sum(n for n, r in zip(size, rows, strict=True) if r[1] == s) for s in names]
    target = looped_targets(by_source, [weights[i % len(weights)] for i in range(len(names))], share, repeats)
    entries = []
    for k, s in enumerate(names):
        place = lambda i: (hashlib.md5(f"0:{'' if rows[i][0] is None else rows[i][0]}".encode()).hexdigest()[:16], rows[i][0] is None, rows[i][0] or 0, size[i], i)
        served = 0
        for turn in range(repeats):
            for i in sorted((i for i, r in enumerate(rows) if r[1] == s), key=place):
                served += size[i]
                if size[i] and target[k] > 0:
                    entries.append((served / target[k], k, turn, place(i), i))
    until, taken = 0, [0] * len(rows)
    for *_, i in sorted(entries):
        until += size[i]
        if until - size[i] / 2 < share * sum(size):
            taken[i] += size[i]
    return [(r[0], n, by_source[names.index(r[1])], target[names.index(r[1])], t) for r, n, t in zip(rows, size, taken, strict=True)]


def corpus(seed, n=300, sources=9):
    rng = random.Random(seed)
    names = [None, "é", *(f"s{i}" for i in range(sources))]
    rows = [(i, "s1" if rng.random() < 0.4 else rng.choice(names), "w " * rng.choice([0, 1, 3, 8, 40])) for i in range(n)]
    return rows + [(3, "s2", "again and again")] * 5 + [(None, "s3", "no id"), (7, "s4", None), (8, None, ""), (9, "void", "")]


def rounded(rows):
    return sorted(((x[0] is None, x[0] or 0, *x[1:3], round(x[3], 6), x[4]) for x in map(tuple, rows)))


SCHEMA = "doc_id bigint, source string, text string"


@pytest.mark.parametrize("seed", range(2))
def test_words_taken(spark, seed):
    rows = corpus(seed)
    df = spark.createDataFrame(rows, SCHEMA).withColumn("size", F.lit("clash")).withColumn("row", F.lit(1)).withColumn("taken", F.lit(0))
    got = m.words_taken(m.mixture_plan(df.repartition(5))).collect()
    assert rounded(got) == rounded(queued(rows))
    assert rounded(m.words_taken(m.mixture_plan(df.repartition(3))).collect()) == rounded(got)


def test_taken_words_come_near_the_targets(spark):
    rng = random.Random(3)
    rows = [(i, f"s{rng.choice('00000123456')}", "w " * rng.randint(1, 30)) for i in range(3000)]
    got = m.mixture_plan(spark.createDataFrame(rows, SCHEMA))
    per_source = got.groupBy("source").agg(F.sum(F.when(F.col("taken"), F.col("size"))).alias("k"), F.first("target").alias("t")).collect()
    assert all(abs(r.k - r.t) <= 30 for r in per_source)
    words, taken = sum(len(r[2]) // 2 for r in rows), sum(r.k for r in per_source)
    assert abs(taken - 1.5 * words) <= 15
    # At half of the mix the sources stand as at its end.
    half = got.where("taken and finish <= 0.5").groupBy("source").agg(F.sum("size").alias("k"), F.first("target").alias("t")).collect()
    assert all(abs(r.k - r.t / 2) <= 30 for r in half)


def test_other_weights_and_empty_tables(spark):
    rows = [(i, "ab"[i % 2], "w w w") for i in range(400)]
    df = spark.createDataFrame(rows, SCHEMA)

    def per_source(**options):
        plan = m.mixture_plan(df, **options)
        return {r.source: (round(r.t, 6), r.k) for r in plan.groupBy("source").agg(F.first("target").alias("t"), F.sum(F.when(F.col("taken"), F.col("size")).otherwise(0)).alias("k")).collect()}

    assert per_source(weights={"a": 3, "b": 1}, share=0.5) == {"a": (450.0, 450), "b": (150.0, 150)}
    assert per_source(weights={"a": 1}, share=1.0) == {"a": (1200.0, 1200), "b": (0.0, 0)}
    assert per_source(weights={}, share=1.0) == {"a": (0.0, 0), "b": (0.0, 0)}
    assert per_source(weights=(1,), share=9.0, repeats=3) == {"a": (1800.0, 1800), "b": (1800.0, 1800)}
    other = per_source(seed=5)
    assert other == per_source() and m.words_taken(m.mixture_plan(df.limit(0))).collect() == []
    blank = spark.createDataFrame([(1, "a", None), (2, None, "")], SCHEMA)
    assert sorted(map(tuple, m.words_taken(m.mixture_plan(blank)).collect())) == [(1, 0, 0, 0.0, 0), (2, 0, 0, 0.0, 0)]


@pytest.mark.parametrize("seed", range(2))
def test_targets(spark, seed):
    rng = random.Random(seed)
    sizes = [rng.choice([0, 1, 5, 100, 1000]) for _ in range(rng.randint(1, 40))]
    names = sorted(f"n{rng.random()}" for _ in sizes)
    got = m.targets(spark.createDataFrame(list(zip(names, sizes, strict=True)), "source string, source_size bigint")).collect()
    want = looped_targets(sizes, [(5, 2, 1)[i % 3] for i in range(len(sizes))])
    assert [round(r.target, 6) for r in sorted(got, key=lambda r: r.source)] == [round(t, 6) for t in want]


def test_running_totals(spark):
    rng = random.Random(0)
    rows = [(rng.choice(["hot"] * 5 + [None, "a", "b"]), i, rng.randint(0, 9)) for i in range(2000)]
    df = spark.createDataFrame(rows, "g string, i int, x bigint").repartition(6)
    got = m.running_totals(df, {"t": "x"}, [F.asc_nulls_last("g"), F.col("i")], "test", ["g"]).collect()
    totals, want = {}, []
    for g, i, x in sorted(rows, key=lambda r: r[1]):
        totals[g] = totals.get(g, 0) + x
        want.append((g, i, x, totals[g]))
    assert sorted(map(tuple, got), key=str) == sorted(want, key=str)
