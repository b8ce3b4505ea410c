"""Smallest keys against all column groups counted one by one."""

from __future__ import annotations

import random
import time
import warnings
from itertools import combinations

import pytest
from pyspark.sql import functions as F

import rowaccord as ra
from rowaccord.operators import key_search
from rowaccord.operators.key_search import NonKeys, smallest_keys


def counted(rows, names, most, every):
    """All column groups without a superfluous column whose values differ in all rows."""
    keys, found_at = [], None
    for size in range(1, most + 1):
        if found_at and not every:
            break
        for g in combinations(range(len(names)), size):
            if not any(set(k) <= set(g) for k in keys) and len({tuple(r[i] for i in g) for r in rows}) == len(rows):
                keys.append(g)
                found_at = size
    return sorted(sorted(names[i] for i in k) for k in keys)


def found(df, **options):
    return sorted(sorted(r["columns"]) for r in smallest_keys(df, **options).collect())


@pytest.mark.parametrize(("seed", "sample"), [(0, 20_000), (1, 40)])
def test_against_all_groups(spark, monkeypatch, seed, sample):
    monkeypatch.setattr(key_search, "SAMPLE_ROWS", sample)
    rng = random.Random(seed)
    names = [f"c {i}" for i in range(7)]
    sizes = [rng.choice([2, 3, 6, 15, 40]) for _ in names]
    rows = list({tuple(rng.choice([None, *range(n)]) for n in sizes) for _ in range(150)})
    df = spark.createDataFrame(rows, ", ".join(f"`{n}` int" for n in names))
    assert found(df, max_columns=3, every=True) == counted(rows, names, 3, True)
    if seed == 0:
        assert found(df) == counted(rows, names, 4, False)


def test_equal_hashes_of_different_values(spark, monkeypatch):
    """Where hashes say nothing, the values themselves decide."""
    monkeypatch.setattr(key_search.F, "xxhash64", lambda *c: F.lit(5).cast("bigint"))
    rows = [(i // 4, i % 4, i % 2) for i in range(12)]
    df = spark.createDataFrame(rows, "a int, b int, c int")
    monkeypatch.setattr(key_search, "_row_hash", lambda names: F.crc32(F.concat_ws("/", *[F.col(c) for c in names])))
    assert found(df) == [["a", "b"]]


def test_types_nulls_repeated_rows_and_empty_tables(spark):
    df = spark.sql("select id, map(1, id) as m, array(id % 3) as a, cast(if(id % 2 = 0, -0.0, 0.0) as double) as z, id div 3 as d from range(30)")
    assert found(df, columns=["m", "a", "z", "d"]) == [["a", "d"]]
    assert found(df.union(df.limit(1))) == [] and found(df.limit(0)) == [] and found(df.select("m")) == []
    nulls = spark.createDataFrame([(None, 1, 2), (1, None, 2), (1, 1, 3)], "a int, b int, c int")
    got = [(r["columns"], r["null_rows"], round(r["null_rate"], 3)) for r in smallest_keys(nulls).collect()]
    assert got == [(["a", "c"], 1, 0.333), (["b", "c"], 1, 0.333), (["a", "b"], 2, 0.667)]
    assert found(spark.createDataFrame([(1, 2)], "a int, b int")) == [["a"], ["b"]]


def test_candidates_are_all_groups_outside_the_non_keys():
    rng = random.Random(5)
    for _ in range(30):
        known, masks, keys = NonKeys(8), [rng.getrandbits(8) for _ in range(6)], [rng.getrandbits(8) | 1 for _ in range(2)]
        for m in masks:
            known.add(m)
        for size in range(1, 5):
            groups = [sum(1 << i for i in g) for g in combinations(range(8), size)]
            want = [g for g in groups if not any(g & m == g for m in masks) and not any(g & k == k for k in keys)]
            got = list(known.candidates(size, 8, keys))
            assert sorted(got) == sorted(want)


def jobs_of(spark, work):
    before = len(spark.sparkContext.statusTracker().getJobIdsForGroup(None))
    started = time.time()
    result = work()
    return result, len(spark.sparkContext.statusTracker().getJobIdsForGroup(None)) - before, time.time() - started


def test_wide_table_takes_few_jobs(spark):
    more = [f"(id * {7 + 2 * k}) div {20 + k} % {30 + 5 * k} as more{k}" for k in range(19)]
    df = spark.range(2000).selectExpr("id div 4 % 20 as store", "id div 80 as day", "id % 4 as line", *more).cache()
    keys, jobs, _ = jobs_of(spark, lambda: found(df))
    rows = [tuple(r) for r in df.collect()]
    assert keys == counted(rows, df.columns, 4, False) and jobs <= 30
    df.unpersist()


def test_wide_table_without_a_key_ends(spark):
    df = spark.range(500).selectExpr(*[f"(id * {3 + k}) % {5 + k} as c{k}" for k in range(40)])
    assert found(df.union(df.limit(1))) == []


def test_comparison_names_its_key(spark):
    one = spark.range(300).selectExpr("id div 100 as store", "id % 100 as line", "'x' as fixed", "id % 7 as v")
    two = one.selectExpr("store", "line", "fixed", "if(line = 5, 9, v) as v")
    c = ra.compare(one, two)
    assert sorted(c.keys) == ["line", "store"] and c.key_report().first()["source"] == "composite"
    assert c.counts().first()["modified_rows"] == 3
    assert ra.compare(one, two, keys=["store", "line"]).key_choice.source == "given"
    ids = spark.range(50).selectExpr("id", "id % 3 as v")
    assert ra.compare(ids, ids).key_choice.source == "single"
    with pytest.warns(UserWarning, match="first column"):
        assert ra.compare(ids.select("v"), ids.select("v")).key_choice.source == "fallback"
    with warnings.catch_warnings():
        warnings.simplefilter("error")
        ra.compare(ids, ids)


def test_groups_counted_at_once_follow_the_rows(spark, monkeypatch):
    """The entries that one job counts are bounded; the keys found do not depend on it."""
    monkeypatch.setattr(key_search, "SAMPLE_ROWS", 100)
    df = spark.range(2000).selectExpr("id % 50 AS a", "id div 50 AS b", "id div 50 + 1 AS c", "(id div 50) * 2 AS d", "id % 7 AS e")
    at_once = []
    real = key_search._hashed_pairs

    def spied(df, names, groups, slots):
        at_once.append((slots, len(groups)))
        return real(df, names, groups, slots)

    monkeypatch.setattr(key_search, "_hashed_pairs", spied)
    found = []
    for entries in (4000, 20_000_000):
        at_once.clear()
        monkeypatch.setattr(key_search, "COUNT_ENTRIES", entries)
        found.append([r["columns"] for r in ra.smallest_keys(df).orderBy("rank").collect()])
        assert all(n * 2000 <= max(entries, 2000) for slots, n in at_once if slots == 1)
    assert found[0] == found[1] == [["a", "b"], ["a", "c"], ["a", "d"]]
