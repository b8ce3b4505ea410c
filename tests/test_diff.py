"""Row comparison: small cases with known counts, and random tables against brute force."""

from __future__ import annotations

import random
import re
from collections import Counter

import pytest
from pyspark.sql import functions as F

import rowaccord as ra
from tests.conftest import by, only

ITEMS = "id bigint, name string, value bigint, kind string"
A = [(i, f"room {i}", 3 * i + 1, "pqr"[i % 3]) for i in range(1, 8)]
B = [r for r in A if r[0] not in (2, 3, 5, 6)] + [
    (2, "room 2", 12, "r"), (5, "room 5", 16, "R"), (6, "room 6", None, "P"), (20, "hall", 0, "p"), (21, "hall", 0, "p"),
]


def numbers(counts):
    r = only(counts)
    return [r[k] for k in ("added_rows", "removed_rows", "modified_rows", "formatting_only_rows", "rows_scanned")]


@pytest.fixture(scope="module")
def items(spark):
    return spark.createDataFrame(A, ITEMS), spark.createDataFrame(B, ITEMS)


@pytest.mark.parametrize(
    ("options", "expected"),
    [
        ({}, [2, 1, 3, 0, 9]),
        ({"rules": ra.IgnoreRules(case=True)}, [2, 1, 2, 1, 9]),
        ({"compare_columns": ["value"]}, [2, 1, 2, 0, 9]),
        ({"compare_columns": ["kind"]}, [2, 1, 2, 0, 9]),
        ({"compare_columns": ["name"]}, [2, 1, 0, 0, 9]),
        ({"compare_columns": ["value", "kind"]}, [2, 1, 3, 0, 9]),
    ],
)
def test_known_counts(items, options, expected):
    counts = ra.diff_counts(*items, ["id"], **options)
    assert numbers(counts) == expected
    r = only(counts)
    assert r["is_full_count"] is True
    assert (r["total_rows_f1"], r["total_rows_f2"], r["confidence_score"]) == (7, 8, 0.80)


def test_column_subset_limits_statistics(items):
    stats = by(ra.diff_column_stats(*items, ["id"], compare_columns=["value"]), "column")
    assert list(stats) == ["value"]
    assert stats["value"]["modified"] == 2
    assert stats["value"]["change_rate"] == pytest.approx(2 / 7)


def test_null_value_is_not_an_absent_row(spark):
    one = spark.createDataFrame([(7, 1.5), (8, None), (9, 2.5), (12, None)], "id int, v double")
    two = spark.createDataFrame([(9, 2.5), (7, 1.5)], "id int, v double")
    assert numbers(ra.diff_counts(one, two, ["id"])) == [0, 2, 0, 0, 4]
    assert numbers(ra.diff_counts(two, one, ["id"])) == [2, 0, 0, 0, 4]


def test_null_transitions(spark):
    one = spark.createDataFrame([(1, "x"), (2, None), (3, "y")], "id int, v string")
    two = spark.createDataFrame([(1, None), (2, "z"), (3, "y")], "id int, v string")
    s = by(ra.diff_column_stats(one, two, ["id"]), "column")["v"]
    assert (s["modified"], s["null_introduced"], s["null_resolved"]) == (2, 1, 1)


def test_depot(depot):
    counts = ra.diff_counts(*depot, ["id"])
    assert numbers(counts) == [3, 2, 6, 9, 20]
    assert only(counts)["is_full_count"] is False
    rules = ra.IgnoreRules(case=True, whitespace=True)
    assert numbers(ra.diff_counts(*depot, ["id"], rules=rules)) == [3, 2, 4, 11, 20]
    dates = ra.IgnoreRules(case=True, whitespace=True, date_format=True)
    assert numbers(ra.diff_counts(*depot, ["id"], rules=dates)) == [3, 2, 3, 12, 20]


def test_changed_columns_and_values(depot):
    changes = ra.diff_changes(*depot, ["id"], rules=ra.IgnoreRules(whitespace=True))
    assert changes.columns == [
        "id", "_change_type", "changed", "changed_raw",
        "label_f1", "place_f1", "kind_f1", "grams_f1", "checked_f1",
        "label_f2", "place_f2", "kind_f2", "grams_f2", "checked_f2", "_join_rows",
    ]
    rows = {r["id"]: r for r in changes.collect()}
    assert rows[9]["changed"] == ["kind"] and rows[9]["changed_raw"] == ["grams"]
    assert rows[5]["changed"] == [] and rows[5]["changed_raw"] == ["place", "grams"]
    assert (rows[3]["grams_f1"], rows[3]["grams_f2"]) == ("127", "127.0")
    assert rows[4]["_change_type"] == "removed" and rows[4]["label_f1"] == "bolt 4" and rows[4]["label_f2"] is None
    assert rows[31]["_change_type"] == "added" and rows[31]["label_f2"] == "nut 31"


def test_before_after_layout(depot):
    table = ra.diff_before_after(*depot, ["id"])
    assert table.columns[:6] == ["id", "change_type", "label_before", "label_after", "place_before", "place_after"]
    assert table.where("change_type = 'unchanged'").count() == 0


def test_sample_puts_unmatched_rows_first(depot):
    rows = ra.diff_sample(*depot, ["id"]).collect()
    assert [r["id"] for r in rows[:5]] == [4, 11, 31, 32, 33]
    assert [r["severity"] for r in rows[3:6]] == [1.0, 1.0, 0.5]
    assert rows[0]["f1"]["kind"] == "brass" and rows[0]["f2"] == {}
    assert [r["id"] for r in rows[5:]] == sorted(r["id"] for r in rows[5:])


def test_key_text_of_composite_and_null_keys(spark):
    one = spark.createDataFrame([("a", None, 1)], "k1 string, k2 int, v int")
    two = spark.createDataFrame([("a", 2, 1)], "k1 string, k2 int, v int")
    keys = {r["key"] for r in ra.diff_sample(one, two, ["k1", "k2"]).collect()}
    assert keys == {"a|None", "a|2"}


def test_column_map_applies_to_keys_and_skips_unknown(items):
    one, two = items
    renamed = two.toDF("nr", "name", "amount", "kind")
    names = [{"f1": "id", "f2": "nr"}, {"f1": "value", "f2": "amount"}, {"f1": "x"}, {"f1": "y", "f2": "none"}]
    assert numbers(ra.diff_counts(one, renamed, ["id"], column_map=names)) == [2, 1, 3, 0, 9]
    with pytest.raises(ValueError, match="several columns"):
        ra.diff_counts(one, two, ["id"], column_map=[{"f1": "value", "f2": "kind"}])


def test_null_vs_blank(spark):
    one = spark.createDataFrame([(1, ""), (2, "  "), (3, None), (4, "x")], "id int, v string")
    two = spark.createDataFrame([(1, None), (2, None), (3, ""), (4, None)], "id int, v string")
    assert numbers(ra.diff_counts(one, two, ["id"])) == [0, 0, 4, 0, 4]
    assert numbers(ra.diff_counts(one, two, ["id"], rules=ra.IgnoreRules(null_vs_blank=True))) == [0, 0, 1, 3, 4]


def test_date_rule_needs_a_real_date_and_states_the_order(spark):
    one = spark.createDataFrame([(1, "2023-11-03"), (2, "2023-02-30"), (3, "2023-03-11")], "id int, d string")
    two = spark.createDataFrame([(1, "11/03/2023"), (2, "02/30/2023"), (3, "11/03/2023")], "id int, d string")
    us = ra.IgnoreRules(date_format=True)
    eu = ra.IgnoreRules(date_format=True, date_formats=("yyyy-MM-dd", "dd/MM/yyyy"))
    assert numbers(ra.diff_counts(one, two, ["id"], rules=us)) == [0, 0, 2, 1, 3]
    assert {r["id"]: r["change_type"] for r in ra.diff_classified(one, two, ["id"], rules=eu).collect()} == {
        1: "modified", 2: "modified", 3: "formatting_only",
    }


def test_unicode_white_space(spark):
    one = spark.createDataFrame([(1, " 　x y "), (2, "\t\nz")], "id int, v string")
    two = spark.createDataFrame([(1, "x y"), (2, "z")], "id int, v string")
    assert numbers(ra.diff_counts(one, two, ["id"], rules=ra.IgnoreRules(whitespace=True))) == [0, 0, 0, 2, 2]


def test_rules_leave_keys_alone(spark):
    one = spark.createDataFrame([("K", 1)], "k string, v int")
    two = spark.createDataFrame([("k", 1)], "k string, v int")
    rules = ra.IgnoreRules(case=True, whitespace=True, null_vs_blank=True)
    assert numbers(ra.diff_counts(one, two, ["k"], rules=rules)) == [1, 1, 0, 0, 2]


def test_mixed_types_never_fail(spark):
    one = spark.createDataFrame([(1, 5, "x"), (2, 7, "8.0")], "id int, v int, w string")
    two = spark.createDataFrame([(1, "abc", 1.0), (2, "7", 8.0)], "id string, v string, w double")
    stats = by(ra.diff_column_stats(one, two, ["id"]), "column")
    assert stats["v"]["modified"] == 1 and stats["w"]["modified"] == 1


def test_zero_signs_large_numbers_and_nan(spark):
    one = spark.createDataFrame([(1, 0.0), (2, 12345678.0), (3, float("nan")), (4, 0.0001)], "id int, v double")
    two = spark.createDataFrame([(1, -0.0), (2, 12345678.0), (3, float("nan")), (4, 0.0001)], "id int, v double")
    kinds = {r["id"]: r["change_type"] for r in ra.diff_classified(one, two, ["id"]).collect()}
    assert kinds == {1: "formatting_only", 2: "unchanged", 3: "unchanged", 4: "unchanged"}
    text = spark.createDataFrame([(1, "0.0"), (2, "12345678.0"), (3, "NaN"), (4, "0.0001")], "id int, v string")
    assert only(ra.diff_counts(one, text, ["id"]))["unchanged_rows"] == 4


def test_nested_columns(spark):
    schema = "id int, a array<int>, m map<string,int>, s struct<x:int,y:string>"
    one = spark.createDataFrame([(1, [1, None], {"p": 1, "q": 2}, (1, "x")), (2, [1], {"p": 1}, None)], schema)
    two = spark.createDataFrame([(1, [1, None], {"q": 2, "p": 1}, (1, "x")), (2, [2], {"p": 2}, (1, None))], schema)
    stats = by(ra.diff_column_stats(one, two, ["id"]), "column")
    assert [stats[c]["modified"] for c in "ams"] == [1, 1, 1]
    assert only(ra.diff_counts(one, two, ["id"]))["modified_rows"] == 1


def test_headers_with_dots_blanks_and_quotes(spark):
    one = spark.createDataFrame([(1, "a", "b")], "id int, x string, y string").toDF("the id", "b.c", "it's `q`")
    two = spark.createDataFrame([(1, "A", "b")], "id int, x string, y string").toDF("the id", "b.c", "it's `q`")
    changes = ra.diff_changes(one, two, ["the id"]).first()
    assert changes["changed"] == ["b.c"] and changes["it's `q`_f1"] == "b"
    assert by(ra.profile_columns(one), "column")["it's `q`"]["distinct_count"] == 1


def test_no_shared_columns(spark):
    one = spark.createDataFrame([(1, "a")], "id int, x string")
    two = spark.createDataFrame([(1, "a")], "id int, y string")
    d = ra.diff(one, two, ["id"])
    assert numbers(d.counts()) == [0, 0, 0, 0, 1]
    assert d.column_stats().count() == 0 and d.changes().count() == 0 and d.sample().count() == 0


def test_empty_tables(spark):
    one = spark.createDataFrame([], "id int, x string")
    d = ra.diff(one, one, ["id"])
    assert numbers(d.counts()) == [0, 0, 0, 0, 0]
    assert only(d.counts())["is_full_count"] is True


def test_bad_requests(items):
    with pytest.raises(ValueError, match="no such column"):
        ra.diff_counts(*items, ["nope"])
    with pytest.raises(ValueError, match="at least one key"):
        ra.diff_counts(*items, [])


# ---- random tables against brute force ---------------------------------------------------------

SCHEMA = "k1 int, k2 string, t string, n double"


def random_table(rng: random.Random, rows: int, hot: float) -> list[tuple]:
    """Keys that repeat, one of them in a share ``hot`` of the rows, with nulls everywhere."""
    out = []
    for _ in range(rows):
        key = (7, "hot") if rng.random() < hot else (rng.choice([None, *range(12)]), rng.choice(["a", "b", None]))
        out.append((*key, rng.choice(["x", "X", " x", "y", "", None]), rng.choice([0.0, -0.0, 1.5, 2.0, None])))
    return out


def brute_force(one, two, rule):
    """Counters of the full join, pair by pair."""
    kinds, columns = Counter(), {c: Counter() for c in "tn"}
    matched = set()

    def raw(v):
        return v if v is None or isinstance(v, str) else repr(v)

    for a in one:
        partners = [j for j, b in enumerate(two) if None not in a[:2] and a[:2] == b[:2]]
        if not partners:
            kinds["removed"] += 1
        for j in partners:
            matched.add(j)
            worst = 0
            for c, x, y in (("t", a[2], two[j][2]), ("n", a[3], two[j][3])):
                sx, sy = (rule(x), rule(y)) if c == "t" else (x, y)
                if sx != sy:
                    columns[c]["modified"] += 1
                    columns[c]["null_introduced"] += sy is None
                    columns[c]["null_resolved"] += sx is None
                    worst = 2
                elif raw(x) != raw(y):
                    columns[c]["formatting_only"] += 1
                    worst = max(worst, 1)
            kinds[("unchanged", "formatting_only", "modified")[worst]] += 1
    kinds["added"] = len(two) - len(matched)
    return kinds, columns


@pytest.mark.parametrize("limits", [{}, {"hot_key_rows": 1}, {"hot_key_rows": 5}, {"hot_key_rows": 20}])
@pytest.mark.parametrize("seed", [1, 2])
def test_repeated_and_hot_keys_match_brute_force(spark, seed, limits):
    rng = random.Random(seed)
    one, two = random_table(rng, 60, 0.4), random_table(rng, 50, 0.3)
    two += [(99, "lone", "y", 1.0)]
    one += [(99, "lone", "x", 1.0)] * 9 + [(98, "left", "x", 1.0)] * 8
    two += [(97, "right", "x", 1.0)] * 8 + [(96, "pair", "x", 1.0)] * 7
    one += [(96, "pair", "X", 1.0)]

    def rule(v):
        return None if v is None else v.strip().lower()

    kinds, columns = brute_force(one, two, rule)
    d = ra.diff(
        spark.createDataFrame(one, SCHEMA).repartition(3),
        spark.createDataFrame(two, SCHEMA).repartition(2),
        ["k1", "k2"],
        rules=ra.IgnoreRules(case=True, whitespace=True),
        **limits,
    )
    r = only(d.statistics())
    got = {k: r[f"{k}_rows"] for k in ("added", "removed", "modified", "formatting_only", "unchanged")}
    assert got == {k: kinds[k] for k in got}
    assert r["rows_scanned"] == sum(kinds.values())
    for stat in r["column_stats"]:
        for k in ("modified", "formatting_only", "null_introduced", "null_resolved"):
            assert stat[k] == columns[stat["column"]][k], (stat["column"], k)
    assert only(d.counts())["modified_rows"] == kinds["modified"]

    # Every listing adds up to the counters.
    listed = d.classified().groupBy("change_type").agg(F.sum("join_rows").alias("n")).collect()
    assert {k: 0 for k in got} | {r["change_type"]: int(r["n"]) for r in listed} == got
    for table, kind, n in ((d.changes(), "_change_type", "_join_rows"), (d.before_after(), "change_type", "_join_rows")):
        listed = table.groupBy(kind).agg(F.sum(n).alias("n")).collect()
        changed = {k: v for k, v in got.items() if k != "unchanged"}
        assert {k: 0 for k in changed} | {r[kind]: int(r["n"]) for r in listed} == changed


@pytest.mark.parametrize(("n", "m"), [(2, 2), (8, 8), (9, 9), (100_000, 2), (100_001, 2)])
def test_a_repeated_key_is_listed_at_every_size(spark, tmp_path, n, m):
    one = spark.range(n).selectExpr("1 as k", "id as v", "'x' as t")
    two = spark.range(m).selectExpr("1 as k", "-1 - id as v", "'X' as t")
    d = ra.diff(one, two, ["k"], rules=ra.IgnoreRules(case=True))
    assert only(d.counts())["modified_rows"] == n * m
    stored = d.stored(str(tmp_path / "join"))
    assert only(stored.counts())["modified_rows"] == n * m
    for x in (d, stored):
        changes = x.changes()
        totals = only(changes.agg(F.count("*").alias("rows"), F.sum("_join_rows").alias("n"), F.count("v_f1"), F.count("v_f2")))
        assert [int(v) for v in totals.values()] == [n + m, n * m, n, m]
        assert {(tuple(r[0]), tuple(r[1])) for r in changes.select("changed", "changed_raw").distinct().collect()} == {(("v",), ("t",))}


def test_unknown_compare_columns_are_refused(items):
    with pytest.raises(ValueError, match="nothing"):
        ra.diff(*items, ["id"], compare_columns=["value", "nothing"])


def test_one_sided_hot_keys_are_listed_in_full(spark):
    one = spark.createDataFrame([(1, i % 3) for i in range(40)] + [(2, 0), (3, 0)] + [(4, 1)] * 20, "k int, v int")
    two = spark.createDataFrame([(1, 0), (2, 1)] + [(3, i) for i in range(30)], "k int, v int")
    d = ra.diff(one, two, ["k"], hot_key_rows=10)
    assert d._has_hot_keys and not d._has_factored_keys
    plain = ra.diff(one, two, ["k"])
    assert not plain._has_hot_keys
    assert Counter(d.classified().collect()) == Counter(plain.classified().collect())
    assert Counter(map(str, d.changes().collect())) == Counter(map(str, plain.changes().collect()))


# ---- properties ------------------------------------------------------------------------------


def test_identity_symmetry_conservation(spark):
    rng = random.Random(5)
    rows = [(i, rng.choice(["x", "X", None]), rng.random()) for i in range(200)]
    later = [(i, rng.choice(["x", "X", None]), v) for i, _, v in rows if i % 7] + [(500, "x", 0.5)]
    one = spark.createDataFrame(rows, "id int, t string, v double")
    two = spark.createDataFrame(later, "id int, t string, v double")
    same = only(ra.diff_counts(one, one, ["id"]))
    assert same["unchanged_rows"] == 200 and same["confidence_score"] == 0.95
    forth, back = only(ra.diff_counts(one, two, ["id"])), only(ra.diff_counts(two, one, ["id"]))
    assert (forth["added_rows"], forth["removed_rows"]) == (back["removed_rows"], back["added_rows"])
    assert forth["modified_rows"] == back["modified_rows"]
    matched = forth["modified_rows"] + forth["formatting_only_rows"] + forth["unchanged_rows"]
    assert matched == 200 - forth["removed_rows"] == len(later) - forth["added_rows"]
    rules = only(ra.diff_counts(one, two, ["id"], rules=ra.IgnoreRules(case=True)))
    assert rules["modified_rows"] <= forth["modified_rows"]
    assert rules["modified_rows"] + rules["formatting_only_rows"] == forth["modified_rows"]


def test_generated_snapshots_with_known_injections(spark):
    """A hundred thousand rows made by arithmetic, so that every count is known."""
    n = 100_000
    one = spark.range(n).selectExpr(
        "id", "concat('Name ', id) as name", "id * 10 as pay", "date_format(date_add(date'2020-01-01', int(id % 900)), 'yyyy-MM-dd') as since"
    )
    two = spark.range(n).where("id % 50 <> 0").selectExpr(
        "id",
        "case when id % 50 = 1 then upper(concat('Name ', id)) when id % 50 = 2 then concat(' Name ', id) else concat('Name ', id) end as name",
        "cast(case when id % 50 = 3 then null else id * 10 end as double) as pay",
        "case when id % 50 = 4 then date_format(date_add(date'2020-01-01', int(id % 900)), 'MM/dd/yyyy') "
        "else date_format(date_add(date'2020-01-01', int(id % 900)), 'yyyy-MM-dd') end as since",
    ).unionAll(spark.range(n, n + 1000).selectExpr("id", "'new'", "cast(1 as double)", "'2024-01-01'"))
    part = n // 50
    plain = numbers(ra.diff_counts(one, two, ["id"]))
    assert plain == [1000, part, 4 * part, n - 5 * part, n + 1000]
    all_rules = ra.IgnoreRules(case=True, whitespace=True, date_format=True)
    assert numbers(ra.diff_counts(one, two, ["id"], rules=all_rules)) == [1000, part, part, n - 2 * part, n + 1000]


def test_wide_tables_count_the_same(spark, monkeypatch):
    one = spark.range(300).selectExpr("id", *[f"cast(id % {i + 2} as string) as c{i}" for i in range(50)])
    two = spark.range(5, 310).selectExpr(
        "id",
        *[f"case when id % 9 = {i % 9} then null when id % 7 = 1 then concat(id % {i + 2}, ' ') "
          f"else cast(id % {i + 2} as string) end as c{i}" for i in range(50)],
    )
    d = ra.diff(one, two, ["id"], rules=ra.IgnoreRules(whitespace=True))
    wide = only(d.statistics())
    monkeypatch.setattr("rowaccord.operators.diff.WIDE_COLUMNS", 1000)
    assert wide == only(d.statistics())
    assert wide["formatting_only_rows"] == 0 and wide["added_rows"] == 10
    assert {s["null_introduced"] > 0 and s["formatting_only"] > 0 for s in wide["column_stats"]} == {True}


def test_stored_changes_give_the_same_tables(depot, tmp_path):
    d = ra.diff(*depot, ["id"], rules=ra.IgnoreRules(case=True))
    stored = d.stored(str(tmp_path / "join"))
    assert only(stored.counts()) == only(d.counts())
    assert stored.column_stats().collect() == d.column_stats().collect()
    assert Counter(map(str, stored.changes().collect())) == Counter(map(str, d.changes().collect()))


# ---- plans -----------------------------------------------------------------------------------


def plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def test_unique_keys_need_one_shuffle_per_side(spark, tmp_path):
    one = spark.range(1000).selectExpr("id", "id as a", "id as b", "id as unused")
    one.write.parquet(str(tmp_path / "t"))
    t = spark.read.parquet(str(tmp_path / "t"))
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        text = plan(ra.diff(t, t, ["id"], compare_columns=["a"]).counts())
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert text.count("Exchange hashpartitioning") == 2
    assert "FullOuter" in text
    assert "unused" not in text and "b#" not in text.split("ReadSchema", 1)[1].split("\n")[0]
    assert "CartesianProduct" not in text and "BroadcastNestedLoopJoin" not in text


def test_hot_path_has_no_product_join(spark):
    one = spark.createDataFrame([(1, i % 3) for i in range(40)] + [(2, 0)], "k int, v int")
    text = plan(ra.diff(one, one, ["k"], hot_key_rows=10).counts())
    assert "CartesianProduct" not in text and "BroadcastNestedLoopJoin" not in text


def test_bigint_and_double_are_equal_as_numbers_only(spark):
    nan, inf, top = float("nan"), float("inf"), 2**63
    longs = [9007199254740993, 9007199254740992, 5, -5, 0, top - 1, -top, None]
    doubles = [9007199254740992.0, 5.0, -5.0, -0.0, float(top), -float(top), 5.5, nan, inf, 1e300, None]
    one = spark.createDataFrame([(i, x) for i, x in enumerate(longs)], "id int, v bigint")
    for kind in ("double", "float"):
        two = spark.createDataFrame([(i, x) for i, x in enumerate(doubles)], f"id int, v {kind}")
        by_key = only(ra.diff(one.select("v"), two.select("v"), ["v"]).counts())
        # Equal: 2^53, 5, -5, 0 and -2^63; the nulls meet nothing.
        assert (by_key["removed_rows"], by_key["added_rows"]) == (3, 6)
    pairs = [(9007199254740993, 9007199254740992.0, "modified"), (9007199254740992, 9007199254740992.0, "same"), (top - 1, float(top), "modified"), (3, 3.0, "same"), (3, 3.5, "modified"), (None, None, "same"), (None, 1.0, "modified")]
    one = spark.createDataFrame([(i, a) for i, (a, _, _) in enumerate(pairs)], "id int, v bigint")
    two = spark.createDataFrame([(i, b) for i, (_, b, _) in enumerate(pairs)], "id int, v double")
    for left, right in ((one, two), (two, one)):
        assert only(ra.diff(left, right, ["id"]).counts())["modified_rows"] == sum(k == "modified" for *_, k in pairs)


def test_repeated_keys_are_dealt_once(spark):
    """Counts of keys that are not hot: no map of texts before a shuffle, and no shuffle by texts."""
    one = spark.createDataFrame([(i % 40, "A" if i % 3 else "a", i % 2) for i in range(200)], "k int, s string, v int")
    d = ra.diff(one, one.withColumn("v", F.expr("if(k % 5 = 0, null, v)")), ["k"], rules=ra.IgnoreRules(case=True))
    for df in (d.counts(), d.column_stats(), d.classified(), d.changes()):
        plan = df._jdf.queryExecution().executedPlan().toString()
        assert not re.search(r"Exchange hashpartitioning\([^)]*\b(sem|item)#", plan)


def test_classified_makes_no_outcomes_of_columns(spark):
    """Change types of repeated keys need numbers of copies only, and equal those that come with values."""
    rows = [(i % 30, "xY"[i % 2] if i % 7 else "y", None if i % 11 == 0 else i % 3) for i in range(300)]
    one = spark.createDataFrame(rows, "k int, s string, v int")
    for limit in (5, 100_000):
        d = ra.diff(one, one.where("v <> 1 or k > 3"), ["k"], rules=ra.IgnoreRules(case=True), hot_key_rows=limit)
        assert "md5" not in d.classified()._jdf.queryExecution().optimizedPlan().toString()

        def added_up(df):
            return {tuple(r) for r in df.groupBy("k", "change_type").agg(F.sum("n").cast("bigint"), F.count("*")).collect()}

        listed = d._listed.select(F.col("_k0").alias("k"), "change_type", F.coalesce("_n", F.lit(1)).alias("n"))
        found = d.classified().withColumnRenamed("join_rows", "n")
        assert added_up(found) == added_up(listed)
        kinds = {r.change_type: int(r.n) for r in found.groupBy("change_type").agg(F.sum("n").alias("n")).collect()}
        counts = d.counts().first()
        assert kinds["modified"] == counts.modified_rows and kinds["unchanged"] == counts.unchanged_rows
        assert kinds["formatting_only"] == counts.formatting_only_rows
