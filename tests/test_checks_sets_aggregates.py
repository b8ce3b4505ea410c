from __future__ import annotations

import pytest

import rowaccord as ra
from tests.conftest import by, only


def found(df):
    return {(r["name"], r["column"]): r for r in df.collect()}


def test_depot_checks(depot):
    rows = ra.validate_pair(*depot, keys=["id"]).collect()
    by_table = {(r["table_no"], r["name"], r["column"]): r for r in rows}
    assert by_table[(2, "Mixed Types", "checked")]["affected_count"] == 1
    assert (1, "Mixed Types", "checked") not in by_table
    assert by_table[(2, "Duplicate Keys", "id")]["severity"] == "WARNING"
    assert (1, "Duplicate Keys", "id") not in by_table
    assert by_table[(1, "Row Count", None)]["affected_count"] == 16
    # Two columns changed places (5 points) and one changed its type (3 points).
    assert {r["compatibility_score"] for r in rows} == {92.0}


def test_null_rate_thresholds_are_strict(spark):
    df = spark.createDataFrame([("x", None, None), (None, None, "x")] * 5, "half string, gone string, also string")
    c = found(ra.checks(df))
    assert ("High Null Rate", "half") not in c
    assert c[("High Null Rate", "gone")]["severity"] == "ERROR"
    low = found(ra.checks(df, ra.ValidationConfig(null_warn_threshold=0.4)))
    assert low[("High Null Rate", "half")]["severity"] == "WARNING"
    assert low[("High Null Rate", "half")]["affected_count"] == 5


def test_key_checks(spark):
    df = spark.createDataFrame([(1,), (1,), (1,), (None,)], "k int")
    c = found(ra.checks(df, keys=["k"]))
    assert c[("Duplicate Keys", "k")]["severity"] == "CRITICAL"
    assert c[("Duplicate Keys", "k")]["affected_count"] == 2
    assert c[("Key Column Nulls", "k")]["affected_count"] == 1


def test_rules(spark):
    df = spark.createDataFrame(
        [("5", "ab", "x"), ("50", "cd", None), ("n/a", "12", "y"), (None, "ef", "x")], "num string, code string, flag string"
    )
    rules = [
        ra.ColumnRule("num", max_null_rate=0.2, min_value=1, max_value=10),
        ra.ColumnRule("code", regex_pattern="^[a-z]+$"),
        ra.ColumnRule("flag", required=True, allowed_values=["x"]),
        ra.ColumnRule("gone", required=True),
        ra.ColumnRule("num", expected_type="date"),
        ra.ColumnRule("code", max_null_rate=0.5),
    ]
    rows = [(r["column"], r["severity"], r["affected_count"]) for r in ra.rule_checks(df, rules).collect()]
    assert sorted(rows, key=str) == sorted(
        [
            ("num", "ERROR", 1),  # null rate
            ("num", "ERROR", 1),  # above 10
            ("num", "ERROR", 1),  # no number
            ("code", "ERROR", 1),
            ("flag", "ERROR", 1),  # missing
            ("flag", "ERROR", 1),  # not allowed
            ("gone", "ERROR", None),
            ("num", "ERROR", 1),  # two of the three present values read as integer, not date
            ("code", "INFO", None),
        ],
        key=str,
    )


def test_rule_messages_take_any_name(spark):
    df = spark.createDataFrame([(1,)], "x int").toDF("it's 100% `x`")
    r = only(ra.rule_checks(df, [ra.ColumnRule("it's 100% `x`", min_value=0)]))
    assert (r["severity"], r["column"]) == ("INFO", "it's 100% `x`")


def test_unknown_type_label(spark):
    with pytest.raises(ValueError, match="expected_type"):
        ra.rule_checks(spark.range(1), [ra.ColumnRule("id", expected_type="int")])


def test_summary_is_zero_filled(depot):
    s = by(ra.check_summary(ra.checks(depot[0])), "severity")
    assert {k: v["checks"] for k, v in s.items()} == {"INFO": 1, "WARNING": 0, "ERROR": 0, "CRITICAL": 0}


def test_schema_drift(spark):
    one, two = spark.createDataFrame([(1, 2, 3)], "a int, b int, d int"), spark.createDataFrame([(1, 2)], "a int, c int")
    rows = {r["table_no"]: r["message"] for r in ra.schema_drift_checks(one, two).collect()}
    assert rows[1].endswith("b, d") and rows[2].endswith("c")
    assert ra.schema_drift_checks(one, one).count() == 0


def test_value_sets(spark):
    one = spark.createDataFrame([("x", 1), ("y", 2), (None, 3), ("x", None)], "a string, n int")
    two = spark.createDataFrame([("y", 2), ("z", 9), ("w", 3)], "b string, n bigint")
    counts = by(ra.value_set_counts(one, two, [("a", "b"), ("n", "n")]), "f1_col")
    assert [counts["a"][f"{k}_count"] for k in ("only_in_f1", "only_in_f2", "in_both")] == [1, 2, 1]
    assert [counts["n"][f"{k}_count"] for k in ("only_in_f1", "only_in_f2", "in_both")] == [1, 1, 2]
    first = ra.value_set_members(one, two, [("a", "b")], limit=1).collect()
    assert {(r["bucket"], r["value"]) for r in first} == {("only_in_f1", "x"), ("only_in_f2", "w"), ("in_both", "y")}
    assert ra.value_set_members(one, two, [("a", "b")], limit=None).count() == 4
    mixed = by(ra.value_set_counts(one, two, [("a", "nope"), ("n", "n")]), "f1_col")
    assert mixed["a"]["error"] == "table 2 has no column 'nope'" and mixed["a"]["in_both_count"] is None
    assert mixed["n"]["error"] is None and mixed["n"]["in_both_count"] == 2
    assert only(ra.value_set_counts(one, two, [("x", "y")]))["error"].count("no column") == 2
    assert only(ra.value_set_counts(one.limit(0), two.limit(0), [("a", "b")]))["only_in_f1_count"] == 0


def test_rules_from_a_request():
    assert ra.IgnoreRules.from_dict(None, ignore_case=True) == ra.IgnoreRules(case=True)
    assert ra.IgnoreRules.from_dict({"ignore_whitespace": True}, ignore_case=True) == ra.IgnoreRules(case=True, whitespace=True)
    assert ra.IgnoreRules.from_dict({"ignore_case": False, "normalize_dates": True, "ignore_null_vs_blank": 1}, True) == (
        ra.IgnoreRules(date_format=True, null_vs_blank=True)
    )


def test_transactional_compare(spark):
    one = spark.createDataFrame([("p", 1.0), ("p", 2.0), ("q", 5.0), ("r", 1.0), (None, 1.0)], "k string, x double")
    two = spark.createDataFrame([("p", 3.0), ("q", 6.0), ("s", 1.0), (None, 1.0)], "k string, x double")
    rows = by(ra.transactional_compare(one, two, ["k"], ["x"]), "k")
    assert {k: r["status"] for k, r in rows.items()} == {
        "p": "differs", "q": "differs", "r": "only_in_f1", "s": "only_in_f2",
    }
    assert rows["p"]["count_differs"] and not rows["p"]["sum_x_differs"]
    assert rows["q"]["sum_x_differs"] and not rows["q"]["count_differs"]


def test_tolerance(spark):
    one = spark.createDataFrame([("p", 0.1)] * 10 + [("n", None)], "k string, x double")
    two = spark.createDataFrame([("p", 1.0 + 1e-12), ("n", None)], "k string, x double")
    measures = {"total": "sum(x)"}
    assert ra.aggregation_compare(one, two, ["k"], measures).count() == 1
    assert ra.aggregation_compare(one, two, ["k"], measures, tolerance=1e-9).count() == 0


def test_rollup_totals(spark):
    one = spark.createDataFrame([("a", "x", 1), ("a", "y", 2)], "g string, h string, v int")
    two = spark.createDataFrame([("a", "x", 1), ("a", "y", 3)], "g string, h string, v int")
    rows = ra.aggregation_compare(one, two, ["g", "h"], {"v": "sum(v)"}, rollup=True).collect()
    assert sorted(r["_level"] for r in rows) == [0, 1, 2]


def test_multi_compare(depot):
    one, two = depot
    rows = by(ra.multi_compare(one, {"same": one, "later": two}), "candidate")
    assert rows["same"]["unchanged_rows"] == 16 and rows["later"]["modified_rows"] == 6


def test_compare_with_two_key_names_and_fallback_key(depot):
    one, two = depot
    renamed = two.withColumnRenamed("id", "nr")
    c = ra.compare(one, renamed, keys=["id"], keys_2=["nr"])
    assert only(c.counts())["modified_rows"] == 6
    assert only(c.score())["in_both"] == 6
    assert ra.compare(one, two).keys == ["id"]
    no_key = one.selectExpr("kind", "grams % 2 as odd")
    assert ra.compare(no_key, no_key).keys in (["kind"], ["kind", "odd"])


def test_preview_keeps_partners_together(spark):
    one = spark.range(2000).selectExpr("id", "id as v")
    two = spark.range(2000).selectExpr("cast(id as int) as id", "id as v")
    r = only(ra.compare(one, two, keys=["id"], preview=0.1).counts())
    assert r["added_rows"] == r["removed_rows"] == 0 and r["is_full_count"] is False
    assert 100 < r["rows_scanned"] < 300
