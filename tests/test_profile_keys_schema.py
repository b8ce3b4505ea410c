from __future__ import annotations

import pytest

import rowaccord as ra
from rowaccord.operators.keys import check_keys
from tests.conftest import by, only


def profile_of(spark, values, dtype="string"):
    return only(ra.profile_column(spark.createDataFrame([(v,) for v in values], f"v {dtype}"), "v"))


def test_four_kinds_of_null(spark):
    df = spark.createDataFrame(
        [(None, "", "7"), (11, "  ", "n/a"), (None, "x", "-"), (14, "", None), (15, "y", "3"), (16, "", "4"), (None, "z", "5"), (18, "w", "6")],
        "id bigint, name string, value string",
    )
    p = by(ra.profile_columns(df), "column")
    assert p["id"]["null_count"] == 3
    assert (p["name"]["empty_count"], p["name"]["whitespace_count"]) == (3, 1)
    assert (p["value"]["null_count"], p["value"]["textual_null_count"]) == (1, 2)
    assert p["value"]["null_variant_rate"] == pytest.approx(3 / 8)
    assert by(ra.profile_nulls(df), "column")["name"]["total_null_variants"] == 4


def test_every_textual_null_and_nan(spark):
    words = ["NULL", "None", "na", "N/A", "#n/a", "NaN", "nil", "Missing", "unknown", "undefined", "n.a.", "n.a", "-"]
    assert profile_of(spark, words + ["nothing"])["textual_null_count"] == 13
    assert profile_of(spark, [1.0, float("nan"), None], "double")["textual_null_count"] == 1


@pytest.mark.parametrize(
    ("values", "inferred", "invalid"),
    [
        (["1001", "1002", "-3", "+4"], "integer", 0),
        (["Ann", "Bob", "Cy"], "string", 0),
        (["1.5", "2", ".5", "1e3"], "float", 0),
        (["true", "FALSE", "True"], "boolean", 0),
        (["1998-07-04"] * 5 + ["07/05/1998", "07/06/1998"], "date", 2),
        (["2021-01-15 10:00:00", "2021-01-15T10:00:00", "2021-01-16 10:30"], "datetime", 0),
        (["2021-02-30", "2021-13-01", "x"], "string", 0),
        (["2021-01-15 25:00:00"], "string", 0),
        (["15.01.2021", "31.12.2020"], "date", 0),
        (["99999999999999999999"], "float", 0),
        (["1", "2", "N/A"], "integer", 1),
        ([" 7 ", "1.5d", "t"], "string", 0),
        ([None, None], "string", 0),
        ([], "string", 0),
        (["7\n"], "string", 0),
    ],
)
def test_type_inference(spark, values, inferred, invalid):
    p = profile_of(spark, values)
    assert (p["inferred_type"], p["invalid_parse_count"]) == (inferred, invalid)


def test_threshold_prefers_the_earlier_type(spark):
    mostly = ["5"] * 95 + ["x"] * 5
    assert profile_of(spark, mostly)["inferred_type"] == "integer"
    mixed = ["5"] * 90 + ["5.5"] * 10
    p = profile_of(spark, mixed)
    assert (p["inferred_type"], p["invalid_parse_count"]) == ("float", 0)


def test_mixed_dates_share(spark):
    p = profile_of(spark, ["1998-07-04"] * 5 + ["07/05/1998", "07/06/1998"])
    assert p["type_distribution"] == {"date": pytest.approx(5 / 7), "string": pytest.approx(2 / 7)}


def test_typed_columns_keep_their_type(spark):
    df = spark.sql(
        "select 1L as i, 1.0D as f, true as b, date'2020-01-01' as d, timestamp'2020-01-01 00:00:00' as t, array(1) as a"
    )
    p = by(ra.profile_types(df), "column")
    assert [p[c]["inferred_type"] for c in "ifbdta"] == ["integer", "float", "boolean", "date", "datetime", "string"]


def test_distinct_min_max_samples(spark):
    df = spark.createDataFrame([("10", 10), ("9", 9), (None, None), ("9", 9), ("a", 100)], "s string, n int")
    p = by(ra.profile_columns(df), "column")
    assert (p["s"]["distinct_count"], p["n"]["distinct_count"]) == (4, 4)
    assert (p["n"]["min_text"], p["n"]["max_text"]) == ("10", "9")
    assert (p["n"]["min_value"], p["n"]["max_value"]) == ("9", "100")
    assert p["s"]["sample_values"] == ["10", "9", "a"]
    many = spark.range(50).selectExpr("cast(id as string) as v")
    assert only(ra.profile_column(many, "v"))["sample_values"] == ["0", "1", "10", "11", "12"]


def test_row_by_row_profile_agrees(spark):
    df = spark.createDataFrame(
        [("1", 1.0, None), ("x", 12345678.0, "2020-01-01"), ("N/A", None, "")], "a string, b double, c string"
    )
    exact = ra.profile_columns(df, samples=False).collect()
    assert ra.profile_columns(df, exact=False, samples=False).collect() == exact


def test_wide_tables_are_cut_into_chunks(spark):
    df = spark.range(3).selectExpr(*[f"cast(id + {i} as string) as c{i}" for i in range(60)])
    rows = ra.profile_parse_counts(df).collect()
    assert [r["position"] for r in rows] == list(range(60))
    assert all(r["integer_count"] == 3 for r in rows)


# ---- keys ------------------------------------------------------------------------------------


def test_discover_single_key(spark):
    df = spark.createDataFrame([(3 * i, f"half {i // 2}", i % 4) for i in range(12)], "nr int, half string, grp int")
    rows = ra.discover_keys(df).collect()
    assert rows[0]["columns"] == ["nr"] and rows[0]["recommended"] and rows[0]["is_unique"]
    assert by(ra.discover_keys(df).selectExpr("columns[0] as c", "*"), "c")["grp"]["uniqueness_ratio"] == pytest.approx(1 / 3)
    assert sum(r["recommended"] for r in rows) == 1


@pytest.mark.parametrize("n", [200, 300, 700])
def test_estimates_lose_no_composite_key(spark, n):
    grid = spark.range(n * n).selectExpr("'x' as fixed", f"id div {n} as store", f"id % {n} as day")
    assert sorted(ra.discover_keys(grid, exact=False).first()["columns"]) == ["day", "store"]


def test_discover_pairs_then_triples(spark):
    rows = [(a, b, c) for a in range(3) for b in range(3) for c in range(3)]
    df = spark.createDataFrame(rows, "a int, b int, c int")
    best = ra.discover_keys(df).first()
    assert sorted(best["columns"]) == ["a", "b", "c"] and best["confidence"] == 0.85
    pairs = ra.discover_keys(df.where("c = 0"))
    assert sorted(pairs.first()["columns"]) == ["a", "b"]
    assert ra.discover_keys(df.limit(0)).count() == 0


@pytest.mark.parametrize("exact", [True, False])
def test_key_column_with_few_values_in_a_wide_table(spark, exact):
    more = [f"id div 4 * {p} % {100 + k} as more{k}" for k, p in enumerate((7, 11, 13, 17, 19, 23))]
    df = spark.range(2000).selectExpr("id div 4 % 20 as store", "id div 80 as day", "id % 4 as line", *more)
    rows = [r for r in ra.discover_keys(df, exact=exact).collect() if r["is_unique"]]
    assert ["day", "line", "store"] in [sorted(r["columns"]) for r in rows] and all("line" in r["columns"] for r in rows)


def test_estimates_only_settle_what_is_far_from_unique(spark):
    df = spark.range(5000).selectExpr("id", "id % 4990 as near", "id % 70 as few", "cast(null as int) as none")
    rows = {r["columns"][0]: r for r in ra.discover_keys(df, exact=False).collect()}
    assert rows["id"]["uniqueness_ratio"] == 1.0 and rows["near"]["uniqueness_ratio"] == 4990 / 5000
    assert abs(rows["few"]["uniqueness_ratio"] - 70 / 5000) < 0.002 and not rows["few"]["is_unique"]
    pairs = df.selectExpr("int(id / 70) as a", "id % 70 as b", "few")
    assert sorted(ra.discover_keys(pairs, exact=False).first()["columns"]) == ["a", "b"]


def test_null_lowers_confidence(spark):
    df = spark.createDataFrame([(1,), (2,), (3,), (None,)], "id int")
    r = only(ra.discover_keys(df))
    assert (r["uniqueness_ratio"], r["null_rate"], r["confidence"]) == (1.0, 0.25, 0.75)


def test_validate_key_counts_nulls_as_equal(spark):
    df = spark.createDataFrame([(1, None), (1, None), (2, "x"), (None, None)], "a int, b string")
    r = only(ra.validate_key(df, ["a", "b"]))
    assert (r["total_rows"], r["distinct_keys"], r["duplicate_rows"], r["is_unique"]) == (4, 3, 1, False)
    assert only(ra.key_nulls(df, ["a", "b"]))["null_key_rows"] == 3


def test_key_multiplicity(spark):
    one = spark.createDataFrame([(1,), (1,), (2,), (None,), (None,)], "k int")
    two = spark.createDataFrame([(1,), (1,), (1,), (2,), (3,)], "k bigint")
    rows = {r["k"]: (r["rows_f1"], r["rows_f2"], int(r["join_rows"])) for r in ra.key_multiplicity(one, two, ["k"]).collect()}
    assert rows == {1: (2, 3, 6), None: (2, 0, 2)}
    check = check_keys(one, two, ["k"])
    assert (check.duplicates_1, check.duplicates_2, check.null_rows_1, check.join_rows) == (2, 2, 2, 6 + 1 + 1 + 2)
    assert (check.most_rows_1, check.most_rows_2, check.repeated_on_both) == (2, 3, 1)


def test_suggest_keys(spark):
    one = spark.createDataFrame([(1, "a"), (2, "a")], "id int, t string")
    two = spark.createDataFrame([(1, "a"), (1, "b")], "id int, t string")
    rows = {tuple(r["columns"]): r for r in ra.suggest_keys(one, two).collect()}
    assert rows[("id",)]["is_unique_f1"] is True and rows[("id",)]["is_unique_f2"] is False
    assert rows[("t",)]["unique_rate_f2"] == 1.0


# ---- schemas ---------------------------------------------------------------------------------


def table(spark, ddl):
    return spark.createDataFrame([], ddl)


def test_schema_compare_and_score(spark):
    one, two = table(spark, "id int, name string, value double"), table(spark, "name string, id bigint, amount double")
    s = by(ra.compare_schemas(one, two), "name")
    assert {n: r["status"] for n, r in s.items()} == {
        "amount": "only_in_2", "id": "both", "name": "both", "value": "only_in_1",
    }
    assert s["id"]["same_type"] is False and s["id"]["moved"] is True
    r = only(ra.schema_score(one, two))
    assert r["score"] == 100 - 5 - 2 - 5 - 3 and r["reordered"] is True
    assert only(ra.schema_score(one, one))["score"] == 100


def test_score_is_clamped(spark):
    one = table(spark, ", ".join(f"c{i} int" for i in range(30)))
    assert only(ra.schema_score(one, table(spark, "x int")))["score"] == 0


def test_column_lookup_is_case_sensitive(spark):
    s = by(ra.compare_schemas(table(spark, "ID int"), table(spark, "id int")), "name")
    assert {n: r["status"] for n, r in s.items()} == {"ID": "only_in_1", "id": "only_in_2"}


def test_rename_candidates(spark):
    one, two = table(spark, "CustomerName string, value int"), table(spark, "customer_name string, amount int")
    rows = [tuple(r) for r in ra.rename_candidates(one, two).collect()]
    assert rows == [("CustomerName", "customer_name", 0.923)]
