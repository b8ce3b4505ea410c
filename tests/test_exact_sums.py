"""Exact sums against fractions, and comparisons of equal rows in another order."""

from __future__ import annotations

import math
import random
from fractions import Fraction

import pytest
from pyspark.sql import functions as F

import rowaccord as ra
from rowaccord.functions.exact import places, sum_expression


def summed(df, column="x"):
    low, limbs = places([df], [column])[column]
    return {r.g: r.s for r in df.groupBy("g").agg(F.expr(sum_expression(column, low, limbs)).alias("s")).collect()}


def fractions(rows):
    total = {}
    for g, x in rows:
        total[g] = total.get(g, Fraction(0)) + Fraction(x)
    return total


@pytest.mark.parametrize(("low", "high"), [(0, 20), (-20, 40), (-300, 300), (-1060, 1000)])
def test_against_fractions(spark, low, high):
    rng = random.Random(high)
    rows = [(g, rng.choice([-1, 1]) * rng.random() * 2.0 ** rng.randint(low, high)) for g in range(12) for _ in range(60)]
    rows += [(20, 2.0**high), (20, 2.0**low), (20, -(2.0**high)), (21, 1.5), (21, -1.5), (22, -(2.0**low)), (23, -(2.0**high))]
    got = summed(spark.createDataFrame(rows, "g int, x double").repartition(7))
    for g, total in fractions(rows).items():
        want = float(total)
        assert got[g] == want or abs(got[g] - want) <= 2 * math.ulp(want), (g, got[g], want)
    assert got[20] == 2.0**low and got[21] == 0.0 and got[22] == -(2.0**low) and got[23] == -(2.0**high)
    if high - low <= 30:  # a narrow column is rounded once
        assert got == {g: float(t) for g, t in fractions(rows).items()}


def test_values_that_are_no_numbers(spark):
    inf, nan = float("inf"), float("nan")
    rows = [("a", 1.0), ("a", inf), ("b", inf), ("b", -inf), ("c", nan), ("c", 1.0), ("d", None), ("e", None), ("e", 0.5), ("f", -inf), ("z", -0.0)]
    got = summed(spark.createDataFrame(rows, "g string, x double"))
    assert (got["a"], got["d"], got["e"], got["f"], got["z"]) == (inf, None, 0.5, -inf, 0.0)
    assert math.isnan(got["b"]) and math.isnan(got["c"])
    assert summed(spark.createDataFrame([("n", None)], "g string, x double")) == {"n": None}
    assert summed(spark.createDataFrame([("f", 0.1), ("f", 0.2)], "g string, x float"))["f"] == pytest.approx(0.3, abs=1e-7)


def test_equal_rows_in_another_order_do_not_differ(spark):
    one = spark.range(200_000).selectExpr("id % 5 AS g", "rand(3) * pow(10, id % 12 - 4) AS x", "id").cache()
    two = one.orderBy(F.xxhash64("id")).repartition(11)
    assert ra.transactional_compare(one, two, ["g"], ["x"]).count() == 0
    plain = ra.aggregation_compare(one, two, ["g"], {"s": "sum(x)"}).count()
    assert plain > 0  # what plain sums make of the same rows
    changed = two.withColumn("x", F.expr("if(id = 77, x + 1e-3, x)"))
    assert [r.g for r in ra.transactional_compare(one, changed, ["g"], ["x"]).collect()] == [77 % 5]
    one.unpersist()


def test_equal_totals_of_other_parts_and_totals_of_groups(spark):
    one = spark.createDataFrame([("p", "x", 1.0), ("p", "x", 2.0), ("p", "y", 2.0**90), ("p", "y", 2.0**-40)], "g string, h string, v double")
    two = spark.createDataFrame([("p", "x", 3.0), ("p", "y", 2.0**-40), ("p", "y", 2.0**89), ("p", "y", 2.0**89)], "g string, h string, v double")
    full = ra.aggregation_compare(one, two, ["g", "h"], {"v": ra.ExactSum("v")}, only_mismatches=False, rollup=True)
    assert sorted((r._level, r.status) for r in full.collect()) == [(0, "equal"), (0, "equal"), (1, "equal"), (2, "equal")]
    whole = two.select("g", "h", F.col("v").cast("decimal(38,12)").alias("v"))
    mixed = ra.transactional_compare(one.where("h = 'x'"), whole.where("h = 'x'"), ["g"], ["v"]).first()
    assert mixed.count_differs and not mixed.sum_v_differs
    with pytest.raises(ValueError, match="table 2 sums"):
        ra.aggregation_compare(one, two.drop("v"), ["g"], {"v": ra.ExactSum("v")})
