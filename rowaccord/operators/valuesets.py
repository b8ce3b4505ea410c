"""Comparing the sets of distinct values of column pairs."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text
from ..functions.names import quote, require_columns

SAMPLE_MEMBERS = 500


def value_sets(df1: DataFrame, df2: DataFrame, pairs: Sequence[tuple[str, str]]) -> DataFrame:
    """``pair, f1_col, f2_col, value, bucket`` for every distinct present value of every pair.

    Values compare as text. Both sides of all pairs meet in one aggregate, so frequent
    values collapse before the shuffle; ``bucket`` is ``only_in_f1``, ``only_in_f2`` or ``in_both``.
    """
    require_columns(df1, [p[0] for p in pairs], "table 1")
    require_columns(df2, [p[1] for p in pairs], "table 2")

    def side(df: DataFrame, n: int) -> DataFrame:
        """Long form ``pair, value`` of the wanted columns from one scan."""
        entries = [
            f"named_struct('pair', {i}, 'value', {text.render(quote(p[n]), df.schema[p[n]].dataType)})"
            for i, p in enumerate(pairs)
        ]
        return df.selectExpr(f"inline(array({', '.join(entries)}))", f"{str(n == 0).lower()} AS first").where(
            "value IS NOT NULL"
        )

    members = (
        side(df1, 0)
        .unionAll(side(df2, 1))
        .groupBy("pair", "value")
        .agg(F.bool_or("first").alias("in_1"), F.bool_or(~F.col("first")).alias("in_2"))
    )
    bucket = "CASE WHEN NOT in_2 THEN 'only_in_f1' WHEN NOT in_1 THEN 'only_in_f2' ELSE 'in_both' END"

    def names(n: int):
        return reduce(
            lambda c, p: c.when(F.col("pair") == p[0], F.lit(p[1][n])), list(enumerate(pairs)), F.when(F.lit(False), "")
        )

    return members.select(
        "pair", names(0).alias("f1_col"), names(1).alias("f2_col"), "value", F.expr(bucket).alias("bucket")
    )


def value_set_counts(df1: DataFrame, df2: DataFrame, pairs: Sequence[tuple[str, str]]) -> DataFrame:
    """One row per pair: how many distinct values are only in table 1, only in table 2, in both.

    A pair that names a column its table lacks gives a row with ``error`` and no counts; the
    other pairs are compared all the same. An empty pair of columns counts zero.
    """
    errors, good = {}, {}
    for i, (c1, c2) in enumerate(pairs):
        lacking = [f"table {n} has no column {c!r}" for n, c, df in ((1, c1, df1), (2, c2, df2)) if c not in df.columns]
        if lacking:
            errors[i] = "; ".join(lacking)
        else:
            good[len(good)] = i
    names = [(i, c1, c2, errors.get(i)) for i, (c1, c2) in enumerate(pairs)]
    listed = df1.sparkSession.createDataFrame(names, "pair int, f1_col string, f2_col string, error string")
    buckets = ("only_in_f1", "only_in_f2", "in_both")
    if not good:
        return listed.selectExpr(
            "pair", "f1_col", "f2_col", *[f"CAST(NULL AS BIGINT) AS {b}_count" for b in buckets], "error"
        )
    place = " ".join(f"WHEN {k} THEN {i}" for k, i in good.items())
    counts = (
        value_sets(df1, df2, [pairs[i] for i in good.values()])
        .groupBy(F.expr(f"CASE pair {place} END").alias("pair"))
        .agg(*[F.expr(f"count_if(bucket = '{b}')").alias(b) for b in buckets])
    )
    # One row per pair on both sides.
    return listed.join(F.broadcast(counts), "pair", "left").selectExpr(
        "pair",
        "f1_col",
        "f2_col",
        *[f"CASE WHEN error IS NULL THEN coalesce({b}, 0L) END AS {b}_count" for b in buckets],
        "error",
    )


def value_set_members(
    df1: DataFrame, df2: DataFrame, pairs: Sequence[tuple[str, str]], limit: int | None = SAMPLE_MEMBERS
) -> DataFrame:
    """The smallest ``limit`` values of each bucket of each pair with their ``rank``.

    Every task passes on at most ``limit`` values per bucket. ``limit=None`` lists all members,
    without a rank and without the sort.
    """
    sets = value_sets(df1, df2, pairs)
    if limit is None:
        return sets
    order = Window.partitionBy("pair", "bucket").orderBy("value")
    return sets.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= limit)
