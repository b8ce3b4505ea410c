"""Comparing tables whose keys repeat: by counts and sums per key, or by any aggregate per group."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.exact import ExactSum, places, sum_expression
from ..functions.names import col, quote, require_columns
from ..functions.text import is_float


def aggregation_compare(
    df1: DataFrame,
    df2: DataFrame,
    group: Sequence[str],
    measures: Mapping[str, str | ExactSum],
    only_mismatches: bool = True,
    tolerance: float = 0.0,
    rollup: bool = False,
) -> DataFrame:
    """Compare aggregates per group; ``measures`` maps names to SQL aggregates such as ``sum(x)``, or to an
    :class:`ExactSum`, which gives equal rows equal sums of a floating-point column in whatever order they come.

    Each side is aggregated before anything is joined, so a group that fills a third of a
    table reaches the shuffle as one row per task. Groups match null-safely. Columns: the
    group, ``status`` (``only_in_f1``, ``only_in_f2``, ``differs``, ``equal``), and per measure
    ``{m}_f1``, ``{m}_f2``, ``{m}_differs``. Numbers differ when they are more than
    ``tolerance`` apart, relative to the larger one: plain sums of floats depend on their order.
    ``rollup`` adds the totals per leading group columns; ``_level`` counts the rolled up ones.
    """
    require_columns(df1, group, "table 1 groups")
    require_columns(df2, group, "table 2 groups")
    keys = [f"_g{i}" for i in range(len(group))]
    exact = sorted({m.column for m in measures.values() if isinstance(m, ExactSum)})
    for df, what in ((df1, "table 1 sums"), (df2, "table 2 sums")):
        require_columns(df, exact, what)
    cuts = places([df1, df2], exact) if exact else {}

    def aggregate(measure: str | ExactSum, df: DataFrame) -> str:
        if not isinstance(measure, ExactSum):
            return measure
        if not is_float(df.schema[measure.column].dataType):
            return f"sum({quote(measure.column)})"
        return sum_expression(measure.column, *cuts[measure.column])

    def side(df: DataFrame, n: int) -> DataFrame:
        columns = [col(g).alias(k) for k, g in zip(keys, group)]
        aggs = [F.expr(aggregate(m, df)).alias(f"_m{i}_{n}") for i, m in enumerate(measures.values())]
        if rollup:
            level = F.expr(" + ".join(f"int(grouping({k}))" for k in keys)).alias("_level")
            grouped = df.select("*", *columns).rollup(*keys).agg(level, *aggs)
        else:
            grouped = df.select("*", *columns).groupBy(*keys).agg(F.lit(0).alias("_level"), *aggs)
        return grouped.withColumn(f"_in{n}", F.lit(True))

    one, two = side(df1, 1), side(df2, 2)
    two = two.select(*[F.col(k).alias(k + "_2") for k in [*keys, "_level"]], *[c for c in two.columns if c not in {*keys, "_level"}])
    match = reduce(lambda x, y: x & y, [F.col(k).eqNullSafe(F.col(k + "_2")) for k in [*keys, "_level"]])
    joined = one.join(two, match, "full")

    def differs(i: int) -> Column:
        a, b = F.col(f"_m{i}_1"), F.col(f"_m{i}_2")
        if not tolerance:
            return ~a.eqNullSafe(b)
        near = F.abs(a - b) <= F.greatest(F.abs(a), F.abs(b)) * tolerance
        return ~(F.coalesce(near, F.lit(False)) | a.eqNullSafe(b))

    names = list(measures)
    in_both = F.col("_in1").isNotNull() & F.col("_in2").isNotNull()
    any_differs = reduce(or_, [differs(i) for i in range(len(names))], F.lit(False))
    status = (
        F.when(F.col("_in2").isNull(), F.lit("only_in_f1"))
        .when(F.col("_in1").isNull(), F.lit("only_in_f2"))
        .when(any_differs, F.lit("differs"))
        .otherwise(F.lit("equal"))
    )
    outputs = []
    for i, m in enumerate(names):
        outputs += [
            F.col(f"_m{i}_1").alias(f"{m}_f1"),
            F.col(f"_m{i}_2").alias(f"{m}_f2"),
            (in_both & differs(i)).alias(f"{m}_differs"),
        ]
    result = joined.select(
        *[F.when(F.col("_in1"), F.col(k)).otherwise(F.col(k + "_2")).alias(g) for k, g in zip(keys, group)],
        *([F.coalesce("_level", "_level_2").alias("_level")] if rollup else []),
        status.alias("status"),
        *outputs,
    )
    return result.where(F.col("status") != "equal") if only_mismatches else result


def transactional_compare(
    df1: DataFrame,
    df2: DataFrame,
    keys: Sequence[str],
    sum_columns: Sequence[str] = (),
    only_mismatches: bool = True,
    tolerance: float = 0.0,
) -> DataFrame:
    """For tables where keys repeat by design: row count and sums per key, and which differ.

    Sums of floating-point columns are exact until the last rounding, so they do not depend on the order of rows.
    """
    require_columns(df1, sum_columns, "table 1 sums")
    require_columns(df2, sum_columns, "table 2 sums")
    floats = {c for c in sum_columns if any(is_float(df.schema[c].dataType) for df in (df1, df2))}
    sums = {f"sum_{c}": ExactSum(c) if c in floats else f"sum({quote(c)})" for c in sum_columns}
    measures = {"count": "count(1)", **sums}
    return aggregation_compare(df1, df2, keys, measures, only_mismatches, tolerance)


def aggregate_summary(compared: DataFrame, measures: Sequence[str]) -> DataFrame:
    """One row of counts over a full comparison: keys per status and per differing measure."""
    aggs = [F.count(F.lit(1)).alias("keys")]
    for s in ("only_in_f1", "only_in_f2", "differs"):
        aggs.append(F.count_if(F.col("status") == s).alias(s))
    aggs += [F.count_if(col(f"{m}_differs")).alias(f"{m}_differs") for m in measures]
    return compared.groupBy().agg(*aggs)
