"""Key discovery, key verification and repeated keys."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass
from decimal import Decimal
from functools import reduce
from itertools import combinations
from operator import and_, or_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text
from ..functions.compare import common_type, key_text
from ..functions.names import chunks, col, quote, require_columns

# Thresholds and weights of the key ranking, and the column groups that one job counts.
UNIQUE_RATIO = 0.99
COMPOSITE_CONFIDENCE = 0.85
GROUPS_PER_JOB = 40

_LONG_MAX = 2**63 - 1


def key_names(n: int) -> list[str]:
    return [f"_k{i}" for i in range(n)]


def key_columns(a: DataFrame, b: DataFrame, keys: Sequence[str]) -> tuple[list[Column], list[Column]]:
    """Key expressions of both sides in one common type per key, named ``_k0, _k1, …``."""
    require_columns(a, keys, "table 1 keys")
    require_columns(b, keys, "table 2 keys")
    left, right = [], []
    for name, k in zip(key_names(len(keys)), keys):
        t1, t2 = a.schema[k].dataType, b.schema[k].dataType
        common = common_type(t1, t2)
        if common is None:
            c1, c2 = F.expr(key_text(quote(k), t1, t2)), F.expr(key_text(quote(k), t2, t1))
        else:
            c1 = col(k) if t1 == common else col(k).cast(common)
            c2 = col(k) if t2 == common else col(k).cast(common)
        left.append(c1.alias(name))
        right.append(c2.alias(name))
    return left, right


def any_null(names: Sequence[str]) -> Column:
    return reduce(or_, [F.col(n).isNull() for n in names])


def none_null(names: Sequence[str]) -> Column:
    return reduce(and_, [F.col(n).isNotNull() for n in names])


def rows_per_key(a: DataFrame, b: DataFrame, keys: Sequence[str]) -> DataFrame:
    """``_k*, rows_1, rows_2``: how often each key occurs on either side.

    Both sides go through one aggregate, so a key that fills a third of a table is
    counted map-side and reaches the shuffle as one row per task.
    """
    left, right = key_columns(a, b, keys)
    both = a.select(*left, F.lit(True).alias("_first")).unionAll(b.select(*right, F.lit(False).alias("_first")))
    return both.groupBy(*key_names(len(keys))).agg(
        F.count_if("_first").alias("rows_1"),
        F.count_if(~F.col("_first")).alias("rows_2"),
    )


@dataclass(frozen=True)
class KeyCheck:
    """What one scan of the keys says about a two-table comparison."""

    rows_1: int
    rows_2: int
    duplicates_1: int  # rows beyond the first of each key, null keys included
    duplicates_2: int
    null_rows_1: int  # rows with a null in any key column
    null_rows_2: int
    most_rows_1: int  # rows of the most frequent complete key
    most_rows_2: int
    repeated_on_both: int  # complete keys that occur more than once on both sides
    join_rows: int  # rows of the full outer join, repeated keys multiplied out

    @property
    def unique(self) -> bool:
        return self.duplicates_1 == 0 and self.duplicates_2 == 0


def check_keys(a: DataFrame, b: DataFrame, keys: Sequence[str]) -> KeyCheck:
    """Run the key scan; one row of counters comes to the driver."""
    counts = rows_per_key(a, b, keys)
    names = key_names(len(keys))
    n1, n2 = F.col("rows_1"), F.col("rows_2")
    full = none_null(names)
    zero = F.lit(0).cast("bigint")

    def total(c: Column) -> Column:
        return F.coalesce(F.sum(c), zero)

    def wide(c: Column) -> Column:
        return c.cast("decimal(19,0)")

    row = counts.agg(
        total(n1).alias("rows_1"),
        total(n2).alias("rows_2"),
        total(F.greatest(n1 - 1, zero)).alias("duplicates_1"),
        total(F.greatest(n2 - 1, zero)).alias("duplicates_2"),
        total(F.when(~full, n1)).alias("null_rows_1"),
        total(F.when(~full, n2)).alias("null_rows_2"),
        F.coalesce(F.max(F.when(full, n1)), zero).alias("most_rows_1"),
        F.coalesce(F.max(F.when(full, n2)), zero).alias("most_rows_2"),
        F.count_if(full & (n1 > 1) & (n2 > 1)).alias("repeated_on_both"),
        F.coalesce(
            F.sum(
                F.when(full, wide(F.greatest(n1, F.lit(1))) * wide(F.greatest(n2, F.lit(1)))).otherwise(
                    wide(n1 + n2)
                )
            ),
            F.lit(Decimal(0)),
        ).alias("join_rows"),
    ).first()
    return KeyCheck(**{k: int(v) for k, v in row.asDict().items()})


def counter(value: int) -> Column:
    """Literal of a counter: bigint, or decimal(38,0) beyond its range."""
    if value <= _LONG_MAX:
        return F.lit(value).cast("bigint")
    return F.lit(Decimal(value)).cast("decimal(38,0)")


def key_multiplicity(a: DataFrame, b: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Keys that occur more than once on a side, with the join rows each would give.

    Columns: the keys, ``rows_f1``, ``rows_f2``, ``join_rows`` (decimal, since the product of
    two counts can leave the bigint range).
    """
    names = key_names(len(keys))
    n1, n2 = F.col("rows_1"), F.col("rows_2")
    product = F.greatest(n1, F.lit(1)).cast("decimal(19,0)") * F.greatest(n2, F.lit(1)).cast("decimal(19,0)")
    return (
        rows_per_key(a, b, keys)
        .where((n1 > 1) | (n2 > 1))
        .select(
            *[F.col(n).alias(k) for n, k in zip(names, keys)],
            n1.alias("rows_f1"),
            n2.alias("rows_f2"),
            F.when(none_null(names), product).otherwise((n1 + n2).cast("decimal(38,0)")).alias("join_rows"),
        )
    )


def validate_key(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """One row: ``total_rows, distinct_keys, duplicate_rows, is_unique`` over the full table.

    Null parts of a key count as equal to each other.
    """
    require_columns(df, keys, "keys")
    per_key = df.groupBy(*[col(k) for k in keys]).agg(F.count(F.lit(1)).alias("n"))
    return per_key.agg(
        F.coalesce(F.sum("n"), F.lit(0)).cast("bigint").alias("total_rows"),
        F.count(F.lit(1)).alias("distinct_keys"),
    ).select(
        "total_rows",
        "distinct_keys",
        (F.col("total_rows") - F.col("distinct_keys")).alias("duplicate_rows"),
        (F.col("total_rows") == F.col("distinct_keys")).alias("is_unique"),
    )


def key_nulls(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """One row: ``total_rows, null_key_rows`` (a null in any key column)."""
    require_columns(df, keys, "keys")
    is_null = reduce(or_, [col(k).isNull() for k in keys], F.lit(False))
    return df.agg(F.count(F.lit(1)).alias("total_rows"), F.count_if(is_null).alias("null_key_rows"))


def _distinct_counts(df: DataFrame, groups: list[tuple[str, ...]]) -> DataFrame:
    """``candidate, distinct_count``: exact distinct rows of each column group.

    Each group is its own narrow scan and hash aggregate on native types; a single aggregate with many exact distincts would multiply every input row.
    """
    parts = []
    for i, group in enumerate(groups):
        parts.append(
            df.groupBy(*[col(c) for c in group])
            .agg(F.lit(1).alias("_one"))
            .agg(F.count(F.lit(1)).alias("distinct_count"))
            .select(F.lit(i).alias("candidate"), "distinct_count")
        )
    return reduce(DataFrame.unionAll, parts)


def null_counts(df: DataFrame, groups: list[tuple[str, ...]]) -> DataFrame:
    """``candidate, total_rows, null_rows`` of each column group, one scan per forty groups."""
    parts = []
    for part in chunks(list(enumerate(groups)), 40):
        entries = [
            F.struct(
                F.lit(i).alias("candidate"),
                F.count(F.lit(1)).alias("total_rows"),
                F.count_if(reduce(or_, [col(c).isNull() for c in g])).alias("null_rows"),
            )
            for i, g in part
        ]
        parts.append(df.agg(F.array(*entries).alias("e")).select(F.inline("e")))
    return reduce(DataFrame.unionAll, parts)


# Relative error of estimated distinct counts, and the estimated ratio from which a
# group is counted exactly; it is far enough below the unique ratio for that error.
ESTIMATE_ERROR = 0.02
ESTIMATE_RATIO = 0.9


def _estimates(df: DataFrame, groups: list[tuple[str, ...]]) -> list[int]:
    """Estimated distinct rows of each group from one scan per forty groups, without a shuffle."""
    found: list[int] = []
    for part in chunks(groups, 40):
        sketches = [
            F.approx_count_distinct(F.xxhash64(*[col(c) for c in g]), ESTIMATE_ERROR).alias(str(i))
            for i, g in enumerate(part)
        ]
        found += list(df.agg(*sketches).first())
    return found


def _measure(
    df: DataFrame, groups: list[tuple[str, ...]], exact: bool
) -> list[tuple[tuple[str, ...], int, int, int]]:
    """One small row per column group: (columns, rows, distinct, rows with a null)."""
    counts = {r.candidate: (r.total_rows, r.null_rows) for r in null_counts(df, groups).collect()}
    distinct: dict[int, int] = {}
    finalists = list(range(len(groups)))
    if not exact:
        estimates = _estimates(df, groups)
        distinct = {i: min(n, counts[i][0]) for i, n in enumerate(estimates)}
        finalists = [i for i in finalists if distinct[i] >= ESTIMATE_RATIO * counts[i][0]]
    for part in chunks(finalists, GROUPS_PER_JOB):
        for r in _distinct_counts(df, [groups[i] for i in part]).collect():
            distinct[part[r.candidate]] = r.distinct_count
    return [(g, counts[i][0], distinct[i], counts[i][1]) for i, g in enumerate(groups)]


def discover_keys(
    df: DataFrame, max_columns: int = 3, exact: bool = True, pool: int | None = None
) -> DataFrame:
    """Rank single columns, then pairs and triples, as row keys.

    A single column is unique from a distinct ratio of 0.99, a composite only when all
    rows differ. Pairs are tried when no single column is unique and triples when no pair
    is, among all columns, or the ``pool`` ones with the most distinct values if given; a
    group whose distinct counts, or those of a pair in it and of the third column, multiply
    to less than the row count cannot be unique and is left out. With
    ``exact=False`` groups that an estimate shows to be far from unique keep the estimate,
    and every factor of that product is raised by the error it may have: which keys are
    unique is still exact, and only their values are shuffled.

    Columns: ``columns, uniqueness_ratio, is_unique, null_rate, confidence, recommended``,
    best first by ``rank``. Only one row of counters per column group reaches the driver.
    """
    spark = df.sparkSession
    singles = _measure(df, [(c,) for c in df.columns], exact)
    total = singles[0][1] if singles else 0
    found: list[tuple[list[str], float, bool, float, float]] = []
    for group, rows, distinct, nulls in singles if total else []:
        ratio, null_rate = distinct / rows, nulls / rows
        found.append((list(group), ratio, ratio >= UNIQUE_RATIO, null_rate, ratio * (1.0 - null_rate)))

    tried = sorted(singles, key=lambda s: -s[2])[:pool]
    raised = 1 if exact else ESTIMATE_RATIO
    most = {s[0]: s[2] / raised for s in tried}
    for size in range(2, max_columns + 1):
        if not total or any(f[2] for f in found):
            break
        groups = []
        for group in combinations([s[0][0] for s in tried], size):
            # What a part of the group has at most, times what its other column has.
            parts = [(group[:i] + group[i + 1 :], (group[i],)) for i in range(size)]
            most[group] = min(most[part] * most[other] for part, other in parts)
            if most[group] >= total:
                groups.append(group)
        if not groups:
            continue
        for group, rows, distinct, nulls in _measure(df, groups, exact):
            most[group] = min(most[group], distinct / raised)
            ratio, unique = distinct / rows, distinct == rows
            confidence = COMPOSITE_CONFIDENCE if unique else ratio * COMPOSITE_CONFIDENCE
            found.append((list(group), ratio, unique, nulls / rows, confidence))

    ranked = sorted(found, key=lambda f: (not f[2], -f[4]))
    return spark.createDataFrame(
        [(i + 1, *f, i == 0) for i, f in enumerate(ranked)],
        "rank int, columns array<string>, uniqueness_ratio double, is_unique boolean, "
        "null_rate double, confidence double, recommended boolean",
    )


def suggest_keys(a: DataFrame, b: DataFrame, top: int = 3) -> DataFrame:
    """The best ``top`` key candidates of both tables side by side, matched by column names."""

    def side(df: DataFrame, n: int) -> DataFrame:
        return (
            discover_keys(df)
            .where(F.col("rank") <= top)
            .select(
                "columns",
                F.col("rank").alias(f"rank_f{n}"),
                F.col("uniqueness_ratio").alias(f"unique_rate_f{n}"),
                F.col("is_unique").alias(f"is_unique_f{n}"),
            )
        )

    return side(a, 1).join(side(b, 2), "columns", "full")
