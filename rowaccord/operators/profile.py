"""Column profiles: kinds of missing values, distinct values, extremes, parse counts, types.

The whole profile groups each column by its own values: the shuffle carries distinct values
only, and parsing, rendering and counting then happen once per distinct value. Operators
that need no distinct values count row by row in one aggregate, without any shuffle.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import parsing, text
from ..functions.names import chunks, lit, quote, require_columns

# Share of parsable values from which a type is taken as the column's type,
# and the labels in order of preference.
TYPE_THRESHOLD = 0.95
TYPE_LABELS = ("integer", "float", "boolean", "date", "datetime")

SAMPLE_VALUES = 5

# Columns per aggregate: keeps the generated code below the JVM's method limits. Columnar
# sources read each column once whatever the number of aggregates.
COLUMNS_PER_SCAN = 16


def _fields(df: DataFrame, columns: Sequence[str] | None) -> list[tuple[int, T.StructField]]:
    wanted = list(columns) if columns is not None else df.columns
    require_columns(df, wanted, "profile")
    position = {c: i for i, c in enumerate(df.columns)}
    return [(position[c], df.schema[c]) for c in wanted]


NO_ROWS = "CAST(0 AS BIGINT)"


@dataclass(frozen=True)
class _Input:
    """A column under an aggregate: its value, type and date reading.

    Counts go over rows, or over distinct values that carry their number of rows.
    """

    c: str
    t: T.DataType
    reading: str
    weight: str | None = None

    def rows(self) -> str:
        return "count(1)" if self.weight is None else f"coalesce(sum({self.weight}), {NO_ROWS})"

    def where(self, test: str) -> str:
        if self.weight is None:
            return f"count_if({test})"
        return f"coalesce(sum(CASE WHEN {test} THEN {self.weight} END), {NO_ROWS})"

    def present(self) -> str:
        return self.where(f"{self.c} IS NOT NULL")


# An entry names the aggregates wanted of one column: {output name: SQL aggregate}.
Entry = Callable[[_Input], dict[str, str]]


def _row_by_row(df: DataFrame, columns: Sequence[str] | None, entry: Entry) -> DataFrame:
    """Counters over rows: one aggregate per chunk of columns, turned into one row per column."""
    parts = []
    for part in chunks(_fields(df, columns), COLUMNS_PER_SCAN):
        inputs = [f"{quote(f.name)} AS _v{i}" for i, f in part]
        inputs += [f"{parsing.date_reading(quote(f.name))} AS _d{i}" for i, f in part if text.is_text(f.dataType)]
        structs = []
        for i, f in part:
            aggs = entry(_Input(f"_v{i}", f.dataType, f"_d{i}"))
            fields = ", ".join(f"'{name}', {agg}" for name, agg in aggs.items())
            structs.append(f"named_struct('column', {lit(f.name)}, 'position', {i}, {fields})")
        parts.append(
            df.selectExpr(*inputs).agg(F.expr(f"array({', '.join(structs)})").alias("e")).select(F.inline("e"))
        )
    return _union(parts)


def _union(parts: list[DataFrame]) -> DataFrame:
    """Union in a balanced tree: each step analyses its whole plan again."""
    while len(parts) > 1:
        parts = [x.unionAll(y) for x, y in zip(parts[::2], parts[1::2])] + parts[len(parts) // 2 * 2 :]
    return parts[0]


def _value_groups(df: DataFrame, columns: Sequence[str] | None) -> list[tuple[int, T.StructField, DataFrame]]:
    """Each column's distinct values ``v`` with their row counts ``n``, on the native type.

    Frequent values collapse map-side; each column is read by its own narrow scan.
    """
    groups = []
    for i, f in _fields(df, columns):
        c = text.sorted_entries(quote(f.name)) if isinstance(f.dataType, T.MapType) else quote(f.name)
        groups.append((i, f, df.selectExpr(f"{c} AS v").groupBy("v").agg(F.expr("count(1)").alias("n"))))
    return groups


def _by_values(df: DataFrame, columns: Sequence[str] | None, entry: Entry) -> DataFrame:
    """Counters and value statistics from the distinct values, one row per column."""
    parts = []
    for i, f, g in _value_groups(df, columns):
        if text.is_text(f.dataType):
            g = g.selectExpr("v", "n", f"{parsing.date_reading('v')} AS reading")
        aggs = entry(_Input("v", f.dataType, "reading", "n"))
        named = [f"{lit(f.name)} AS column", f"{i} AS position", *(f"{agg} AS {n}" for n, agg in aggs.items())]
        parts.append(g.groupBy().agg(*[F.expr(x) for x in named]))
    return _union(parts)


def _null_counters(x: _Input) -> dict[str, str]:
    """Only text can be empty, blank or a word for null; a float can be NaN, which is one."""
    empty = blank = words = NO_ROWS
    if text.is_text(x.t):
        empty, blank = x.where(text.is_empty(x.c)), x.where(text.is_whitespace_only(x.c))
        words = x.where(text.is_textual_null(x.c))
    elif text.is_float(x.t):
        words = x.where(f"isnan({x.c})")
    return {
        "total_count": x.rows(),
        "null_count": x.where(f"{x.c} IS NULL"),
        "empty_count": empty,
        "whitespace_count": blank,
        "textual_null_count": words,
    }


def _best_layout(x: _Input, kind: str) -> str:
    return f"greatest({', '.join(x.where(test) for test in parsing.date_layouts(x.reading, kind))})"


def _parse_counters(x: _Input) -> dict[str, str]:
    """Values that read as each type. Typed columns need no parsing: their type is known."""
    counters = dict.fromkeys(TYPE_LABELS, NO_ROWS)
    if text.is_text(x.t):
        counters["integer"] = x.where(parsing.is_integer(x.c))
        counters["float"] = x.where(parsing.is_float(x.c))
        counters["boolean"] = x.where(parsing.is_boolean(x.c))
        # One layout per column: the one that fits most values.
        counters["date"] = _best_layout(x, "date")
        counters["datetime"] = _best_layout(x, "datetime")
    elif text.is_integral(x.t):
        counters["integer"] = counters["float"] = x.present()
    elif isinstance(x.t, T.NumericType):
        counters["float"] = x.present()
    elif isinstance(x.t, T.BooleanType):
        counters["boolean"] = x.present()
    elif isinstance(x.t, T.DateType):
        counters["date"] = x.present()
    elif isinstance(x.t, (T.TimestampType, T.TimestampNTZType)):
        counters["datetime"] = x.present()
    return {f"{label}_count": counters[label] for label in TYPE_LABELS}


def _extremes(x: _Input) -> dict[str, str]:
    value = _value_text(x)
    low, high = f"min({value})", f"max({value})"
    typed = text.is_ordered(x.t)
    return {
        "min_text": low,
        "max_text": high,
        "min_value": text.render(f"min({x.c})", x.t) if typed else low,
        "max_value": text.render(f"max({x.c})", x.t) if typed else high,
    }


def _value_text(x: _Input) -> str:
    """Text of a value; a map was grouped by its sorted entries."""
    if isinstance(x.t, T.MapType) and x.weight is not None:
        return f"to_json({x.c})"
    return text.render(x.c, x.t)


def _distinct(x: _Input) -> dict[str, str]:
    return {"distinct_count": "count(1)"}


def _approx_distinct(x: _Input) -> dict[str, str]:
    value = text.render(x.c, x.t) if isinstance(x.t, T.MapType) else x.c
    has_null = f"CASE WHEN count({x.c}) < count(1) THEN 1 ELSE 0 END"
    return {"distinct_count": f"approx_count_distinct({value}) + {has_null}"}


def _in_order(per_column: DataFrame) -> DataFrame:
    """A profile has one row per column, so one partition holds and sorts it."""
    return per_column.coalesce(1).sortWithinPartitions("position")


def _with_null_totals(counters: DataFrame) -> DataFrame:
    variants = "(null_count + empty_count + whitespace_count + textual_null_count)"
    return counters.selectExpr(
        "*",
        f"{variants} AS total_null_variants",
        f"CASE WHEN total_count > 0 THEN {variants} / total_count ELSE 0D END AS null_variant_rate",
    )


def _with_type(counters: DataFrame, present: str) -> DataFrame:
    """Add ``inferred_type, type_distribution, invalid_parse_count`` to parse counters.

    The best reading is the greatest of one small struct per label: labels over the
    threshold come first, in order of preference; below it the most hits win.
    """

    def reading(tier: str, weight: str, order: int, label: str, hits: str) -> str:
        return f"named_struct('tier', {tier}, 'weight', {weight}, 'order', {order}, 'label', '{label}', 'hits', {hits})"

    readings = [reading("0", NO_ROWS, 1, "string", present)]
    for i, label in enumerate(TYPE_LABELS):
        hits = f"{label}_count"
        sure = f"{hits} / greatest({present}, 1) >= {TYPE_THRESHOLD}D"
        tier = f"CASE WHEN {sure} THEN 2 WHEN {hits} > 0 THEN 1 ELSE 0 END"
        readings.append(reading(tier, f"CASE WHEN {sure} THEN {NO_ROWS} ELSE {hits} END", -i, label, hits))
    share = f"CASE WHEN {present} > 0 THEN _best.hits / greatest({present}, 1) ELSE 1D END"
    return (
        counters.selectExpr("*", f"greatest({', '.join(readings)}) AS _best")
        .selectExpr(
            "*",
            "_best.label AS inferred_type",
            f"CASE WHEN _best.label = 'string' THEN map('string', 1D) "
            f"ELSE map(_best.label, {share}, 'string', 1D - {share}) END AS type_distribution",
            f"{present} - _best.hits AS invalid_parse_count",
        )
        .drop("_best")
    )


def profile_nulls(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """Per column: real nulls, empty, white-space-only and textual nulls, their sum and rate."""
    return _with_null_totals(_in_order(_row_by_row(df, columns, _null_counters)))


def profile_parse_counts(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """Per column: present values and how many of them read as each type."""
    return _in_order(_row_by_row(df, columns, lambda x: {"non_null_count": x.present(), **_parse_counters(x)}))


def profile_types(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """Per column: inferred type, the share of present values that have it, and the rest.

    The first type that 95 % of the present values read as wins, else the best non-zero
    one, else string. Blank texts and words for null count as present.
    """
    return _with_type(profile_parse_counts(df, columns), "non_null_count").select(
        "column", "position", "non_null_count", "inferred_type", "type_distribution", "invalid_parse_count"
    )


def profile_quality(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """Null and type counters together: what validation needs, from one scan without a shuffle."""
    counters = _in_order(_row_by_row(df, columns, lambda x: {**_null_counters(x), **_parse_counters(x)}))
    return _with_null_totals(_with_type(counters, "(total_count - null_count)"))


def profile_distinct(df: DataFrame, columns: Sequence[str] | None = None, exact: bool = True) -> DataFrame:
    """Per column: the number of distinct values, null counting as one value."""
    if exact:
        return _in_order(_by_values(df, columns, _distinct))
    return _in_order(_row_by_row(df, columns, _approx_distinct))


def profile_min_max(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """Per column: smallest and largest text, and smallest and largest typed value (as text).

    Order of texts differs from order of numbers (``"10" < "9"``), so both are given.
    """
    return _in_order(_by_values(df, columns, _extremes))


def profile_samples(df: DataFrame, columns: Sequence[str] | None = None, n: int = SAMPLE_VALUES) -> DataFrame:
    """Per column: its ``n`` smallest distinct present values as texts.

    Each task passes on at most ``n`` values of a column. The grouping is the one of the
    value statistics (rows with n = 0 do not exist), so a full profile shuffles it once.
    """
    parts = []
    for i, f, g in _value_groups(df, columns):
        value = _value_text(_Input("v", f.dataType, "", "n"))
        smallest = g.where("n > 0").selectExpr(f"{value} AS value").orderBy(F.asc_nulls_last("value")).limit(n)
        parts.append(
            smallest.groupBy().agg(
                F.lit(f.name).alias("column"),
                F.lit(i).alias("position"),
                F.expr("array_sort(collect_list(value))").alias("sample_values"),
            )
        )
    return _in_order(_union(parts))


def profile_columns(
    df: DataFrame, columns: Sequence[str] | None = None, exact: bool = True, samples: bool = True
) -> DataFrame:
    """The whole profile, one row per column in table order.

    ``exact=False`` reads the table once, row by row, with approximate distinct counts:
    no value is shuffled. It suits text sources of many columns, where a scan per column
    would parse every line again.
    """
    count = _distinct if exact else _approx_distinct
    scan = _by_values if exact else _row_by_row
    counters = scan(
        df, columns, lambda x: {**_null_counters(x), **_parse_counters(x), **count(x), **_extremes(x)}
    )
    result = _with_null_totals(_with_type(_in_order(counters), "(total_count - null_count)"))
    if samples:
        # One row per column on both sides.
        result = result.join(F.broadcast(profile_samples(df, columns).drop("position")), "column")
    return result.select(
        "position",
        "column",
        "inferred_type",
        "null_count",
        "empty_count",
        "whitespace_count",
        "textual_null_count",
        "total_null_variants",
        "null_variant_rate",
        "distinct_count",
        "total_count",
        "type_distribution",
        "invalid_parse_count",
        "min_text",
        "max_text",
        "min_value",
        "max_value",
        *(["sample_values"] if samples else []),
    )


def profile_column(df: DataFrame, name: str) -> DataFrame:
    """The profile of one column; other columns are not read."""
    return profile_columns(df, [name])
