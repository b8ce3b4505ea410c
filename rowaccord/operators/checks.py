"""Severity-graded validation checks of one table, and of two tables against each other."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import parsing, text
from ..functions.names import chunks, lit, quote
from .keys import key_nulls, validate_key
from .profile import TYPE_LABELS, profile_quality, profile_types
from .schema import schema_facts

# Rows of a table, rows beyond the first of each key, rows with a null in the key.
KeyCounts = tuple[int, int, int]

SEVERITIES = ("INFO", "WARNING", "ERROR", "CRITICAL")

CHECK_COLUMNS = (
    "check_no int, name string, severity string, passed boolean, message string, column string, affected_count bigint"
)
_NO_COLUMN, _NO_COUNT = "CAST(NULL AS STRING)", "CAST(NULL AS BIGINT)"


@dataclass(frozen=True)
class ColumnRule:
    """Business rules of one column; unset rules are not evaluated.

    ``max_null_rate`` looks at real nulls. The other value rules look at present values:
    ``min_value``/``max_value`` at their number (a text that is no number breaks the
    rule), ``regex_pattern`` anywhere in the text, ``allowed_values`` at the whole text.
    """

    name: str
    required: bool = False
    expected_type: str | None = None
    max_null_rate: float | None = None
    min_value: float | None = None
    max_value: float | None = None
    regex_pattern: str | None = None
    allowed_values: Sequence[str] | None = None


@dataclass(frozen=True)
class ValidationConfig:
    """Thresholds are exceeded strictly; more duplicate rows than the last one is CRITICAL."""

    null_warn_threshold: float = 0.50
    null_error_threshold: float = 0.90
    duplicate_key_warn_threshold: int = 1
    business_rules: Sequence[ColumnRule] = field(default_factory=tuple)


def _check(number: int, name: str, severity: str, message: str, column: str = _NO_COLUMN, affected: str = _NO_COUNT) -> str:
    """One check as a SQL struct; ``severity``, ``message``, ``column`` and ``affected`` are expressions."""
    return (
        f"named_struct('check_no', {number}, 'name', {name}, 'severity', {severity}, "
        f"'passed', {severity} = 'INFO', 'message', {message}, 'column', {column}, "
        f"'affected_count', CAST({affected} AS BIGINT))"
    )


def _percent(x: str) -> str:
    return f"format_string('%.1f%%', 100 * ({x}))"


def profile_checks(profile: DataFrame, config: ValidationConfig | None = None) -> DataFrame:
    """Row count, null rate, mixed type and textual null checks from the profile of a whole table."""
    config = config or ValidationConfig()
    per_column = [
        (
            f"null_variant_rate > {config.null_warn_threshold}D",
            _check(
                2,
                "'High Null Rate'",
                f"CASE WHEN null_variant_rate > {config.null_error_threshold}D THEN 'ERROR' ELSE 'WARNING' END",
                f"concat(column, ': ', {_percent('null_variant_rate')}, ' of the values are missing in some form')",
                "column",
                "total_null_variants",
            ),
        ),
        (
            "inferred_type <> 'string' AND invalid_parse_count > 0",
            _check(
                3,
                "'Mixed Types'",
                "'WARNING'",
                "concat(column, ': mostly ', inferred_type, ', but ', invalid_parse_count, ' values are not (', "
                f"{_percent('type_distribution[inferred_type]')}, ' are)')",
                "column",
                "invalid_parse_count",
            ),
        ),
        (
            "textual_null_count > 0",
            _check(
                4,
                "'Textual Nulls'",
                "'WARNING'",
                "concat(column, ': ', textual_null_count, ' values are words for null')",
                "column",
                "textual_null_count",
            ),
        ),
    ]
    found = ", ".join(f"CASE WHEN {test} THEN {check} END" for test, check in per_column)
    row_count = _check(
        1, "'Row Count'", "'INFO'", "concat('table has ', format_number(total_count, 0), ' rows')", affected="total_count"
    )
    # The row count comes once, with the first column of the profile.
    entries = f"array(CASE WHEN _first THEN {row_count} END, {found})"
    first = profile.withColumn("_first", F.col("position") == F.lit(0))
    return first.select(F.expr(f"inline(array_compact({entries}))"))


def key_checks(
    df: DataFrame, keys: Sequence[str], config: ValidationConfig | None = None, counts: KeyCounts | None = None
) -> DataFrame:
    """Duplicate and null key checks over the full table; no row when all is well.

    ``counts`` from an earlier key scan saves scanning the keys again.
    """
    config = config or ValidationConfig()
    if counts is None:
        found = validate_key(df, keys).join(key_nulls(df, keys), "total_rows")
    else:
        found = df.sparkSession.createDataFrame([counts], "total_rows bigint, duplicate_rows bigint, null_key_rows bigint")
    names, shown = lit(",".join(keys)), lit(", ".join(keys))
    duplicates = _check(
        5,
        "'Duplicate Keys'",
        f"CASE WHEN duplicate_rows > {config.duplicate_key_warn_threshold} THEN 'CRITICAL' ELSE 'WARNING' END",
        f"concat('key (', {shown}, ') repeats in ', duplicate_rows, ' rows; join counts will be inflated')",
        names,
        "duplicate_rows",
    )
    nulls = _check(
        6,
        "'Key Column Nulls'",
        "'WARNING'",
        f"concat('key (', {shown}, ') has nulls in ', null_key_rows, ' rows (', "
        f"{_percent('null_key_rows / greatest(total_rows, 1)')}, '); they match no row')",
        names,
        "null_key_rows",
    )
    entries = f"CASE WHEN duplicate_rows > 0 THEN {duplicates} END, CASE WHEN null_key_rows > 0 THEN {nulls} END"
    return found.select(F.expr(f"inline(array_compact(array({entries})))"))


def rule_checks(df: DataFrame, rules: Sequence[ColumnRule]) -> DataFrame:
    """Evaluate business rules: one aggregate for all value rules of up to forty columns.

    Each broken rule gives an ERROR with the number of offending rows; a column that passes
    all its rules gives one INFO check.
    """
    known = set(df.columns)
    typed = [r for r in rules if r.name in known and r.expected_type]
    parts: list[DataFrame] = []
    absent = [r for r in rules if r.name not in known]
    spark = df.sparkSession
    if absent:
        rows = [
            (
                7,
                f"Business Rule: {r.name}",
                "ERROR",
                False,
                f"{r.name}: required column is not in the table" if r.required else f"{r.name}: no such column",
                r.name,
                None,
            )
            for r in absent
        ]
        parts.append(spark.createDataFrame(rows, CHECK_COLUMNS))

    for part in chunks([r for r in rules if r.name in known], 40):
        aggs, structs = ["count(1) AS _rows"], []
        for i, r in enumerate(part):
            tests = _rule_tests(df, r)
            broken = []
            for j, (offends, message) in enumerate(tests):
                aggs.append(f"count_if({offends}) AS _r{i}_{j}")
                n = f"_r{i}_{j}"
                limit = f"{n} > 0" if message is not None else f"_rows > 0 AND {n} / _rows > {r.max_null_rate}D"
                words = message or f"null rate ', {_percent(f'{n} / _rows')}, ' exceeds {r.max_null_rate:.1%}"
                check = _check(7, lit(f"Business Rule: {r.name}"), "'ERROR'", f"concat({lit(r.name + ': ')}, '{words}')", lit(r.name), n)
                broken.append(f"CASE WHEN {limit} THEN {check} END")
            found = f"array_compact(array({', '.join(broken)}))" if broken else None
            passed = _check(7, lit(f"Business Rule: {r.name}"), "'INFO'", lit(f"{r.name}: all rules hold"), lit(r.name))
            if r in typed:
                passed = None  # decided together with the type rule below
            if found and passed:
                structs.append(f"CASE WHEN size({found}) = 0 THEN array({passed}) ELSE {found} END")
            elif found:
                structs.append(found)
            elif passed:
                structs.append(f"array({passed})")
        if structs:
            counted = df.groupBy().agg(*[F.expr(a) for a in aggs])
            parts.append(counted.select(F.expr(f"inline(flatten(array({', '.join(structs)})))")))
    if typed:
        expected = [f"WHEN column = {lit(r.name)} THEN {lit(r.expected_type)}" for r in typed]
        bad = sorted({r.expected_type for r in typed} - {*TYPE_LABELS, "string"})
        if bad:
            raise ValueError(f"unknown expected_type {bad}; use {(*TYPE_LABELS, 'string')}")
        broken = _check(
            7,
            "concat('Business Rule: ', column)",
            "'ERROR'",
            "concat(column, ': type is ', inferred_type, ', expected ', _expected)",
            "column",
            "invalid_parse_count",
        )
        holds = _check(
            7, "concat('Business Rule: ', column)", "'INFO'", "concat(column, ': type is ', _expected)", "column"
        )
        types = profile_types(df, [r.name for r in typed]).withColumn("_expected", F.expr(f"CASE {' '.join(expected)} END"))
        parts.append(types.selectExpr(f"inline(array(CASE WHEN inferred_type = _expected THEN {holds} ELSE {broken} END))"))
    if not parts:
        return spark.createDataFrame([], CHECK_COLUMNS)
    result = parts[0]
    for p in parts[1:]:
        result = result.unionByName(p)
    return result


def _rule_tests(df: DataFrame, r: ColumnRule) -> list[tuple[str, str | None]]:
    """Per value rule of a column: the test an offending row passes, and what is wrong then.

    A message of None marks the null rate rule, whose limit is a share.
    """
    c, t = quote(r.name), df.schema[r.name].dataType
    tests: list[tuple[str, str | None]] = []
    if r.max_null_rate is not None:
        tests.append((f"{c} IS NULL", None))
    elif r.required:
        tests.append((f"{c} IS NULL", "required value is missing"))
    if r.min_value is not None or r.max_value is not None:
        number = c
        if text.is_text(t):
            number = f"CASE WHEN {parsing.is_float(c)} THEN try_cast({c} AS DOUBLE) END"
        bounds = []
        if r.min_value is not None:
            bounds.append((f"{number} < {float(r.min_value)!r}D", f"below {r.min_value}"))
        if r.max_value is not None:
            bounds.append((f"{number} > {float(r.max_value)!r}D", f"above {r.max_value}"))
        tests += [(f"coalesce({test}, false)", f"values {words}") for test, words in bounds]
        if text.is_text(t):
            tests.append((f"{c} IS NOT NULL AND ({number}) IS NULL", "values that are no numbers"))
    if r.regex_pattern is not None:
        tests.append((f"NOT {text.render(c, t)} RLIKE {lit(r.regex_pattern)}", "values that do not match the pattern"))
    if r.allowed_values is not None:
        allowed = ", ".join(lit(v) for v in r.allowed_values)
        outside = f"{text.render(c, t)} NOT IN ({allowed})" if allowed else f"{c} IS NOT NULL"
        tests.append((outside, "values outside the allowed ones"))
    return tests


def schema_drift_checks(df1: DataFrame, df2: DataFrame) -> DataFrame:
    """A WARNING per table that has columns the other lacks; ``table_no`` says which."""
    facts = schema_facts(df1, df2)
    rows = [
        (n, 8, "Schema Drift", "WARNING", False, f"columns only in table {n}: {', '.join(names)}", None, None)
        for n, names in ((1, facts.only_in_1), (2, facts.only_in_2))
        if names
    ]
    return df1.sparkSession.createDataFrame(rows, f"table_no int, {CHECK_COLUMNS}")


def checks(
    df: DataFrame,
    config: ValidationConfig | None = None,
    keys: Sequence[str] | None = None,
    profile: DataFrame | None = None,
    key_counts: KeyCounts | None = None,
) -> DataFrame:
    """All checks of one table; a ready profile or key scan is used instead of a new one."""
    config = config or ValidationConfig()
    profile = profile if profile is not None else profile_quality(df)
    result = profile_checks(profile, config)
    if keys:
        result = result.unionAll(key_checks(df, keys, config, key_counts))
    if config.business_rules:
        result = result.unionAll(rule_checks(df, config.business_rules))
    return result


validate = checks


def validate_pair(
    df1: DataFrame,
    df2: DataFrame,
    config: ValidationConfig | None = None,
    keys: Sequence[str] | None = None,
    profiles: tuple[DataFrame, DataFrame] | None = None,
    key_counts: tuple[KeyCounts, KeyCounts] | None = None,
) -> DataFrame:
    """Checks of both tables and their schema drift, with ``table_no`` and the schema score."""
    parts = []
    for n, df in enumerate((df1, df2)):
        profile = profiles[n] if profiles else None
        found = checks(df, config, keys, profile, key_counts[n] if key_counts else None)
        parts.append(found.select(F.lit(n + 1).alias("table_no"), "*"))
    both = parts[0].unionAll(parts[1]).unionAll(schema_drift_checks(df1, df2))
    return both.withColumn("compatibility_score", F.lit(schema_facts(df1, df2).score))


def check_summary(check_table: DataFrame) -> DataFrame:
    """Number of checks per severity, zero included."""
    counts = [f"count_if(severity = '{s}')" for s in SEVERITIES]
    entries = ", ".join(
        f"named_struct('position', {i}, 'severity', '{s}', 'checks', {n})" for i, (s, n) in enumerate(zip(SEVERITIES, counts))
    )
    return check_table.groupBy().agg(F.expr(f"array({entries})").alias("e")).select(F.inline("e"))
