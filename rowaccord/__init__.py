"""Reconcile and check tables with Spark: diff, profile, key discovery, validation, reports."""

from .functions.compare import IgnoreRules
from .functions.exact import ExactSum
from .operators.aggregates import aggregation_compare, transactional_compare
from .operators.checks import (
    ColumnRule,
    ValidationConfig,
    check_summary,
    checks,
    rule_checks,
    schema_drift_checks,
    validate,
    validate_pair,
)
from .operators.diff import (
    Diff,
    DiffSpec,
    diff,
    diff_before_after,
    diff_changes,
    diff_classified,
    diff_column_stats,
    diff_counts,
    diff_sample,
)
from .operators.key_search import smallest_keys
from .operators.keys import discover_keys, key_multiplicity, key_nulls, suggest_keys, validate_key
from .operators.profile import (
    profile_column,
    profile_columns,
    profile_distinct,
    profile_min_max,
    profile_nulls,
    profile_parse_counts,
    profile_quality,
    profile_samples,
    profile_types,
)
from .operators.schema import apply_column_map, compare_schemas, rename_candidates, schema_score
from .operators.valuesets import value_set_counts, value_set_members
from .plans.compare import CompareSpec, KeyChoice, choose_key, compare, multi_compare
from .plans.report import diff_json, diff_summary, read_report, report_json, report_tables, write_changes, write_report
from .sources.delimited import detect_delimiter, detect_encoding, infer_types, read_delimited, table_metadata
from .sources.workbooks import list_workbook_sheets, read_workbooks

__all__ = [n for n in dir() if n[0] != "_" and n not in {"functions", "operators", "plans", "sources"}]
