"""Names and literals that are safe for any header text.

Expressions are built as Spark SQL text and parsed once with ``F.expr``: for wide tables that
plans much faster than composing the same tree call by call.
"""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def quote(name: str) -> str:
    """Back-quote a column name so that dots and blanks in headers stay literal."""
    return "`" + name.replace("`", "``") + "`"


def col(name: str) -> Column:
    return F.col(quote(name))


def lit(value: str) -> str:
    """A SQL string literal."""
    return "'" + value.replace("\\", "\\\\").replace("'", "\\'") + "'"


def in_list(values: Iterable[str]) -> str:
    return "(" + ", ".join(lit(v) for v in values) + ")"


def require_columns(df: DataFrame, names: Iterable[str], what: str) -> None:
    missing = [n for n in names if n not in df.columns]
    if missing:
        raise ValueError(f"{what}: no such column(s) {missing}; table has {df.columns}")


def require_distinct_names(df: DataFrame) -> None:
    """Refuse headers that the session cannot tell apart.

    Column lookup is case-sensitive by contract; with ``spark.sql.caseSensitive``
    off, headers such as ``id`` and ``ID`` would be ambiguous.
    """
    case_sensitive = df.sparkSession.conf.get("spark.sql.caseSensitive", "false") == "true"
    seen: set[str] = set()
    for n in df.columns:
        probe = n if case_sensitive else n.lower()
        if probe in seen:
            raise ValueError(f"column {n!r} is ambiguous; set spark.sql.caseSensitive=true or rename it")
        seen.add(probe)


def chunks(items: list, size: int) -> list[list]:
    return [items[i : i + size] for i in range(0, len(items), size)]
