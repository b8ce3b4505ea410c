"""Plain SQL for the results of the registered queries, written for DuckDB."""

from __future__ import annotations

from collections.abc import Sequence

from . import snapshots as s

BLANKS = "chr(9) || chr(10) || chr(11) || chr(12) || chr(13) || ' ' || chr(133) || chr(160)"


def same(c: str) -> str:
    return c


def lowered(c: str) -> str:
    return f"lower({c})"


def stripped(c: str) -> str:
    return f"trim({c}, {BLANKS})"


def classified(
    one: str,
    two: str,
    keys: Sequence[str],
    texts: Sequence[str] = (),
    others: Sequence[str] = (),
    rule=same,
    raw_casts: Sequence[str] = (),
) -> str:
    """CTEs ``a, b, j``: the full join with the change type and both values per column.

    ``rule`` is applied to the text columns; ``raw_casts`` names columns whose raw form is
    their text because the types of the two sides differ.
    """
    on = " and ".join(f"a.{k} = b.{k}" for k in keys)
    columns = [*texts, *others]

    def differs(c: str) -> str:
        return f"({rule('a.' + c)} is distinct from {rule('b.' + c)})" if c in texts else f"(a.{c} is distinct from b.{c})"

    def raw_differs(c: str) -> str:
        if c in raw_casts:
            return f"(cast(a.{c} as varchar) is distinct from cast(b.{c} as varchar))"
        return f"(a.{c} is distinct from b.{c})"

    semantic = " or ".join(differs(c) for c in columns) or "false"
    raw = " or ".join(raw_differs(c) for c in columns) or "false"
    keys_out = ", ".join(f"coalesce(a.{k}, b.{k}) as {k}" for k in keys)
    values = "".join(
        f", a.{c} as {c}_1, b.{c} as {c}_2, a._in and b._in and {differs(c)} as {c}_sem, "
        f"a._in and b._in and {raw_differs(c)} as {c}_raw"
        for c in columns
    )
    return f"""
a as (select *, true as _in from ({one}) x), b as (select *, true as _in from ({two}) x),
j as (select {keys_out}, a._in as in_1, b._in as in_2,
  case when a._in is null then 'added' when b._in is null then 'removed' when {semantic} then 'modified'
       when {raw} then 'formatting_only' else 'unchanged' end as change_type{values}
  from a full join b on {on})"""


COUNTS = """
  (select count(*) from a) as total_rows_f1, (select count(*) from b) as total_rows_f2,
  count(*) as rows_scanned,
  count(*) filter (where change_type = 'added') as added_rows,
  count(*) filter (where change_type = 'removed') as removed_rows,
  count(*) filter (where change_type = 'modified') as modified_rows,
  count(*) filter (where change_type = 'formatting_only') as formatting_only_rows,
  count(*) filter (where change_type = 'unchanged') as unchanged_rows,
  case when count(*) filter (where change_type in ('added', 'removed')) = 0
       then cast(0.95 as double) else cast(0.8 as double) end as confidence_score,
  (select count(*) from a) = (select count(*) from (select distinct {keys} from a) d)
    and (select count(*) from b) = (select count(*) from (select distinct {keys} from b) d) as is_full_count
"""


def counts(one: str, two: str, keys: Sequence[str], *args, **kwargs) -> str:
    select = COUNTS.format(keys=", ".join(keys))
    return f"with {classified(one, two, keys, *args, **kwargs)} select {select} from j"


def column_stats(columns: Sequence[str], cte: str, semantic=same) -> str:
    """``semantic`` gives a text column's value after the rules, for the null transitions."""
    parts = [
        f"""select '{c}' as "column", {i} as position,
  count(*) filter (where {c}_sem) as modified,
  count(*) filter (where {c}_raw and not {c}_sem) as formatting_only,
  count(*) filter (where {c}_sem and {c}_2 is null) as null_introduced,
  count(*) filter (where {c}_sem and {c}_1 is null) as null_resolved,
  cast(count(*) filter (where {c}_sem or {c}_raw) as double) / (select greatest(count(*), 1) from a) as change_rate
from j"""
        for i, c in enumerate(columns)
    ]
    return f"with {cte} " + " union all ".join(parts)


ORDERS_TEXTS = ("o_orderstatus", "o_orderpriority")
ORDERS_OTHERS = ("o_custkey", "o_totalprice", "o_orderdate")
ORDERS_COLUMNS = ("o_custkey", "o_orderstatus", "o_totalprice", "o_orderdate", "o_orderpriority")
ORDERS = ("select * from orders", s.ORDERS_2, ["o_orderkey"], ORDERS_TEXTS, ORDERS_OTHERS)


def text_of(c: str) -> str:
    return f"cast({c} as varchar)"


def changed_list(columns: Sequence[str], flag: str) -> str:
    items = ", ".join(f"case when {flag.format(c=c)} then '{c}' end" for c in columns)
    return f"concat_ws(',', {items})"


def null_profile(table: str, columns: Sequence[tuple[str, bool]], extra=None) -> str:
    """Null kinds of each (column, is text)."""
    words = ", ".join(f"'{w}'" for w in (
        "null", "none", "na", "n/a", "#n/a", "nan", "nil", "missing", "unknown", "undefined", "n.a.", "n.a", "-",
    ))
    parts = []
    for i, (c, is_text) in enumerate(columns):
        if is_text:
            empty = f"count(*) filter (where {c} = '')"
            blank = f"count(*) filter (where {c} <> '' and {stripped(c)} = '')"
            textual = f"count(*) filter (where lower({c}) in ({words}))"
        else:
            empty = blank = textual = "cast(0 as bigint)"
        parts.append(
            f"""select '{c}' as "column", {i} as position, count(*) as total_count,
  count(*) filter (where {c} is null) as null_count, {empty} as empty_count, {blank} as whitespace_count,
  {textual} as textual_null_count from t"""
        )
    return (
        f"with t as ({table}), p as ({' union all '.join(parts)}) select *, "
        "null_count + empty_count + whitespace_count + textual_null_count as total_null_variants, "
        "cast(null_count + empty_count + whitespace_count + textual_null_count as double) / total_count "
        "as null_variant_rate from p"
    )


INTEGER = "^[+-]?[0-9]+$"
FLOAT = r"^[+-]?([0-9]+\.?[0-9]*|\.[0-9]+)([eE][+-]?[0-9]+)?$"
DATE_LAYOUTS = (
    ("^[0-9]{4}-[0-9]{2}-[0-9]{2}$", "%Y-%m-%d"),
    ("^[0-9]{4}/[0-9]{2}/[0-9]{2}$", "%Y/%m/%d"),
    ("^[0-9]{2}/[0-9]{2}/[0-9]{4}$", "%m/%d/%Y"),
    ("^[0-9]{2}/[0-9]{2}/[0-9]{4}$", "%d/%m/%Y"),
    ("^[0-9]{2}-[0-9]{2}-[0-9]{4}$", "%d-%m-%Y"),
    (r"^[0-9]{2}\.[0-9]{2}\.[0-9]{4}$", "%d.%m.%Y"),
)


def text_parse_counts(table: str, columns: Sequence[str]) -> str:
    """Parse counters of text columns (which hold no text with a time)."""
    parts = []
    for i, c in enumerate(columns):
        dates = ", ".join(
            f"count(*) filter (where regexp_full_match({c}, '{p}') and try_strptime({c}, '{f}') is not null)"
            for p, f in DATE_LAYOUTS
        )
        parts.append(
            f"""select '{c}' as "column", {i} as position, count({c}) as non_null_count,
  count(*) filter (where regexp_full_match({c}, '{INTEGER}') and try_cast({c} as bigint) is not null) as integer_count,
  count(*) filter (where regexp_full_match({c}, '{FLOAT}') and try_cast({c} as double) is not null) as float_count,
  count(*) filter (where lower({c}) in ('true', 'false')) as boolean_count,
  greatest({dates}) as date_count, cast(0 as bigint) as datetime_count from t"""
        )
    return f"with t as ({table}) {' union all '.join(parts)}"


def types(parse_counts: str) -> str:
    labels = ("integer", "float", "boolean", "date", "datetime")
    sure = " ".join(f"when {x}_count >= 0.95 * non_null_count then '{x}'" for x in labels)
    best = " ".join(
        f"when {x}_count > 0 and {x}_count = greatest({', '.join(y + '_count' for y in labels)}) then '{x}'" for x in labels
    )
    hits = " ".join(f"when '{x}' then {x}_count" for x in labels)
    return f"""select *, cast(hits as double) / greatest(non_null_count, 1) as type_share,
  non_null_count - hits as invalid_parse_count from (
  select "column", position, non_null_count, inferred_type,
    case inferred_type {hits} else non_null_count end as hits from (
    select *, case when non_null_count = 0 then 'string' {sure} {best} else 'string' end as inferred_type
    from ({parse_counts}) pc) x) y"""
