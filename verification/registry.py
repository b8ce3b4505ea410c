"""Every registered query: a Spark callable and, where SQL can say it, the SQL to match."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

import rowaccord as ra
from rowaccord.functions.storage import new_path, written
from rowaccord.operators.aggregates import aggregate_summary
from rowaccord.operators.diff import ROWS_PER_TASK
from rowaccord.plans.report import latest_runs

from . import duckdb_sql as q
from . import snapshots as s

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None, *tables: str):
    """Register a function of the session; its tables are loaded as views before it runs."""

    def register(f: Callable[[SparkSession], DataFrame]) -> Callable[[SparkSession], DataFrame]:
        def run(spark: SparkSession, folder: str) -> DataFrame:
            s.load(spark, folder, *tables)
            return f(spark)

        name = f.__name__
        QUERIES[name] = run
        if sql is not None:
            ORACLES[name] = sql
        return f

    return register


def orders_diff(spark: SparkSession, rules: ra.IgnoreRules | None = None, **options) -> ra.Diff:
    two = options.pop("two", s.ORDERS_2)
    return ra.diff(
        spark.table("orders"), spark.sql(two), ["o_orderkey"], rules=rules or ra.IgnoreRules(), **options
    )


CASE = ra.IgnoreRules(case=True)
BLANKS = ra.IgnoreRules(whitespace=True)
BOTH = ra.IgnoreRules(case=True, whitespace=True)


def both_rules(c: str) -> str:
    return q.lowered(q.stripped(c))


# ---- diff ---------------------------------------------------------------------------------


@query(f"with {q.classified(*q.ORDERS)} select o_orderkey, change_type from j", "orders")
def diff_classified(spark):
    return orders_diff(spark).classified().drop("join_rows")


@query(q.counts(*q.ORDERS), "orders")
def diff_counts(spark):
    return orders_diff(spark).counts()


@query(q.counts(*q.ORDERS, rule=q.lowered), "orders")
def diff_counts_ignore_case(spark):
    return orders_diff(spark, CASE).counts()


@query(q.counts(*q.ORDERS, rule=q.stripped), "orders")
def diff_counts_ignore_whitespace(spark):
    return orders_diff(spark, BLANKS).counts()


@query(q.counts(*q.ORDERS, rule=both_rules), "orders")
def diff_counts_case_whitespace(spark):
    return orders_diff(spark, BOTH).counts()


@query(
    q.counts(
        s.CUSTOMER_BLANK_1, s.CUSTOMER_BLANK_2, ["c_custkey"], ["c_mktsegment"],
        rule=lambda c: f"case when {q.stripped(c)} <> '' then {c} end",
    ),
    "customer",
)
def diff_counts_null_vs_blank(spark):
    rules = ra.IgnoreRules(null_vs_blank=True)
    one, two = spark.sql(s.CUSTOMER_BLANK_1), spark.sql(s.CUSTOMER_BLANK_2)
    return ra.diff_counts(one, two, ["c_custkey"], rules=rules)


@query(
    q.counts(
        s.ORDERS_DATES.format(**s.DUCK_DATES), s.ORDERS_DATES_2.format(**s.DUCK_DATES), ["o_orderkey"], ["day"],
        rule=lambda c: f"coalesce(strftime(coalesce(try_strptime({c}, '%Y-%m-%d'), "
        f"try_strptime({c}, '%m/%d/%Y')), '%Y-%m-%d'), {c})",
    ),
    "orders",
)
def diff_counts_date_format(spark):
    rules = ra.IgnoreRules(date_format=True)
    one = spark.sql(s.ORDERS_DATES.format(**s.SPARK_DATES))
    two = spark.sql(s.ORDERS_DATES_2.format(**s.SPARK_DATES))
    return ra.diff_counts(one, two, ["o_orderkey"], rules=rules)


@query(q.column_stats(q.ORDERS_COLUMNS, q.classified(*q.ORDERS, rule=both_rules)), "orders")
def diff_column_stats(spark):
    return orders_diff(spark, BOTH).column_stats()


@query(q.counts("select * from orders", s.ORDERS_2, ["o_orderkey"], ["o_orderstatus"], ["o_totalprice"]), "orders")
def diff_compare_columns(spark):
    return orders_diff(spark, compare_columns=["o_totalprice", "o_orderstatus"]).counts()


@query(q.counts(*q.ORDERS), "orders")
def diff_column_map(spark):
    names = [
        {"f1": "o_orderkey", "f2": "order_id"},
        {"f1": "o_orderstatus", "f2": "status"},
        {"f1": "o_totalprice", "f2": "price"},
        {"f1": "o_custkey", "f2": "no_such_column"},
    ]
    return orders_diff(spark, two=s.ORDERS_RENAMED, column_map=names).counts()


LINE_KEYS = ["l_orderkey", "l_partkey", "l_suppkey"]
LINE_TEXTS = ["l_returnflag", "l_linestatus"]
LINE_OTHERS = ["l_linenumber", "l_quantity", "l_extendedprice", "l_discount", "l_tax", "l_shipdate"]


@query(q.counts("select * from lineitem", s.LINEITEM_2, LINE_KEYS, LINE_TEXTS, LINE_OTHERS, rule=q.lowered), "lineitem")
def diff_composite_key(spark):
    return ra.diff_counts(spark.table("lineitem"), spark.sql(s.LINEITEM_2), LINE_KEYS, rules=CASE)


@query(
    q.counts(
        "select * from orders", s.ORDERS_DRIFTED, ["o_orderkey"], q.ORDERS_TEXTS, q.ORDERS_OTHERS,
        raw_casts=["o_custkey"],
    ),
    "orders",
)
def diff_type_drift(spark):
    return orders_diff(spark, two=s.ORDERS_DRIFTED).counts()


LARGE_KEYS = "select {key} as k, o_orderstatus as st, o_custkey as c from orders"
LARGE = "cast(o_orderkey as bigint) + 9007199254740992"


@query(
    q.counts(
        LARGE_KEYS.format(key=LARGE), LARGE_KEYS.format(key=f"cast(cast({LARGE} as double) as bigint)"), ["k"], ("st",), ("c",)
    ),
    "orders",
)
def diff_large_mixed_keys(spark):
    """A bigint key against a double one where a double holds every second number only."""
    one, two = (spark.sql(LARGE_KEYS.format(key=k)) for k in (LARGE, f"cast({LARGE} as double)"))
    return ra.diff(one, two, ["k"]).counts()


REPEATED_KEYS = ["l_orderkey", "l_linenumber"]
REPEATED_OTHERS = ["l_partkey", "l_suppkey", "l_quantity", "l_extendedprice", "l_discount", "l_tax", "l_shipdate"]
REPEATED = ("select * from lineitem", s.LINEITEM_2, REPEATED_KEYS, LINE_TEXTS, REPEATED_OTHERS)


@query(q.counts(*REPEATED, rule=q.lowered), "lineitem")
def diff_duplicate_keys(spark):
    return ra.diff_counts(spark.table("lineitem"), spark.sql(s.LINEITEM_2), REPEATED_KEYS, rules=CASE)


@query(q.counts(*REPEATED, rule=q.lowered), "lineitem")
def diff_duplicate_keys_factored(spark):
    """The same comparison with every key that repeats on both sides counted from copies."""
    return ra.diff_counts(
        spark.table("lineitem"), spark.sql(s.LINEITEM_2), REPEATED_KEYS, rules=CASE
    )


# Three keys, each with a third of all rows: pairs are counted without being formed.
HOT_COLUMNS = ["l_linestatus", "l_discount"]
HOT_1 = "select l_linenumber, l_returnflag, l_linestatus, l_discount from lineitem"
HOT_2 = "select l_linenumber, l_returnflag, l_linestatus, case when l_quantity < 10 then null else l_discount end as l_discount from lineitem"


def _hot_sql() -> str:
    """Equal pairs per column from group counts; all pairs from key counts."""

    def equal(c: str) -> str:
        return (
            f"(select cast(sum(x.n * y.n) as bigint) from (select l_returnflag, {c} as v, count(*) as n from a group by all) x "
            f"join (select l_returnflag, {c} as v, count(*) as n from b group by all) y "
            "on x.l_returnflag = y.l_returnflag and x.v is not distinct from y.v)"
        )

    pairs = (
        "(select cast(sum(x.n * y.n) as bigint) from (select l_returnflag, count(*) as n from a group by all) x "
        "join (select l_returnflag, count(*) as n from b group by all) y on x.l_returnflag = y.l_returnflag)"
    )
    known = (
        "(select cast(sum(x.n * y.n) as bigint) from (select l_returnflag, count(l_discount) as n from a group by all) x "
        "join (select l_returnflag, count(*) - count(l_discount) as n from b group by all) y "
        "on x.l_returnflag = y.l_returnflag)"
    )
    rows = "(select greatest(count(*), 1) from a)"
    parts = []
    for i, c in enumerate(["l_linenumber", *HOT_COLUMNS]):
        introduced = known if c == "l_discount" else "cast(0 as bigint)"
        parts.append(
            f"""select '{c}' as "column", {i} as position, {pairs} - {equal(c)} as modified,
  cast(0 as bigint) as formatting_only, {introduced} as null_introduced, cast(0 as bigint) as null_resolved,
  cast({pairs} - {equal(c)} as double) / {rows} as change_rate"""
        )
    return f"with a as ({HOT_1}), b as ({HOT_2}) " + " union all ".join(parts)


@query(_hot_sql(), "lineitem")
def diff_hot_keys(spark):
    return ra.diff_column_stats(spark.sql(HOT_1), spark.sql(HOT_2), ["l_returnflag"])


@query(
    """select l_returnflag, x.n as rows_f1, y.n as rows_f2, x.n * y.n as join_rows
    from (select l_returnflag, count(*) as n from lineitem group by all) x
    join (select l_returnflag, count(*) as n from lineitem group by all) y using (l_returnflag)""",
    "lineitem",
)
def key_multiplicity_hot(spark):
    lines = spark.table("lineitem")
    return ra.key_multiplicity(lines, lines, ["l_returnflag"]).withColumn("join_rows", F.col("join_rows").cast("bigint"))


@query(
    f"""with a as ({HOT_1}), b as ({HOT_2}),
    x as (select l_returnflag, l_linenumber, l_linestatus, l_discount, count(*) as n from a group by all),
    y as (select l_returnflag, l_linenumber, l_linestatus, l_discount, count(*) as n from b group by all),
    total as (select l_returnflag, count(*) as n from b group by all),
    f as (select coalesce(x.l_returnflag, y.l_returnflag) as l_returnflag,
       coalesce(x.l_linenumber, y.l_linenumber) as l_linenumber,
       coalesce(x.l_linestatus, y.l_linestatus) as l_linestatus,
       case when x.n is null then cast(y.l_discount as varchar) else cast(x.l_discount as varchar) end as l_discount,
       coalesce(x.n, 0) as rows_f1, coalesce(y.n, 0) as rows_f2
    from x full join y on x.l_returnflag = y.l_returnflag and x.l_linenumber = y.l_linenumber
      and x.l_linestatus = y.l_linestatus and x.l_discount is not distinct from y.l_discount)
    select f.l_returnflag, cast(l_linenumber as varchar) as l_linenumber, l_linestatus, l_discount, rows_f1, rows_f2,
      rows_f1 * rows_f2 as unchanged, cast(0 as bigint) as formatting_only, rows_f1 * (total.n - rows_f2) as modified
    from f join total using (l_returnflag)""",
    "lineitem",
)
def diff_factored_contents(spark):
    contents = ra.diff(spark.sql(HOT_1), spark.sql(HOT_2), ["l_returnflag"]).factored_contents()
    return contents.select(
        "l_returnflag",
        *[F.col("values")[c].alias(c) for c in ("l_linenumber", *HOT_COLUMNS)],
        "rows_f1",
        "rows_f2",
        *[F.col(c).cast("bigint").alias(c) for c in ("unchanged", "formatting_only", "modified")],
    )


@query(
    f"with {q.classified(*REPEATED, rule=q.lowered)} select l_linenumber, change_type, count(*) as join_rows from j group by all",
    "lineitem",
)
def diff_repeated_classified(spark):
    """All join rows of keys that repeat on both sides, added up by change type."""
    d = ra.diff(spark.table("lineitem"), spark.sql(s.LINEITEM_2), REPEATED_KEYS, rules=CASE)
    return d.classified().groupBy("l_linenumber", "change_type").agg(F.sum("join_rows").cast("bigint").alias("join_rows"))


@query(
    f"""with a as ({HOT_1}), b as ({HOT_2}),
    x as (select l_returnflag as k, l_linenumber as p, l_linestatus as s, l_discount as d, count(*) as n from a group by all),
    y as (select l_returnflag as k, l_linenumber as p, l_linestatus as s, l_discount as d, count(*) as n from b group by all),
    total as (select l_returnflag as k, count(*) as n from b group by all)
    select x.k as l_returnflag, cast(x.p as varchar) as l_linenumber_f1, x.s as l_linestatus_f1,
      cast(x.d as varchar) as l_discount_f1, cast(null as varchar) as l_linenumber_f2,
      cast(null as varchar) as l_linestatus_f2, cast(null as varchar) as l_discount_f2,
      x.n * (total.n - coalesce(y.n, 0)) as join_rows
    from x join total on total.k = x.k
      left join y on x.k = y.k and x.p = y.p and x.s = y.s and x.d is not distinct from y.d
    where total.n > coalesce(y.n, 0)
    union all
    select y.k, null, null, null, cast(y.p as varchar), y.s, cast(y.d as varchar), cast(0 as bigint)
    from y left join x on x.k = y.k and x.p = y.p and x.s = y.s and x.d is not distinct from y.d where x.n is null""",
    "lineitem",
)
def diff_hot_changes(spark):
    """Changed contents of three keys that hold all rows."""
    changes = ra.diff(spark.sql(HOT_1), spark.sql(HOT_2), ["l_returnflag"], hot_key_rows=1000).changes()
    return changes.where("_change_type = 'modified'").select(
        "l_returnflag",
        *[f"{c}_f{i}" for i in (1, 2) for c in ("l_linenumber", *HOT_COLUMNS)],
        F.col("_join_rows").cast("bigint").alias("join_rows"),
    )


@query(
    q.counts(s.ORDERS_NULL_KEYS_1, s.ORDERS_NULL_KEYS_2, ["o_orderkey"], ["o_orderstatus"], ["o_custkey"]),
    "orders",
)
def diff_null_keys(spark):
    return ra.diff_counts(spark.sql(s.ORDERS_NULL_KEYS_1), spark.sql(s.ORDERS_NULL_KEYS_2), ["o_orderkey"])


_CHANGED_TEXTS = ", ".join(f"cast({c}_{n} as varchar) as {c}_f{n}" for n in (1, 2) for c in q.ORDERS_COLUMNS)


@query(
    f"""with {q.classified(*q.ORDERS, rule=both_rules)}
    select o_orderkey, change_type as _change_type,
      {q.changed_list(q.ORDERS_COLUMNS, '{c}_sem')} as changed,
      {q.changed_list(q.ORDERS_COLUMNS, '{c}_raw and not {c}_sem')} as changed_raw, {_CHANGED_TEXTS}
    from j where change_type <> 'unchanged'""",
    "orders",
)
def diff_changes(spark):
    changes = orders_diff(spark, BOTH).changes().drop("_join_rows")
    return changes.withColumn("changed", F.concat_ws(",", "changed")).withColumn(
        "changed_raw", F.concat_ws(",", "changed_raw")
    )


_BEFORE_AFTER = ", ".join(
    f"cast({c}_1 as varchar) as {c}_before, cast({c}_2 as varchar) as {c}_after" for c in q.ORDERS_COLUMNS
)


@query(
    f"""with {q.classified(*q.ORDERS)} select o_orderkey, change_type, {_BEFORE_AFTER},
    {q.changed_list(q.ORDERS_COLUMNS, '{c}_sem')} as changed from j where change_type <> 'unchanged'""",
    "orders",
)
def diff_before_after(spark):
    return orders_diff(spark).before_after().drop("_join_rows").withColumn("changed", F.concat_ws(",", "changed"))


@query(
    f"""with {q.classified(*q.ORDERS, rule=both_rules)}, c as (
      select *, case when change_type in ('added', 'removed') then 1.0::double else 0.5::double end as severity
      from j where change_type <> 'unchanged')
    select o_orderkey, cast(o_orderkey as varchar) as key, change_type, severity,
      {q.changed_list(q.ORDERS_COLUMNS, '{c}_sem')} as columns_changed,
      case when in_1 then coalesce(cast(o_totalprice_1 as varchar), '') end as price_1,
      case when in_2 then coalesce(cast(o_totalprice_2 as varchar), '') end as price_2
    from c order by severity desc, o_orderkey limit 200""",
    "orders",
)
def diff_sample(spark):
    return orders_diff(spark, BOTH).sample().select(
        "o_orderkey",
        "key",
        "change_type",
        "severity",
        F.concat_ws(",", "columns_changed").alias("columns_changed"),
        F.col("f1")["o_totalprice"].alias("price_1"),
        F.col("f2")["o_totalprice"].alias("price_2"),
    )


@query(
    f"""with {q.classified(*q.ORDERS)}, c as (select {q.COUNTS.format(keys='o_orderkey')} from j)
    select unnest([0, 1, 2, 3, 4, 5, 6, 7, 8]) as position,
      unnest(['Table 1', 'Table 2', 'Table 1 rows', 'Table 2 rows', 'Added rows', 'Removed rows', 'Modified rows',
              'Formatting-only rows', 'Key columns']) as field,
      unnest(['orders', 'orders later', cast(total_rows_f1 as varchar), cast(total_rows_f2 as varchar),
              cast(added_rows as varchar), cast(removed_rows as varchar), cast(modified_rows as varchar),
              cast(formatting_only_rows as varchar), 'o_orderkey']) as value from c""",
    "orders",
)
def diff_summary(spark):
    return ra.diff_summary(orders_diff(spark), "orders", "orders later")


@query(
    f"""with {q.classified(*q.ORDERS)}, c as (select {q.COUNTS.format(keys='o_orderkey')} from j)
    select added_rows as added, modified_rows as modified, rows_scanned, 'o_orderkey' as key_column,
      (select count(*) filter (where o_totalprice_sem and o_totalprice_2 is null) from j) as null_introduced,
      least(100, added_rows + removed_rows + modified_rows + formatting_only_rows) as sample_rows from c""",
    "orders",
)
def diff_json(spark):
    """The JSON document, read back through its own paths."""
    path = "get_json_object(json, '$.{}')".format
    return ra.diff_json(orders_diff(spark)).selectExpr(
        f"CAST({path('summary.added')} AS BIGINT) AS added",
        f"CAST({path('summary.modified')} AS BIGINT) AS modified",
        f"CAST({path('summary.rows_scanned')} AS BIGINT) AS rows_scanned",
        f"{path('summary.key_columns[0]')} AS key_column",
        f"CAST({path('column_diffs.o_totalprice.null_introduced')} AS BIGINT) AS null_introduced",
        f"CAST(json_array_length({path('sample_rows')}) AS BIGINT) AS sample_rows",
    )


# ---- profile ------------------------------------------------------------------------------

CUSTOMER_COLUMNS = [
    ("c_custkey", False), ("c_name", True), ("c_nationkey", False), ("c_acctbal", False), ("c_mktsegment", True),
    ("c_code", True),
]


@query(q.null_profile(s.CUSTOMER_DIRTY, CUSTOMER_COLUMNS), "customer")
def profile_nulls(spark):
    return ra.profile_nulls(spark.sql(s.CUSTOMER_DIRTY))


@query(
    q.null_profile(
        "select * from documents",
        [("doc_id", False), ("text", True), ("lang", True), ("source", True), ("n_chars", False)],
    ),
    "documents",
)
def profile_nulls_documents(spark):
    return ra.profile_nulls(spark.table("documents"))


LINE_COLUMNS = [
    "l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_quantity", "l_extendedprice", "l_discount", "l_tax",
    "l_returnflag", "l_linestatus", "l_shipdate",
]


def _distinct_sql(table: str, columns: list[str]) -> str:
    return " union all ".join(
        f"""select '{c}' as "column", {i} as position,
        count(distinct {c}) + max(case when {c} is null then 1 else 0 end) as distinct_count from {table}"""
        for i, c in enumerate(columns)
    )


@query(_distinct_sql(f"({s.LINEITEM_2}) t", LINE_COLUMNS), "lineitem")
def profile_distinct(spark):
    return ra.profile_distinct(spark.sql(s.LINEITEM_2))


@query(None, "lineitem")
def profile_distinct_approx(spark):
    return ra.profile_distinct(spark.sql(s.LINEITEM_2), exact=False)


def _min_max_sql(table: str, columns: list[str]) -> str:
    return " union all ".join(
        f"""select '{c}' as "column", {i} as position, min(cast({c} as varchar)) as min_text,
        max(cast({c} as varchar)) as max_text, cast(min({c}) as varchar) as min_value,
        cast(max({c}) as varchar) as max_value from {table}"""
        for i, c in enumerate(columns)
    )


ORDER_COLUMNS = ["o_orderkey", "o_custkey", "o_orderstatus", "o_totalprice", "o_orderdate", "o_orderpriority"]


@query(_min_max_sql("orders", ORDER_COLUMNS), "orders")
def profile_min_max(spark):
    return ra.profile_min_max(spark.table("orders"))


ORDERS_TEXT_COLUMNS = ["order_id", "customer", "status", "day", "urgent", "price"]
ORDERS_TEXT_2_COLUMNS = ["order_id", "customer", "day", "state", "price"]
TEXT_1, TEXT_2 = s.ORDERS_TEXT.format(**s.SPARK_DATES), s.ORDERS_TEXT_2.format(**s.SPARK_DATES)
DUCK_TEXT_1, DUCK_TEXT_2 = s.ORDERS_TEXT.format(**s.DUCK_DATES), s.ORDERS_TEXT_2.format(**s.DUCK_DATES)


@query(q.text_parse_counts(DUCK_TEXT_1, ORDERS_TEXT_COLUMNS), "orders")
def profile_parse_counts(spark):
    return ra.profile_parse_counts(spark.sql(TEXT_1))


@query(q.text_parse_counts("select text, lang, source from documents", ["text", "lang", "source"]), "documents")
def profile_parse_counts_documents(spark):
    return ra.profile_parse_counts(spark.sql("select text, lang, source from documents"))


TYPE_OUTPUT = 'select "column", position, non_null_count, inferred_type, type_share, invalid_parse_count from'


@query(f"{TYPE_OUTPUT} ({q.types(q.text_parse_counts(DUCK_TEXT_2, ORDERS_TEXT_2_COLUMNS))}) t", "orders")
def profile_types(spark):
    return ra.profile_types(spark.sql(TEXT_2)).select(
        "column", "position", "non_null_count", "inferred_type",
        F.expr("type_distribution[inferred_type]").alias("type_share"), "invalid_parse_count",
    )


def _samples_sql(table: str, columns: list[str]) -> str:
    return " union all ".join(
        f"""select '{c}' as "column", {i} as position, (select string_agg(v, '|' order by v) from
        (select distinct cast({c} as varchar) as v from {table} where {c} is not null order by v limit 5) x) as samples"""
        for i, c in enumerate(columns)
    )


@query(_samples_sql("part", ["p_partkey", "p_name", "p_brand", "p_type", "p_size", "p_retailprice"]), "part")
def profile_samples(spark):
    return ra.profile_samples(spark.table("part")).select(
        "column", "position", F.concat_ws("|", "sample_values").alias("samples")
    )


CODE_COLUMNS = ["c_name", "c_mktsegment", "c_code"]
CODE_TABLE = f"select c_name, c_mktsegment, c_code from ({s.CUSTOMER_DIRTY}) d"


@query(
    f"""select n.position, n."column", t.inferred_type, n.null_count, n.empty_count, n.whitespace_count,
      n.textual_null_count, n.total_null_variants, n.null_variant_rate, d.distinct_count, n.total_count,
      t.type_share, t.invalid_parse_count, m.min_text, m.max_text, m.min_value, m.max_value, x.samples
    from ({q.null_profile(CODE_TABLE, [(c, True) for c in CODE_COLUMNS])}) n
    join ({q.types(q.text_parse_counts(CODE_TABLE, CODE_COLUMNS))}) t using ("column")
    join ({_distinct_sql(f'({CODE_TABLE}) c', CODE_COLUMNS)}) d using ("column")
    join ({_min_max_sql(f'({CODE_TABLE}) c', CODE_COLUMNS)}) m using ("column")
    join ({_samples_sql(f'({CODE_TABLE}) c', CODE_COLUMNS)}) x using ("column")""",
    "customer",
)
def profile_columns(spark):
    profile = ra.profile_columns(spark.sql(CODE_TABLE))
    share = F.expr("type_distribution[inferred_type]").alias("type_share")
    samples = F.concat_ws("|", "sample_values").alias("samples")
    return profile.select("*", share, samples).drop("type_distribution", "sample_values")


@query(
    """select count(*) as total_count, count(distinct text) as distinct_count, min(text) as min_text,
    max(text) as max_text from documents""",
    "documents",
)
def profile_column_documents(spark):
    return ra.profile_column(spark.table("documents"), "text").select(
        "total_count", "distinct_count", "min_text", "max_text"
    )


# ---- keys ---------------------------------------------------------------------------------


def _unique_sql(table: str, keys: list[str]) -> str:
    names = ", ".join(keys)
    return f"""select cast(sum(n) as bigint) as total_rows, count(*) as distinct_keys,
    cast(sum(n) - count(*) as bigint) as duplicate_rows, sum(n) = count(*) as is_unique
    from (select {names}, count(*) as n from {table} group by {names}) g"""


@query(_unique_sql("lineitem", REPEATED_KEYS), "lineitem")
def key_uniqueness(spark):
    return ra.validate_key(spark.table("lineitem"), REPEATED_KEYS)


@query(_unique_sql("conversations", ["conv_id", "turn"]), "conversations")
def key_uniqueness_composite(spark):
    return ra.validate_key(spark.table("conversations"), ["conv_id", "turn"])


@query(
    f"""select count(*) as total_rows, count(*) filter (where c_mktsegment is null or c_code is null) as null_key_rows
    from ({s.CUSTOMER_DIRTY}) t""",
    "customer",
)
def key_nulls(spark):
    return ra.key_nulls(spark.sql(s.CUSTOMER_DIRTY), ["c_mktsegment", "c_code"])


@query(
    f"""select l_orderkey, l_linenumber, coalesce(x.n, 0) as rows_f1, coalesce(y.n, 0) as rows_f2,
      greatest(coalesce(x.n, 0), 1) * greatest(coalesce(y.n, 0), 1) as join_rows
    from (select l_orderkey, l_linenumber, count(*) as n from lineitem group by all) x
    full join (select l_orderkey, l_linenumber, count(*) as n from ({s.LINEITEM_2}) l group by all) y
      using (l_orderkey, l_linenumber)
    where x.n > 1 or y.n > 1""",
    "lineitem",
)
def key_multiplicity(spark):
    repeated = ra.key_multiplicity(spark.table("lineitem"), spark.sql(s.LINEITEM_2), REPEATED_KEYS)
    return repeated.withColumn("join_rows", F.col("join_rows").cast("bigint"))


def _single_keys_sql(table: str, columns: list[str]) -> str:
    parts = [
        f"""select '{c}' as columns, {i} as position, cast(count(distinct {c}) +
        max(case when {c} is null then 1 else 0 end) as double) / count(*) as uniqueness_ratio,
        cast(count(*) - count({c}) as double) / count(*) as null_rate from {table}"""
        for i, c in enumerate(columns)
    ]
    return f"""select columns, uniqueness_ratio, uniqueness_ratio >= 0.99 as is_unique, null_rate,
    uniqueness_ratio * (1.0::double - null_rate) as confidence from ({' union all '.join(parts)}) p"""


def _key_output(df: DataFrame) -> DataFrame:
    return df.withColumn("columns", F.concat_ws(",", "columns"))


@query(
    f"""select *, row_number() over (order by is_unique desc, confidence desc, columns) = 1 as recommended
    from ({_single_keys_sql('events', ['event_id', 'ts', 'user_id', 'event_type', 'value', 'props'])}) k""",
    "events",
)
def discover_keys(spark):
    return _key_output(ra.discover_keys(spark.table("events"))).drop("rank")


def _pair_sql(x: str, y: str) -> str:
    return f"""select '{x},{y}' as columns, (select count(*) from (select distinct {x}, {y} from t) d)
    / cast(count(*) as double) as uniqueness_ratio,
    count(*) filter (where {x} is null or {y} is null) / cast(count(*) as double) as null_rate from t"""


@query(
    f"""with t as (select conv_id, turn, role from conversations), p as ({_pair_sql('conv_id', 'turn')}),
    found as (select columns, uniqueness_ratio, uniqueness_ratio = 1 as is_unique, null_rate,
      case when uniqueness_ratio = 1 then 0.85::double else uniqueness_ratio * 0.85::double end as confidence from p
      union all {_single_keys_sql('t', ['conv_id', 'turn', 'role'])})
    select *, row_number() over (order by is_unique desc, confidence desc) = 1 as recommended from found""",
    "conversations",
)
def discover_keys_composite(spark):
    return _key_output(ra.discover_keys(spark.sql("select conv_id, turn, role from conversations"))).drop("rank")


WIDE_COLUMNS = ["l_orderkey", "l_partkey", "l_suppkey", "l_shipdate", "l_quantity", "l_linenumber"]
WIDE = f"""select l_orderkey, l_linenumber, {', '.join(f'max({c}) as {c}' for c in WIDE_COLUMNS[1:-1])} from lineitem
    group by l_orderkey, l_linenumber"""


def _wide(spark: SparkSession) -> DataFrame:
    """The grouped lines, written once: a search reads them many times and would group them anew each time.

    Lines are dealt by key before, to tasks whose number follows that of the lines: few of them share a key.
    """
    lines = spark.table("lineitem")
    dealt = lines.repartition(1 + lines.count() // ROWS_PER_TASK, "l_orderkey", "l_linenumber")
    return written(spark.sql(WIDE.replace("from lineitem", "from {lines}"), lines=dealt), "wide")


def _pairs_sql(columns: list[str]) -> str:
    """All pairs whose distinct counts multiply to the row count at least."""
    parts = [
        f"select * from ({_pair_sql(x, y)}) where (select (count(distinct {x}) + max(({x} is null)::int)) "
        f"* (count(distinct {y}) + max(({y} is null)::int)) >= count(*) from t)"
        for i, x in enumerate(columns)
        for y in columns[i + 1 :]
    ]
    return " union all ".join(parts)


@query(
    f"""with t as ({WIDE}), p as ({_pairs_sql(WIDE_COLUMNS)}),
    found as (select columns, uniqueness_ratio, uniqueness_ratio = 1 as is_unique, null_rate,
      case when uniqueness_ratio = 1 then 0.85::double else uniqueness_ratio * 0.85::double end as confidence from p
      union all {_single_keys_sql('t', WIDE_COLUMNS)})
    select array_to_string(list_sort(string_split(columns, ',')), ',') as columns, uniqueness_ratio, is_unique, null_rate,
      confidence from found""",
    "lineitem",
)
def discover_keys_wide(spark):
    """The key's line number has fewer values than five other columns."""
    found = ra.discover_keys(_wide(spark).select(*WIDE_COLUMNS)).drop("rank", "recommended")
    return _key_output(found.withColumn("columns", F.sort_array("columns")))


def _unique_pairs_sql(columns: list[str], table: str) -> str:
    parts = [
        f"select ['{x}', '{y}'] as columns, {i} as place_1, {j} as place_2, "
        f"count(*) filter (where {x} is null or {y} is null) as null_rows, count(*) as n, "
        f"(select count(*) from (select distinct {x}, {y} from {table}) d) as k from {table}"
        for i, x in enumerate(columns)
        for j, y in enumerate(columns)
        if i < j
    ]
    return f"""select row_number() over (order by null_rows, place_1, place_2)::integer as rank,
    array_to_string(columns, ',') as columns, 2 as n_columns, null_rows, null_rows / n::double as null_rate
    from ({' union all '.join(parts)}) p where n = k"""


@query(f"with t as ({WIDE}) {_unique_pairs_sql(WIDE_COLUMNS, 't')}", "lineitem")
def smallest_keys_wide(spark):
    """No single column is a key; all pairs that are."""
    return _key_output(ra.smallest_keys(_wide(spark).select(*WIDE_COLUMNS)))


LATER_LINES = f"select * replace (l_quantity + case when l_partkey % 9 = 0 then 1 else 0 end as l_quantity) from ({WIDE}) w where l_orderkey % 40 <> 0"


@query(
    q.counts(WIDE, LATER_LINES, ["l_orderkey", "l_linenumber"], [], [c for c in WIDE_COLUMNS[1:-1]]),
    "lineitem",
)
def compare_composite_key(spark):
    """The whole comparison without keys: no column is one, two columns are."""
    wide = _wide(spark)
    later = wide.where("l_orderkey % 40 <> 0")
    later = later.withColumn("l_quantity", F.expr("l_quantity + if(l_partkey % 9 = 0, 1, 0)"))
    return ra.compare(wide.select("l_linenumber", *WIDE_COLUMNS[:-1]), later.select(*WIDE_COLUMNS)).counts()


def _top_keys_sql(table: str, columns: list[str], n: int) -> str:
    return f"""(select columns, r as rank_f{n}, uniqueness_ratio as unique_rate_f{n}, is_unique as is_unique_f{n} from (
    select *, cast(row_number() over (order by is_unique desc, confidence desc, columns) as integer) as r
    from ({_single_keys_sql(table, columns)}) k) ranked where r <= 3)"""


@query(
    f"""select * from {_top_keys_sql('orders', ORDER_COLUMNS, 1)} x
    full join {_top_keys_sql(f'({s.ORDERS_2}) o', ORDER_COLUMNS, 2)} y using (columns)""",
    "orders",
)
def suggest_keys(spark):
    return _key_output(ra.suggest_keys(spark.table("orders"), spark.sql(s.ORDERS_2)))


# ---- schemas of text tables, typed from all their values --------------------------------------


@query(
    """select * from (values
      ('customer', 'both', 1, 1, 'string', 'bigint', false, false),
      ('day', 'both', 3, 2, 'string', 'string', true, false),
      ('order_id', 'both', 0, 0, 'bigint', 'bigint', true, false),
      ('price', 'both', 5, 4, 'double', 'double', true, false),
      ('state', 'only_in_2', null, 3, null, 'string', null, null),
      ('status', 'only_in_1', 2, null, 'string', null, null, null),
      ('urgent', 'only_in_1', 4, null, 'boolean', null, null, null)
    ) t(name, status, position_1, position_2, dtype_1, dtype_2, same_type, moved)""",
    "orders",
)
def compare_inferred_schemas(spark):
    """Types come from a scan of every value of both tables."""
    return ra.compare_schemas(ra.infer_types(spark.sql(TEXT_1)), ra.infer_types(spark.sql(TEXT_2)))


@query(
    """select 2::bigint as only_in_1, 1::bigint as only_in_2, 4::bigint as in_both, 1::bigint as type_mismatches,
    false as reordered, 85.0::double as score""",
    "orders",
)
def inferred_schema_score(spark):
    return ra.schema_score(ra.infer_types(spark.sql(TEXT_1)), ra.infer_types(spark.sql(TEXT_2)))


@query(
    "select cast(o_orderkey as bigint) as order_id, case when o_totalprice > 495000 then 'n/a' "
    "else cast(o_custkey as varchar) end as customer, o_orderstatus as status, "
    "strftime(o_orderdate, '%Y-%m-%d') as day, o_orderpriority = '1-URGENT' as urgent, "
    "cast(cast(o_totalprice as decimal(12,2)) as double) as price from orders",
    "orders",
)
def infer_types(spark):
    return ra.infer_types(spark.sql(TEXT_1))


# ---- checks -------------------------------------------------------------------------------

RULES = (
    ra.ColumnRule("c_custkey", required=True, expected_type="integer", min_value=0),
    ra.ColumnRule("c_mktsegment", max_null_rate=0.01, allowed_values=["BUILDING", "AUTOMOBILE", "MACHINERY"]),
    ra.ColumnRule("c_acctbal", min_value=0.0, max_value=9000.0),
    ra.ColumnRule("c_name", regex_pattern="^Customer#[0-9]{9}$"),
    ra.ColumnRule("c_code", expected_type="integer"),
    ra.ColumnRule("c_phone", required=True),
)
CHECK_OUTPUT = ("name", "severity", "passed", "column", "affected_count")
_RULE_COUNTS = f"""r as (select
    count(*) filter (where c_mktsegment is null) as seg_null,
    count(*) filter (where c_mktsegment not in ('BUILDING', 'AUTOMOBILE', 'MACHINERY')) as seg_other,
    count(*) filter (where c_acctbal < 0) as low, count(*) filter (where c_acctbal > 9000) as high,
    count(*) filter (where not regexp_full_match(c_name, 'Customer#[0-9]{{9}}')) as names,
    count(*) as n, count(c_code) - count(*) filter (where regexp_full_match(c_code, '{q.INTEGER}')) as code_bad
    from t)"""
_RULES_SQL = """
    select 'Business Rule: c_custkey' as name, 'INFO' as severity, true as passed, 'c_custkey' as "column", null::bigint as affected_count
    union all select 'Business Rule: c_mktsegment', 'ERROR', false, 'c_mktsegment', seg_null from r where seg_null > 0.01 * n
    union all select 'Business Rule: c_mktsegment', 'ERROR', false, 'c_mktsegment', seg_other from r where seg_other > 0
    union all select 'Business Rule: c_acctbal', 'ERROR', false, 'c_acctbal', low from r where low > 0
    union all select 'Business Rule: c_acctbal', 'ERROR', false, 'c_acctbal', high from r where high > 0
    union all select 'Business Rule: c_acctbal', 'INFO', true, 'c_acctbal', null from r where low = 0 and high = 0
    union all select 'Business Rule: c_name', 'INFO', true, 'c_name', null from r where names = 0
    union all select 'Business Rule: c_name', 'ERROR', false, 'c_name', names from r where names > 0
    union all select 'Business Rule: c_code', 'INFO', true, 'c_code', null from r
    union all select 'Business Rule: c_phone', 'ERROR', false, 'c_phone', null from r"""


@query(f"with t as ({s.CUSTOMER_DIRTY}), {_RULE_COUNTS} {_RULES_SQL}", "customer")
def rule_checks(spark):
    return ra.rule_checks(spark.sql(s.CUSTOMER_DIRTY), RULES).select(*CHECK_OUTPUT)


CHECK_CONFIG = ra.ValidationConfig(null_warn_threshold=0.05, null_error_threshold=0.18, business_rules=RULES)
_CHECKS_SQL = f"""
    with t as ({s.CUSTOMER_DIRTY}), {_RULE_COUNTS},
    n as ({q.null_profile(s.CUSTOMER_DIRTY, CUSTOMER_COLUMNS)}),
    k as (select c_mktsegment, count(*) as n from t group by c_mktsegment),
    c as ({_RULES_SQL}
    union all select 'Row Count', 'INFO', true, null, count(*) from t
    union all select 'High Null Rate', case when null_variant_rate > 0.18 then 'ERROR' else 'WARNING' end, false, "column",
      total_null_variants from n where null_variant_rate > 0.05
    union all select 'Textual Nulls', 'WARNING', false, "column", textual_null_count from n where textual_null_count > 0
    union all select 'Mixed Types', 'WARNING', false, 'c_code', code_bad from r where code_bad > 0
    union all select 'Duplicate Keys', 'CRITICAL', false, 'c_mktsegment', cast(sum(n) - count(*) as bigint) from k
    union all select 'Key Column Nulls', 'WARNING', false, 'c_mktsegment', seg_null from r where seg_null > 0)"""


@query(f"{_CHECKS_SQL} select * from c", "customer")
def checks(spark):
    return ra.checks(spark.sql(s.CUSTOMER_DIRTY), CHECK_CONFIG, ["c_mktsegment"]).select(*CHECK_OUTPUT)


@query(
    f"""with t as ({s.CUSTOMER_DIRTY}), n as ({q.null_profile(s.CUSTOMER_DIRTY, CUSTOMER_COLUMNS)})
    select 'Row Count' as name, null as "column", 'table has ' || format('{{:,}}', count(*)) || ' rows' as message from t
    union all select 'High Null Rate', "column",
      "column" || ': ' || printf('%.1f%%', 100 * null_variant_rate) || ' of the values are missing in some form'
      from n where null_variant_rate > 0.05
    union all select 'Textual Nulls', "column", "column" || ': ' || textual_null_count || ' values are words for null'
      from n where textual_null_count > 0""",
    "customer",
)
def check_messages(spark):
    """The texts of the checks, with their percentages and grouped digits."""
    found = ra.checks(spark.sql(s.CUSTOMER_DIRTY), ra.ValidationConfig(null_warn_threshold=0.05))
    return found.where("name IN ('Row Count', 'High Null Rate', 'Textual Nulls')").select("name", "column", "message")


@query(
    f"""{_CHECKS_SQL} select position, severity, (select count(*) from c where c.severity = l.severity) as checks
    from (values (0, 'INFO'), (1, 'WARNING'), (2, 'ERROR'), (3, 'CRITICAL')) l(position, severity)""",
    "customer",
)
def check_summary(spark):
    return ra.check_summary(ra.checks(spark.sql(s.CUSTOMER_DIRTY), CHECK_CONFIG, ["c_mktsegment"]))


@query(
    f"""with a as ({DUCK_TEXT_1}), b as ({DUCK_TEXT_2})
    select *, 85.0::double as compatibility_score from (
    select 1 as table_no, 'Row Count' as name, 'INFO' as severity, null as "column", count(*) as affected_count from a
    union all select 2, 'Row Count', 'INFO', null, count(*) from b
    union all select 1, 'Mixed Types', 'WARNING', 'customer', count(*) from a where customer = 'n/a' having count(*) > 0
    union all select 1, 'Textual Nulls', 'WARNING', 'customer', count(*) from a where customer = 'n/a' having count(*) > 0
    union all select 2, 'Mixed Types', 'WARNING', 'day',
      least(count(*) filter (where day like '%/%'), count(*) filter (where day not like '%/%')) from b
    union all select 1, 'Schema Drift', 'WARNING', null, null
    union all select 2, 'Schema Drift', 'WARNING', null, null) c""",
    "orders",
)
def validate_pair(spark):
    one, two = ra.infer_types(spark.sql(TEXT_1)), ra.infer_types(spark.sql(TEXT_2))
    return ra.validate_pair(one, two, keys=["order_id"]).select(
        "table_no", "name", "severity", "column", "affected_count", "compatibility_score"
    )


@query("""select 'Row Count' as name, count(*) as affected_count from lineitem""", "lineitem")
def checks_with_given_profile(spark):
    profile = ra.profile_columns(spark.table("lineitem"), samples=False)
    return ra.checks(spark.table("lineitem"), profile=profile).select("name", "affected_count")


@query(
    f"""select n.position, n."column", t.inferred_type, t.type_share, t.invalid_parse_count, n.total_null_variants,
      n.null_variant_rate from ({q.null_profile(CODE_TABLE, [(c, True) for c in CODE_COLUMNS])}) n
    join ({q.types(q.text_parse_counts(CODE_TABLE, CODE_COLUMNS))}) t using ("column")""",
    "customer",
)
def profile_quality(spark):
    return ra.profile_quality(spark.sql(CODE_TABLE)).select(
        "position", "column", "inferred_type", F.expr("type_distribution[inferred_type]").alias("type_share"),
        "invalid_parse_count", "total_null_variants", "null_variant_rate",
    )


# ---- value sets, aggregates, several candidates ----------------------------------------------

PAIRS = [("p_name", "p_name"), ("p_brand", "p_brand"), ("p_size", "p_size")]


def _value_sets_sql() -> str:
    parts = []
    for i, (x, y) in enumerate(PAIRS):
        parts.append(
            f"""select {i} as pair, '{x}' as f1_col, '{y}' as f2_col, coalesce(x.v, y.v) as value,
            case when y.v is null then 'only_in_f1' when x.v is null then 'only_in_f2' else 'in_both' end as bucket
            from (select distinct cast({x} as varchar) as v from part where {x} is not null) x
            full join (select distinct cast({y} as varchar) as v from ({s.PART_2}) p where {y} is not null) y on x.v = y.v"""
        )
    return " union all ".join(parts)


@query(
    f"""select pair, f1_col, f2_col, count(*) filter (where bucket = 'only_in_f1') as only_in_f1_count,
    count(*) filter (where bucket = 'only_in_f2') as only_in_f2_count,
    count(*) filter (where bucket = 'in_both') as in_both_count, cast(null as varchar) as error
    from ({_value_sets_sql()}) s group by pair, f1_col, f2_col""",
    "part",
)
def value_set_counts(spark):
    return ra.value_set_counts(spark.table("part"), spark.sql(s.PART_2), PAIRS)


@query(
    f"""select pair, f1_col, f2_col, value, bucket, cast(r as integer) as rank from (
    select *, row_number() over (partition by pair, bucket order by value) as r from ({_value_sets_sql()}) s) t
    where r <= 500""",
    "part",
)
def value_set_members(spark):
    return ra.value_set_members(spark.table("part"), spark.sql(s.PART_2), PAIRS)


@query(_value_sets_sql(), "part")
def value_set_all_members(spark):
    return ra.value_set_members(spark.table("part"), spark.sql(s.PART_2), PAIRS, limit=None)


def _grouped_sql(keys: list[str], measures: dict[str, str], one: str, two: str) -> str:
    """Aggregates of both sides, matched null-safely, with status and differences."""
    aggs = ", ".join(f"{sql} as {m}" for m, sql in measures.items())
    names = ", ".join(keys)
    on = " and ".join(f"x.{k} is not distinct from y.{k}" for k in keys)
    differs = {m: f"(x.{m} is distinct from y.{m})" for m in measures}
    outputs = ", ".join(
        f"x.{m} as {m}_f1, y.{m} as {m}_f2, coalesce(x._in and y._in and {d}, false) as {m}_differs"
        for m, d in differs.items()
    )
    return f"""select {', '.join(f'case when x._in then x.{k} else y.{k} end as {k}' for k in keys)},
    case when y._in is null then 'only_in_f1' when x._in is null then 'only_in_f2'
         when {' or '.join(differs.values())} then 'differs' else 'equal' end as status, {outputs}
    from (select {names}, true as _in, {aggs} from ({one}) a group by {names}) x
    full join (select {names}, true as _in, {aggs} from ({two}) b group by {names}) y on {on}"""


_TRANSACTIONS = _grouped_sql(
    ["l_orderkey"], {"count": "count(*)", "sum_l_quantity": "sum(l_quantity)"}, "select * from lineitem", s.LINEITEM_2
)


@query(f"select * from ({_TRANSACTIONS}) t where status <> 'equal'", "lineitem")
def transactional_compare(spark):
    return ra.transactional_compare(spark.table("lineitem"), spark.sql(s.LINEITEM_2), ["l_orderkey"], ["l_quantity"])


@query(
    f"""select count(*) as keys, count(*) filter (where status = 'only_in_f1') as only_in_f1,
    count(*) filter (where status = 'only_in_f2') as only_in_f2, count(*) filter (where status = 'differs') as differs,
    count(*) filter (where count_differs) as count_differs,
    count(*) filter (where sum_l_quantity_differs) as sum_l_quantity_differs from ({_TRANSACTIONS}) t""",
    "lineitem",
)
def transactional_summary(spark):
    full = ra.transactional_compare(
        spark.table("lineitem"), spark.sql(s.LINEITEM_2), ["l_orderkey"], ["l_quantity"], only_mismatches=False
    )
    return aggregate_summary(full, ["count", "sum_l_quantity"])


DEARER = "select * replace (l_extendedprice + case when l_orderkey % 500 = 0 then 1 else 0 end as l_extendedprice) from lineitem"


@query(
    _grouped_sql(["l_suppkey"], {"sum_l_extendedprice": "sum(l_extendedprice::decimal(18, 4))"}, "select * from lineitem", DEARER)
    .replace("x.sum_l_extendedprice as", "round(x.sum_l_extendedprice::double, 2) as")
    .replace("y.sum_l_extendedprice as", "round(y.sum_l_extendedprice::double, 2) as"),
    "lineitem",
)
def exact_sums(spark):
    """Sums of prices per supplier: rows in another order differ nowhere, one more in some orders does."""
    lines = spark.table("lineitem")
    dearer = lines.withColumn("l_extendedprice", F.expr("l_extendedprice + if(l_orderkey % 500 = 0, 1, 0)"))
    dearer = dearer.repartition(13, "l_partkey").sortWithinPartitions(F.desc("l_extendedprice"))
    found = ra.aggregation_compare(
        lines, dearer, ["l_suppkey"], {"sum_l_extendedprice": ra.ExactSum("l_extendedprice")}, only_mismatches=False
    )
    for side in ("f1", "f2"):
        found = found.withColumn(f"sum_l_extendedprice_{side}", F.round(f"sum_l_extendedprice_{side}", 2))
    return found


MEASURES = {
    "lines": "count(*)", "quantity": "sum(l_quantity)", "discounts": "count(l_discount)", "top_price": "max(l_extendedprice)",
}


@query(
    _grouped_sql(["l_returnflag", "l_linestatus"], MEASURES, "select * from lineitem", s.LINEITEM_2),
    "lineitem",
)
def aggregation_compare(spark):
    return ra.aggregation_compare(
        spark.table("lineitem"), spark.sql(s.LINEITEM_2), ["l_returnflag", "l_linestatus"], MEASURES, only_mismatches=False
    )


@query(
    _grouped_sql(["l_discount", "l_linenumber"], {"lines": "count(*)"}, "select * from lineitem", s.LINEITEM_2)
    .replace("select case", "select 0 as _level, case", 1)
    + " union all "
    + _grouped_sql(["l_discount", "l_linenumber"], {"lines": "count(*)"}, "select * replace (null::integer as l_linenumber) from lineitem", f"select * replace (null::integer as l_linenumber) from ({s.LINEITEM_2}) i")
    .replace("select case", "select 1 as _level, case", 1)
    + " union all "
    + _grouped_sql(["l_discount", "l_linenumber"], {"lines": "count(*)"}, "select * replace (null::integer as l_linenumber, null::double as l_discount) from lineitem", f"select * replace (null::integer as l_linenumber, null::double as l_discount) from ({s.LINEITEM_2}) i")
    .replace("select case", "select 2 as _level, case", 1),
    "lineitem",
)
def aggregation_compare_rollup(spark):
    return ra.aggregation_compare(
        spark.table("lineitem"), spark.sql(s.LINEITEM_2), ["l_discount", "l_linenumber"], {"lines": "count(*)"},
        only_mismatches=False, rollup=True,
    )


@query(
    f"select 'later' as candidate, * from ({q.counts(*q.ORDERS)}) x union all select 'same' as candidate, * from "
    f"({q.counts('select * from orders', 'select * from orders', ['o_orderkey'], q.ORDERS_TEXTS, q.ORDERS_OTHERS)}) y",
    "orders",
)
def multi_compare(spark):
    orders = spark.table("orders")
    return ra.multi_compare(orders, {"later": spark.sql(s.ORDERS_2), "same": orders}, keys=["o_orderkey"])


@query(q.counts(*q.ORDERS), "orders")
def compare_found_key(spark):
    """The whole comparison, with the key found by discovery."""
    return ra.compare(spark.table("orders"), spark.sql(s.ORDERS_2)).counts()


def _tenth(table: str) -> str:
    return f"select * from ({table}) p where ('0x' || substr(md5(o_orderkey::varchar), 1, 8))::ubigint / 4294967296.0 < 0.1"


@query(
    f"select * replace (false as is_full_count) from ({q.counts(*map(_tenth, q.ORDERS[:2]), *q.ORDERS[2:])}) x",
    "orders",
)
def compare_preview(spark):
    """A tenth of the keys, by hash."""
    return ra.compare(spark.table("orders"), spark.sql(s.ORDERS_2), keys=["o_orderkey"], preview=0.1).counts()


def _sum_of(parts: list[str]) -> str:
    return " + ".join(f"({p})" for p in parts)


@query(
    f"""with {q.classified(*q.ORDERS)}
    select 'checks' as part, 2::bigint as entries, (select count(*) from a) + (select count(*) from b) as total
    union all select 'column_diffs', 5, {_sum_of([f"select count(*) from j where {c}_sem" for c in q.ORDERS_COLUMNS])}
    union all select 'profile_1', 6, {_sum_of([f"select count(distinct {c}) from a" for c in ORDER_COLUMNS])}
    union all select 'profile_2', 6, {_sum_of([f"select count(distinct {c}) from b" for c in ORDER_COLUMNS])}
      + (select case when count(*) > count(o_totalprice) then 1 else 0 end from b)
    union all select 'schema', 6, null union all select 'score', 1, null""",
    "orders",
)
def report_json(spark):
    """Parts of the JSON report, read back: entries, and the sum of their main counter."""
    c = ra.compare(spark.table("orders"), spark.sql(s.ORDERS_2), keys=["o_orderkey"])
    fields = "array<struct<affected_count:bigint, modified:bigint, distinct_count:bigint>>"
    parts = ra.report_json(c).withColumn("e", F.from_json("json", fields))
    return parts.selectExpr(
        "part",
        "CAST(size(e) AS BIGINT) AS entries",
        "aggregate(e, CAST(NULL AS BIGINT), (acc, x) -> "
        "CASE WHEN coalesce(x.affected_count, x.modified, x.distinct_count) IS NULL THEN acc "
        "ELSE coalesce(acc, 0) + coalesce(x.affected_count, x.modified, x.distinct_count) END) AS total",
    )


_REPORT_ROWS = {
    "key": "1", "counts": "1", "column_stats": "5", "summary": "9", "schema": "6", "renames": "0", "score": "1",
    "profile_1": "6", "profile_2": "6", "check_summary": "4", "json": "1", "contents": "0",
    "multiplicity": "(select count(*) from (select 1 from a group by o_orderkey having count(*) > 1) x)"
    " + (select count(*) from (select 1 from b group by o_orderkey having count(*) > 1) y)",
    "sample": "least(200, (select count(*) from c))",
    **dict.fromkeys(("join", "changes", "before_after"), "(select count(*) from c)"),
}


@query(
    f"with {q.classified(*q.ORDERS)}, c as (select * from j where change_type <> 'unchanged') "
    + " union all ".join(f"select '{n}' as \"table\", cast({v} as bigint) as n_rows, true as as_listed" for n, v in _REPORT_ROWS.items()),
    "orders",
)
def report_resumed(spark):
    """A report broken half-way and resumed: the rows that each of its tables holds, and whether the manifest says so."""

    def fail():
        raise InterruptedError

    def comparison():
        return ra.compare(spark.table("orders"), spark.sql(s.ORDERS_2), keys=["o_orderkey"])

    folder = new_path(spark, "reports")
    broken = comparison()
    broken.sample = fail
    try:
        ra.write_report(broken, folder, "r")
    except InterruptedError:
        pass
    tables = ra.read_report(spark, ra.write_report(comparison(), folder, "r", resume=True))
    listed = tables.pop("manifest").where("table <> 'checks'").select("table", "rows")
    tables.pop("checks")
    counts = [df.agg(F.count(F.lit(1)).alias("n_rows")).select(F.lit(n).alias("table"), "n_rows") for n, df in tables.items()]
    found = counts[0]
    for one in counts[1:]:
        found = found.unionAll(one)
    return found.join(F.broadcast(listed), "table", "left").selectExpr("table", "n_rows", "n_rows <=> rows AS as_listed")


# ---- sources and logs -------------------------------------------------------------------------


@query(
    "select o_orderkey, o_custkey, o_orderstatus, o_totalprice, strftime(o_orderdate, '%Y-%m-%d') as o_day, "
    "o_orderpriority from orders",
    "orders",
)
def read_delimited(spark):
    """The table written as text with an unusual delimiter, found and typed again."""
    path = new_path(spark, "orders-text")
    table = spark.sql(
        "select o_orderkey, o_custkey, o_orderstatus, o_totalprice, date_format(o_orderdate, 'yyyy-MM-dd') as o_day, "
        "o_orderpriority from orders"
    )
    table.write.option("header", True).option("sep", "|").csv(path)
    return ra.read_delimited(spark, path)


@query("select 'cp1252' as encoding, 0.5::double as confidence, false as has_bom", "conversations")
def detect_encoding(spark):
    """All turns written in a one-byte encoding; a line with a dash of that encoding at its end."""
    path = new_path(spark, "turns-cp1252")
    spark.conf.set("spark.sql.legacy.javaCharsets", "true")
    turns = spark.sql("select conv_id, turn, concat(role, ' – ', conv_id) as note from conversations")
    turns.write.option("header", True).option("encoding", "windows-1252").csv(path)
    return ra.detect_encoding(spark, path)


@query(
    """select job_id, run_type, started_at, duration_s from (select *, row_number() over (partition by job_id
      order by started_at desc) as n from (select cast(user_id as varchar) as job_id, event_type as run_type,
      ts as started_at, value as duration_s from events) e) l where n = 1
    order by started_at desc, job_id limit 50""",
    "events",
)
def latest_runs_of_events(spark):
    """The events read as a run log: the latest entry per id, the newest fifty."""
    log = spark.sql(
        "select cast(user_id as string) as job_id, event_type as run_type, ts as started_at, value as duration_s, "
        "false as deleted from events"
    )
    return latest_runs(log)


@query(
    f"""with {q.classified(*q.ORDERS, rule=both_rules)}
    select cast(o_orderkey as varchar) as o_orderkey, change_type as _change_type, {_CHANGED_TEXTS}
    from j where change_type <> 'unchanged'""",
    "orders",
)
def write_changes(spark):
    """All changed rows written as CSV files and read back as text."""
    path = new_path(spark, "changes")
    ra.write_changes(orders_diff(spark, BOTH), path)
    return ra.read_delimited(spark, path, sep=",", encoding="utf-8", typed=False).drop("_join_rows")


@query(q.counts(*q.ORDERS, rule=both_rules), "orders")
def diff_counts_stored(spark):
    """Counters from the changed rows written once, without running the join again."""
    return orders_diff(spark, BOTH).stored(new_path(spark, "join")).counts()
