"""A second snapshot for each table, derived from the first by SQL that both engines run.

The given tables hold one snapshot. Each recipe changes rows by conditions on their own
values: some rows go, some come, some change in meaning, some in formatting only.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels "
    "conversations"
).split()

ORDERS_2 = """
select o_orderkey, o_custkey,
       case when o_orderpriority = '1-URGENT' then lower(o_orderstatus) else o_orderstatus end as o_orderstatus,
       case when o_totalprice > 480000 then null
            when o_totalprice between 100000 and 140000 then o_totalprice + 1.0
            else o_totalprice end as o_totalprice,
       o_orderdate,
       case when o_orderstatus = 'P' then concat('  ', o_orderpriority, ' ') else o_orderpriority end as o_orderpriority
from orders where o_totalprice >= 8000
union all
select -1 - o_orderkey, o_custkey, o_orderstatus, o_totalprice, o_orderdate, o_orderpriority
from orders where o_totalprice between 200000 and 206000
"""

# Other names in table 2, keys included.
ORDERS_RENAMED = f"""
select o_orderkey as order_id, o_custkey, o_orderstatus as status, o_totalprice as price, o_orderdate,
       o_orderpriority from ({ORDERS_2}) s
"""

# A whole-number column that became a float.
ORDERS_DRIFTED = f"""
select o_orderkey, cast(o_custkey as double) as o_custkey, o_orderstatus, o_totalprice, o_orderdate,
       o_orderpriority from ({ORDERS_2}) s
"""

# Dates as text: ISO in table 1, month first in part of table 2.
ORDERS_DATES = "select o_orderkey, {iso} as day from orders"
ORDERS_DATES_2 = (
    "select o_orderkey, case when o_orderstatus = 'F' then {us} "
    "when o_orderstatus = 'P' and o_totalprice > 400000 then '31/31/1999' else {iso} end as day from orders"
)
SPARK_DATES = {"iso": "date_format(o_orderdate, 'yyyy-MM-dd')", "us": "date_format(o_orderdate, 'MM/dd/yyyy')"}
DUCK_DATES = {"iso": "strftime(o_orderdate, '%Y-%m-%d')", "us": "strftime(o_orderdate, '%m/%d/%Y')"}

# Keys that went missing in part of the rows, differently on either side.
ORDERS_NULL_KEYS_1 = """
select case when o_totalprice > 470000 then null else o_orderkey end as o_orderkey, o_custkey, o_orderstatus from orders
"""
ORDERS_NULL_KEYS_2 = """
select case when o_totalprice < 15000 then null else o_orderkey end as o_orderkey, o_custkey, o_orderstatus from orders
"""

# All four kinds of missing values.
CUSTOMER_DIRTY = """
select c_custkey, c_name, c_nationkey, c_acctbal,
       case when c_nationkey = 3 then null when c_nationkey = 5 then '' when c_nationkey = 7 then '   '
            when c_nationkey = 9 then 'N/A' when c_nationkey = 11 then 'unknown' else c_mktsegment end as c_mktsegment,
       case when c_nationkey in (2, 4) then cast(c_nationkey as varchar(10))
            when c_nationkey = 6 then 'x6' when c_nationkey = 8 then null
            else cast(c_nationkey * 100 as varchar(10)) end as c_code
from customer
"""

# Blank in table 1 against null in table 2, and the other way round.
CUSTOMER_BLANK_1 = """
select c_custkey, case when c_nationkey = 1 then '' when c_nationkey = 2 then '  '
                       when c_nationkey = 4 then null else c_mktsegment end as c_mktsegment from customer
"""
CUSTOMER_BLANK_2 = """
select c_custkey, case when c_nationkey in (1, 2, 3) then null when c_nationkey = 4 then '' else c_mktsegment end
       as c_mktsegment from customer
"""

# Lines of some orders dropped, quantities of others raised.
LINEITEM_2 = """
select l_orderkey, l_partkey, l_suppkey, l_linenumber,
       case when l_shipdate < timestamp '1995-03-01 00:00:00' then l_quantity + 1 else l_quantity end as l_quantity,
       l_extendedprice,
       case when l_discount = 0.05 then null else l_discount end as l_discount, l_tax,
       case when l_linenumber = 1 then lower(l_returnflag) else l_returnflag end as l_returnflag, l_linestatus,
       l_shipdate
from lineitem where not (l_linenumber = 7 and l_quantity > 40)
"""

PART_2 = """
select p_partkey, upper(p_name) as p_name, case when p_size > 45 then 'Brand#99' else p_brand end as p_brand,
       p_type, p_size, p_retailprice from part where p_size <> 10
"""

# Tables as a text file would hold them: every value a text, with some that spoil a type.
ORDERS_TEXT = """
select cast(o_orderkey as varchar(20)) as order_id,
       case when o_totalprice > 495000 then 'n/a' else cast(o_custkey as varchar(20)) end as customer,
       o_orderstatus as status, {iso} as day,
       case when o_orderpriority = '1-URGENT' then 'true' else 'FALSE' end as urgent,
       cast(cast(o_totalprice as decimal(12,2)) as varchar(20)) as price
from orders
"""
ORDERS_TEXT_2 = """
select cast(o_orderkey as varchar(20)) as order_id, cast(o_custkey as varchar(20)) as customer,
       case when o_orderstatus = 'F' then {us} else {iso} end as day,
       o_orderstatus as state, cast(cast(o_totalprice as decimal(12,2)) as varchar(20)) as price
from orders
"""


def load(spark: SparkSession, folder: str, *names: str) -> None:
    """Register tables as views, as the SQL recipes expect them."""
    for name in names or TABLES:
        spark.read.parquet(f"{folder}/{name}.parquet").createOrReplaceTempView(name)


def snapshot(spark: SparkSession, sql: str) -> DataFrame:
    return spark.sql(sql)
