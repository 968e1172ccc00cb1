"""``commerce_events``: the nine-column event schema derived from lineitem, orders and part.

The driver tables carry no clickstream, so test and benchmark inputs are mapped from the
TPC-H-like star schema by a fixed, deterministic rule (FIXTURES.md §3). It plants repeated
carts, same-key rows with different prices, buyers without a cart, an out-of-domain event
type, NULL user / session / category / brand / price, mixed-case brands, category depths
2 to 4, all price buckets and three months of Q4 2019. The tables are joined once: a line's events
are exploded from the joined row.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

TABLES = ("lineitem", "orders", "part")

_TEMPLATE = """
with base as (
  select cast(cast(o_custkey*8 + o_orderkey%8 as bigint) as string) as uid,
         cast(o_orderkey as string) as sess,
         cast(l_partkey as string) as pid,
         case when l_partkey%40=0 then 1 else 0 end as direct_buy,
         l_returnflag rf, l_linestatus ls, l_linenumber ln, l_partkey pk, l_suppkey sk,
         timestamp_ntz'2019-10-01 00:00:00'
           + make_dt_interval(datediff(cast(o_orderdate as date), date'1995-01-01') % 92,
                              cast(l_partkey % 23 as int)) as t0,
         p_size, p_partkey, p_type, p_name, p_brand,
         floor(l_extendedprice)/100.0D as price
  from {lineitem} join {orders} on l_orderkey = o_orderkey join {part} on l_partkey = p_partkey),
ev as (select *, explode(array('view', 'cart', 'purchase', 'remove_from_cart')) as et from base),
x as (select *, case et when 'view' then 0 when 'cart' then 10 when 'purchase' then 20 else 15 end as mins,
         explode(sequence(1, case when et = 'cart' and ln >= 6 then cast(ln as int) else 1 end)) as copy
  from ev
  where case et when 'view' then true
                when 'cart' then rf = 'A' and ls = 'F' and sk % 2 = 0
                when 'purchase' then (rf = 'A' and ls = 'F' and sk % 4 = 0) or direct_buy = 1 and ln = 1
                else rf = 'R' and pk % 101 = 0 end)
select t0 + make_dt_interval(0, 0, mins) as event_time,
       et as event_type,
       pid as product_id,
       cast(pk % 500 as string) as category_id,
       case when p_size % 3 = 0 then null
            when p_partkey % 250 = 0 then lower(p_type) || '.' || replace(p_name, ' ', '.') || '.other'
            when p_partkey % 2 = 0 then lower(p_type) || '.' || split_part(p_name, ' ', 2)
            else lower(p_type) || '.' || replace(p_name, ' ', '.') end as category_code,
       case when p_size % 7 = 0 then null when p_partkey % 2 = 1 then upper(p_brand) else p_brand end as brand,
       case when et = 'view' and pk % 211 = 0 then null else price end as price,
       case when sk % 97 = 0 then null else uid end as user_id,
       case when pk % 89 = 0 then null else sess end as user_session
from x
"""


def commerce_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Raw events (canonical nine columns) derived from ``sf_dir``'s parquet tables."""
    read = lambda name: spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")
    return spark.sql(_TEMPLATE, **{t: read(t) for t in TABLES})
