"""Fact-and-dimension queries: workloads and the operators they are made of."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import scalars as sc
from ..operators import aggregates as ag
from ..operators import joins as jn
from ..operators import ordering as od
from ..operators import udfs
from ..operators.caching import count_slices
from ..plans import workloads as wl
from ..session import scratch_path
from ..sources import generators as gen
from ..sources import tables as tb
from . import Query
from .views import table_of

_MONEY = "decimal(18,2)"

# Role map: line items are sales, parts are customers, suppliers are stores;
# about five sevenths of the sales fall on promotion 1.
_HOT = "case when l_linenumber <= 5 then 1 else cast(l_partkey % 999 + 2 as int) end"

SALES_SQL = f"""
select l_orderkey * 10 + l_linenumber as transaction_id, l_shipdate as transaction_time,
       l_partkey as customer_id, l_suppkey as store_id, {_HOT} as promotion_id,
       l_extendedprice as amount
from lineitem"""

STAR_CTE = f"""with sales_fact as ({SALES_SQL}),
customer_dim as (select p_partkey as customer_id, p_name as customer_name, p_size as loyalty_score from part),
store_dim as (select s_suppkey as store_id, concat('Store_', cast(s_suppkey as string)) as store_name,
              case when s_suppkey % 4 = 0 then 'North' else 'South' end as region from supplier)
"""


def star(spark: SparkSession, sf: str) -> dict[str, DataFrame]:
    line, part, supplier = (table_of(spark, sf, n) for n in ("lineitem", "part", "supplier"))
    s = F.col("s_suppkey")
    return {
        "sales_fact": line.select(
            (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("transaction_id"),
            F.col("l_shipdate").alias("transaction_time"),
            F.col("l_partkey").alias("customer_id"),
            F.col("l_suppkey").alias("store_id"),
            F.expr(_HOT).alias("promotion_id"),
            F.col("l_extendedprice").alias("amount"),
        ),
        "customer_dim": part.select(
            F.col("p_partkey").alias("customer_id"),
            F.col("p_name").alias("customer_name"),
            F.col("p_size").alias("loyalty_score"),
        ),
        "store_dim": supplier.select(
            s.alias("store_id"),
            sc.labelled("Store_", s).alias("store_name"),
            F.when(s % 4 == 0, "North").otherwise("South").alias("region"),
        ),
    }


def _workload(name: str, body: str) -> Query:
    return Query(lambda spark, sf: wl.WORKLOADS[name](star(spark, sf)), STAR_CTE + body)


def _spread(spark: SparkSession, sf: str, name: str, by: str) -> DataFrame:
    """Test tables come in one small file each; their work is dealt over the cores."""
    return tb.spread(table_of(spark, sf, name), spark.sparkContext.defaultParallelism, by)


_SUM = "cast(sum(cast(amount as decimal(18,2))) as double)"
_AMOUNT = "cast(cast(amount as decimal(18,2)) as string)"

WORKLOADS = {
    "baseline_scan": "select count(*) as n_rows from sales_fact where amount > 50",
    "skewed_aggregation": f"select promotion_id, {_SUM} as sum_amount, count(*) as n_rows "
    "from sales_fact group by promotion_id",
    "sort_merge_join": f"select loyalty_score, count(*) as n_rows, {_SUM} as sum_amount "
    "from sales_fact join customer_dim using (customer_id) group by loyalty_score",
    "broadcast_hash_join": f"select region, count(*) as n_rows, {_SUM} as sum_amount "
    "from sales_fact join store_dim using (store_id) group by region",
    "python_function": "select count(*) as n_rows, cast(sum(length(customer_name) + 1) as bigint) as n_chars, "
    "max(customer_name || 'X') as last_marked from customer_dim",
    "cached_slices": "select case when promotion_id = 1 then 'hot' else 'other' end as slice, "
    "count(*) as n_rows from sales_fact group by 1",
    "global_sort": "select transaction_id, amount, "
    "row_number() over (order by amount, transaction_id) as position from sales_fact",
    "cross_join": "select cast(count(*) as decimal(38,0)) as n_pairs, "
    "cast(sum(cast(loyalty_score as decimal(18,2))) as double) as sum_loyalty_score, "
    "cast(sum(cast(store_id as decimal(18,2))) as double) as sum_store_id from customer_dim, store_dim",
    "explode_rows": "select store_id, count(*) as n_rows, cast(sum(exploded) as bigint) as sum_exploded "
    "from (select store_id, unnest(range(200)) as exploded from sales_fact) group by store_id",
    "running_total": "select transaction_id, transaction_time, cast(sum(cast(amount as decimal(18,2))) "
    "over (order by transaction_time) as double) as cumulative_sum from sales_fact",
    "random_sort": "select transaction_id, shuffle_key, row_number() over (order by shuffle_key, transaction_id) "
    "as position from (select transaction_id, md5(concat(cast(transaction_id as string), ':shuffle')) "
    "as shuffle_key from sales_fact)",
    "skewed_self_join": "select promotion_id, cast(count(*) * count(*) as bigint) as n_rows "
    "from sales_fact group by promotion_id",
    "high_cardinality": "select count(*) as n_groups, cast(sum(cast(m as decimal(18,2))) as double) as sum_max, "
    "max(a) as max_avg from (select max(amount) as m, avg(amount) as a from sales_fact "
    "group by transaction_id, md5(concat(cast(transaction_id as string), ':tag')))",
    "cartesian_size": "select cast((select count(*) from customer_dim) * (select count(*) from customer_dim) "
    "as bigint) as n_pairs",
    "python_two_columns": f"select store_id, cast(sum(length(t)) as bigint) as n_chars, max(t) as last_text "
    f"from (select store_id, repeat(concat('ID:', cast(transaction_id as string), '_AMT:', {_AMOUNT}), 10) as t "
    "from sales_fact) group by store_id",
}

QUERIES: dict[str, Query] = {f"work_{n}": _workload(n, sql) for n, sql in WORKLOADS.items()}


# --- projections and filters ----------------------------------------------------


def _project_cast_case(spark: SparkSession, sf: str) -> DataFrame:
    c = table_of(spark, sf, "customer")
    return c.selectExpr("c_custkey as customer_id", "c_acctbal", "c_nationkey").select(
        "customer_id",
        sc.labelled("Customer_", F.col("customer_id")).alias("customer_name"),
        F.when(F.col("c_nationkey") % 4 == 0, "North").otherwise("South").alias("region"),
        F.round(F.col("c_acctbal"), 1).alias("balance"),
        F.floor(F.col("c_acctbal") / 100).cast("int").alias("hundreds"),
    )


QUERIES["project_cast_case"] = Query(
    _project_cast_case,
    "select c_custkey as customer_id, concat('Customer_', cast(c_custkey as string)) as customer_name, "
    "case when c_nationkey % 4 = 0 then 'North' else 'South' end as region, round(c_acctbal, 1) as balance, "
    "cast(floor(c_acctbal / 100) as int) as hundreds from customer",
)


def _filter_eq_ne(spark: SparkSession, sf: str) -> DataFrame:
    hot = F.col("promotion_id") == 1
    slices = {"eq": hot, "ne": F.col("promotion_id") != 1, "gt": F.col("amount") > 50}
    return count_slices(star(spark, sf)["sales_fact"], slices)


QUERIES["filter_eq_ne"] = Query(
    _filter_eq_ne,
    STAR_CTE + "select 'eq' as slice, count(*) as n_rows from sales_fact where promotion_id = 1 "
    "union all select 'ne', count(*) from sales_fact where promotion_id <> 1 "
    "union all select 'gt', count(*) from sales_fact where amount > 50",
)


# --- aggregation and joins under skew ---------------------------------------------


QUERIES["skew_profile"] = Query(
    lambda spark, sf: ag.skew_profile(star(spark, sf)["sales_fact"], "promotion_id"),
    STAR_CTE + "select count(*) as n_keys, cast(sum(n) as bigint) as n_rows, max(n) as max_rows, "
    "arg_max(promotion_id, n) as top_key, cast(median(n) as double) as median_rows, "
    "cast(max(n) as double) / cast(sum(n) as double) as top_share, "
    "cast(max(n) as double) / median(n) as max_over_median "
    "from (select promotion_id, count(*) as n from sales_fact group by promotion_id)",
)


def _salted_agg(spark: SparkSession, sf: str) -> DataFrame:
    aggs = {
        "sum_amount": ("sum", "amount"),
        "n_rows": ("count", "amount"),
        "min_amount": ("min", "amount"),
        "max_amount": ("max", "amount"),
        "n_customers": ("count_distinct", "customer_id"),
    }
    sales = star(spark, sf)["sales_fact"].withColumn("amount", F.col("amount").cast(_MONEY))
    out = ag.salted_agg(sales, ["promotion_id"], aggs, ["transaction_id"])
    money = ["sum_amount", "min_amount", "max_amount"]
    return out.withColumns({c: F.col(c).cast("double") for c in money})


QUERIES["salted_agg"] = Query(
    _salted_agg,
    STAR_CTE + f"select promotion_id, {_SUM} as sum_amount, count(amount) as n_rows, min(amount) as min_amount, "
    "max(amount) as max_amount, count(distinct customer_id) as n_customers from sales_fact group by promotion_id",
)


def _median_by_hot_key(spark: SparkSession, sf: str) -> DataFrame:
    cents = F.round(F.col("amount") * 100).cast("bigint").alias("cents")
    sales = star(spark, sf)["sales_fact"].select("promotion_id", cents)
    return ag.upper_median(sales, ["promotion_id"], "cents", "median_cents")


QUERIES["median_by_hot_key"] = Query(
    _median_by_hot_key,
    STAR_CTE + "select promotion_id, cents as median_cents from (select promotion_id, cents, "
    "row_number() over (partition by promotion_id order by cents) as rn, "
    "count(*) over (partition by promotion_id) as n from (select promotion_id, "
    "cast(round(amount * 100) as bigint) as cents from sales_fact)) where rn = n // 2 + 1",
)


def _promotions(sales: DataFrame) -> DataFrame:
    """Promotion dimension: one row per promotion that occurs."""
    return sales.groupBy("promotion_id").agg(
        F.min("transaction_time").alias("first_time"), F.count(F.lit(1)).alias("uses")
    )


def _join_skew_salted(spark: SparkSession, sf: str) -> DataFrame:
    sales = star(spark, sf)["sales_fact"]
    joined = jn.skew_join(
        sales, _promotions(sales), "promotion_id", salt_by=["transaction_id", "amount"]
    )
    return joined.groupBy("store_id").agg(
        F.count(F.lit(1)).alias("n_rows"),
        F.sum("uses").alias("sum_uses"),
        F.min("first_time").alias("first_time"),
    )


QUERIES["join_skew_salted"] = Query(
    _join_skew_salted,
    STAR_CTE + "select store_id, count(*) as n_rows, cast(sum(uses) as bigint) as sum_uses, "
    "min(first_time) as first_time from sales_fact join (select promotion_id, min(transaction_time) as first_time, "
    "count(*) as uses from sales_fact group by promotion_id) using (promotion_id) group by store_id",
)


def _join_skew_both(spark: SparkSession, sf: str) -> DataFrame:
    """Sales joined with the months their promotion sold in, of all sales; the hot promotion has most of both."""
    sales = star(spark, sf)["sales_fact"].select("promotion_id", "store_id", "transaction_time")
    month = F.date_trunc("month", "transaction_time").alias("month")
    months = sales.groupBy("promotion_id", month).agg(F.count(F.lit(1)).alias("sold"))
    joined = jn.skew_join(sales, months, "promotion_id")
    return joined.groupBy("store_id").agg(F.count(F.lit(1)).alias("n_rows"), F.sum("sold").cast("bigint").alias("sum_sold"))


QUERIES["join_skew_both"] = Query(
    _join_skew_both,
    STAR_CTE + "select store_id, cast(sum(n) as bigint) as n_rows, cast(sum(s) as bigint) as sum_sold from sales_fact join "
    "(select promotion_id, count(distinct date_trunc('month', transaction_time)) as n, count(*) as s from sales_fact "
    "group by promotion_id) using (promotion_id) group by store_id",
)

QUERIES["random_ids"] = Query(
    lambda spark, sf: table_of(spark, sf, "orders").select(sc.random_id().alias("id")).agg(
        F.count("id").alias("n_rows"), F.countDistinct("id").alias("n_ids")
    ),
    "select count(*) as n_rows, count(*) as n_ids from orders",
)


def _join_cardinality(spark: SparkSession, sf: str) -> DataFrame:
    left = table_of(spark, sf, "lineitem").select(F.col("l_suppkey").alias("k"))
    size = jn.join_cardinality(left, left, "k")
    return size.select(F.col("n_rows").cast("bigint").alias("n_rows"))


QUERIES["join_cardinality"] = Query(
    _join_cardinality,
    "select cast(sum(n * n) as bigint) as n_rows from "
    "(select l_suppkey, count(*) as n from lineitem group by l_suppkey)",
)


# --- order ---------------------------------------------------------------------------


def _running_sum_by(spark: SparkSession, sf: str) -> DataFrame:
    sales = star(spark, sf)["sales_fact"].select(
        "transaction_id", "promotion_id", "transaction_time", F.col("amount").cast(_MONEY).alias("amount")
    )
    out = od.running_sum(sales, "transaction_time", "amount", by=["promotion_id"])
    return out.drop("amount").withColumn("running_sum", F.col("running_sum").cast("double"))


QUERIES["running_sum_by"] = Query(
    _running_sum_by,
    STAR_CTE + "select transaction_id, promotion_id, transaction_time, "
    "cast(sum(cast(amount as decimal(18,2))) over (partition by promotion_id order by transaction_time) as double) "
    "as running_sum from sales_fact",
)

QUERIES["take_first"] = Query(
    lambda spark, sf: od.take_first(
        star(spark, sf)["sales_fact"].select("transaction_id", "store_id", "amount"),
        [F.desc("amount"), "transaction_id", "store_id"],
        1000,
    ),
    STAR_CTE + "select transaction_id, store_id, amount from sales_fact "
    "order by amount desc, transaction_id, store_id limit 1000",
)

QUERIES["top_per_hot_key"] = Query(
    lambda spark, sf: od.top_per_group(
        star(spark, sf)["sales_fact"].select("promotion_id", "transaction_id", "amount"),
        ["promotion_id"],
        [F.desc("amount"), F.col("transaction_id")],
        5,
    ),
    STAR_CTE + "select * from (select promotion_id, transaction_id, amount, cast(row_number() over "
    "(partition by promotion_id order by amount desc, transaction_id) as int) as rank from sales_fact) "
    "where rank <= 5",
)


# --- Python functions and their rewrites ------------------------------------------------

_MARK_SQL = "select c_custkey, concat(cast(c_name as string), 'X') as marked from customer"

QUERIES["udf_python"] = Query(
    lambda spark, sf: _spread(spark, sf, "customer", "c_custkey").select(
        "c_custkey", udfs.mark_text("c_name").alias("marked")
    ),
    _MARK_SQL,
)
QUERIES["udf_builtin_rewrite"] = Query(
    lambda spark, sf: _spread(spark, sf, "customer", "c_custkey").select(
        "c_custkey", udfs.mark_text_builtin(F.col("c_name")).alias("marked")
    ),
    _MARK_SQL,
)

_PAIR_SQL = (
    "select o_orderkey, repeat(concat('ID:', cast(o_orderkey as string), '_AMT:', "
    "cast(cast(o_totalprice as decimal(18,2)) as string)), 10) as text from orders"
)
QUERIES["udf_two_columns"] = Query(
    lambda spark, sf: _spread(spark, sf, "orders", "o_orderkey").select(
        "o_orderkey",
        udfs.pair_text("o_orderkey", F.col("o_totalprice").cast(_MONEY)).alias("text"),
    ),
    _PAIR_SQL,
)
QUERIES["udf_two_columns_rewrite"] = Query(
    lambda spark, sf: _spread(spark, sf, "orders", "o_orderkey").select(
        "o_orderkey",
        udfs.pair_text_builtin(F.col("o_orderkey"), F.col("o_totalprice").cast(_MONEY)).alias("text"),
    ),
    _PAIR_SQL,
)


# --- sinks -----------------------------------------------------------------------------


def _table_roundtrip(spark: SparkSession, sf: str) -> DataFrame:
    path = scratch_path(spark, "table")
    tb.write_table(tb.repartition_for_write(table_of(spark, sf, "orders")), path)
    return tb.read_table(spark, path)


QUERIES["table_roundtrip"] = Query(_table_roundtrip, "select * from orders")


def _partitioned_roundtrip(spark: SparkSession, sf: str) -> DataFrame:
    path = scratch_path(spark, "partitioned")
    tb.write_table(table_of(spark, sf, "orders"), path, ["o_orderstatus"])
    return tb.read_table(spark, path)


QUERIES["partitioned_roundtrip"] = Query(_partitioned_roundtrip, "select * from orders")


def _csv_roundtrip(spark: SparkSession, sf: str) -> DataFrame:
    path = scratch_path(spark, "csv")
    customers = table_of(spark, sf, "customer")
    tb.write_csv(customers, path)
    return tb.read_csv(spark, path, customers.schema)


QUERIES["csv_roundtrip"] = Query(_csv_roundtrip, "select * from customer")


def _noop_sink(spark: SparkSession, sf: str) -> DataFrame:
    sales = star(spark, sf)["sales_fact"]
    tb.materialize(od.shuffle_rows(sales, 7))
    tb.materialize(od.global_sort(sales, "amount"))
    return tb.count_rows(sales)


QUERIES["noop_sink"] = Query(_noop_sink, "select count(*) as n_rows from lineitem")


def _ad_hoc_sql(spark: SparkSession, sf: str) -> DataFrame:
    tb.register_views(spark, {f"adhoc_{n}": df for n, df in star(spark, sf).items()})
    return spark.sql(
        "select region, count(*) as n_rows from adhoc_sales_fact join adhoc_store_dim using (store_id) "
        "where amount > 50 group by region"
    )


QUERIES["ad_hoc_sql"] = Query(
    _ad_hoc_sql,
    STAR_CTE + "select region, count(*) as n_rows from sales_fact join store_dim using (store_id) "
    "where amount > 50 group by region",
)


# --- generators over the ids of the tables -----------------------------------------------


def _u(salt: str, i: str = "id") -> str:
    digest = f"md5(concat(cast({i} as string), ':{salt}'))"
    return f"(cast(concat('0x', substr({digest}, 1, 8)) as bigint) / 4294967296.0::double)"


def _int(salt: str, width: int, low: int) -> str:
    return f"(cast(floor({_u(salt)} * {width}) as int) + {low})"


_SALE_COLS = (
    "id as transaction_id, timestamp '2024-01-01 00:00:00' as transaction_time, "
    f"{_int('customer', gen.CUSTOMERS, 1)} as customer_id, {_int('store', gen.STORES, 1)} as store_id, "
)
_AMOUNT_SQL = f"round({_u('amount')} * 100 + 10, 2) as amount"

QUERIES["gen_store"] = Query(
    lambda spark, sf: gen.store_dim_from_ids(table_of(spark, sf, "supplier"), "s_suppkey"),
    "select s_suppkey as store_id, concat('Store_', cast(s_suppkey as string)) as store_name, "
    "case when s_suppkey % 4 = 0 then 'North' else 'South' end as region from supplier",
)
QUERIES["gen_customer"] = Query(
    lambda spark, sf: gen.customer_dim_from_ids(table_of(spark, sf, "customer"), "c_custkey"),
    "select id as customer_id, concat('Customer_', cast(id as string)) as customer_name, "
    f"{_int('loyalty', 100, 0)} as loyalty_score from (select c_custkey as id from customer)",
)
QUERIES["gen_sales"] = Query(
    lambda spark, sf: gen.sales_from_ids(table_of(spark, sf, "orders"), "o_orderkey"),
    f"select {_SALE_COLS} {_AMOUNT_SQL} from (select o_orderkey as id from orders)",
)
QUERIES["gen_sales_skewed"] = Query(
    lambda spark, sf: gen.skewed_sales_from_ids(table_of(spark, sf, "orders"), "o_orderkey"),
    f"select {_SALE_COLS} case when {_u('hot')} < {gen.HOT_SHARE} then 1 else "
    f"{_int('promotion', gen.OTHER_PROMOTIONS, 2)} end as promotion_id, {_AMOUNT_SQL} "
    "from (select o_orderkey as id from orders)",
)
