"""Star-schema generators: every value is a function of the row id.

Each generator has a form over any table of ids (``*_from_ids``), which scales
with that table, and a form over a range of ``n`` ids.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.scalars import labelled, uniform, uniform_int
from .tables import id_range

# Sizes and shares of the generated model.
STORES = 100
CUSTOMERS = 2_000_000
HOT_SHARE = 0.8
HOT_PROMOTION = 1
OTHER_PROMOTIONS = 999


def store_dim_from_ids(ids: DataFrame, id_col: str = "id") -> DataFrame:
    i = F.col(id_col)
    return ids.select(
        i.cast("bigint").alias("store_id"),
        labelled("Store_", i).alias("store_name"),
        F.when(i % 4 == 0, "North").otherwise("South").alias("region"),
    )


def customer_dim_from_ids(ids: DataFrame, id_col: str = "id") -> DataFrame:
    i = F.col(id_col)
    return ids.select(
        i.cast("bigint").alias("customer_id"),
        labelled("Customer_", i).alias("customer_name"),
        uniform_int(uniform(i, "loyalty"), 100, 0).alias("loyalty_score"),
    )


def _amount(i: Column) -> Column:
    return F.round(uniform(i, "amount") * 100 + 10, 2)


def sales_from_ids(
    ids: DataFrame,
    id_col: str = "id",
    customers: int = CUSTOMERS,
    stores: int = STORES,
    as_of: str = "2024-01-01 00:00:00",
) -> DataFrame:
    """Uniform sales. ``as_of`` replaces the clock, so runs repeat."""
    i = F.col(id_col)
    return ids.select(
        i.cast("bigint").alias("transaction_id"),
        F.lit(as_of).cast("timestamp_ntz").alias("transaction_time"),
        uniform_int(uniform(i, "customer"), customers, 1).alias("customer_id"),
        uniform_int(uniform(i, "store"), stores, 1).alias("store_id"),
        _amount(i).alias("amount"),
    )


def skewed_sales_from_ids(
    ids: DataFrame,
    id_col: str = "id",
    customers: int = CUSTOMERS,
    stores: int = STORES,
    hot_share: float = HOT_SHARE,
    as_of: str = "2024-01-01 00:00:00",
) -> DataFrame:
    """Sales in which one promotion holds ``hot_share`` of the rows."""
    i = F.col("transaction_id")
    other = uniform_int(uniform(i, "promotion"), OTHER_PROMOTIONS, HOT_PROMOTION + 1)
    promotion = F.when(uniform(i, "hot") < hot_share, F.lit(HOT_PROMOTION)).otherwise(other)
    return sales_from_ids(ids, id_col, customers, stores, as_of).select(
        "transaction_id",
        "transaction_time",
        "customer_id",
        "store_id",
        promotion.alias("promotion_id"),
        "amount",
    )


def gen_store_dim(spark: SparkSession, n: int = STORES) -> DataFrame:
    return store_dim_from_ids(id_range(spark, 1, n + 1))


def gen_customer_dim(spark: SparkSession, n: int = CUSTOMERS) -> DataFrame:
    return customer_dim_from_ids(id_range(spark, 1, n + 1))


def gen_sales(
    spark: SparkSession, n: int, customers: int = CUSTOMERS, stores: int = STORES
) -> DataFrame:
    return sales_from_ids(id_range(spark, 1, n + 1), "id", customers, stores)


def gen_sales_skewed(
    spark: SparkSession,
    n: int,
    hot_share: float = HOT_SHARE,
    customers: int = CUSTOMERS,
    stores: int = STORES,
) -> DataFrame:
    return skewed_sales_from_ids(id_range(spark, 1, n + 1), "id", customers, stores, hot_share)
