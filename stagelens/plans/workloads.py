"""Fifteen workloads over the star schema, each of which uses all it computes.

``star`` holds ``sales_fact`` (transaction_id, transaction_time, customer_id,
store_id, promotion_id, amount), ``customer_dim`` and ``store_dim``. Amounts
are summed as decimals, so results do not depend on the order of rows.
"""

from __future__ import annotations

from collections.abc import Callable, Mapping

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.scalars import stable_id
from ..operators import udfs
from ..operators.aggregates import count_where, high_card_agg, sum_count_by
from ..operators.caching import count_slices_cached
from ..operators.joins import (
    broadcast_join,
    cross_join_totals,
    cross_self_join_size,
    join_cardinality_by,
    shuffle_join,
)
from ..operators.ordering import running_sum, shuffle_key, with_position

Star = Mapping[str, DataFrame]
_MONEY = "decimal(18,2)"


def _sales(star: Star) -> DataFrame:
    return star["sales_fact"].withColumn("amount", F.col("amount").cast(_MONEY))


def baseline_scan(star: Star) -> DataFrame:
    """Filter reaching the scan, then a count."""
    return count_where(star["sales_fact"], F.col("amount") > 50)


def skewed_aggregation(star: Star) -> DataFrame:
    """Sum and count per promotion, one of which holds most rows."""
    out = sum_count_by(_sales(star), "promotion_id", "amount")
    return out.withColumn("sum_amount", F.col("sum_amount").cast("double"))


def sort_merge_join(star: Star) -> DataFrame:
    """Fact joined with its large dimension; totals per loyalty score use both sides."""
    joined = shuffle_join(_sales(star), star["customer_dim"], "customer_id")
    return joined.groupBy("loyalty_score").agg(
        F.count(F.lit(1)).alias("n_rows"), F.sum("amount").cast("double").alias("sum_amount")
    )


def broadcast_hash_join(star: Star) -> DataFrame:
    """Fact joined with its small dimension without moving the fact."""
    joined = broadcast_join(_sales(star), star["store_dim"], "store_id")
    return joined.groupBy("region").agg(
        F.count(F.lit(1)).alias("n_rows"), F.sum("amount").cast("double").alias("sum_amount")
    )


def python_function(star: Star) -> DataFrame:
    """Arrow-batched Python function of one column whose result is used."""
    out = star["customer_dim"].withColumn("marked", udfs.mark_text("customer_name"))
    return out.agg(
        F.count("marked").alias("n_rows"),
        F.sum(F.length("marked").cast("bigint")).alias("n_chars"),
        F.max("marked").alias("last_marked"),
    )


def cached_slices(star: Star) -> DataFrame:
    """Two complementary slices, counted from one cached input."""
    hot = F.col("promotion_id") == 1
    return count_slices_cached(
        star["sales_fact"], {"hot": hot, "other": F.col("promotion_id") != 1}
    )


def global_sort(star: Star) -> DataFrame:
    """Every sale with its place in the order of amounts."""
    rows = star["sales_fact"].select("transaction_id", "amount")
    return with_position(rows, ["amount", "transaction_id"])


def cross_join(star: Star) -> DataFrame:
    """Totals over all customer-store pairs."""
    return cross_join_totals(
        star["customer_dim"], star["store_dim"], ["loyalty_score"], ["store_id"]
    )


def explode_rows(star: Star) -> DataFrame:
    """Every sale fanned out two hundred times, summed per store."""
    wide = udfs.explode_range(star["sales_fact"].select("store_id"), 200)
    return wide.groupBy("store_id").agg(
        F.count(F.lit(1)).alias("n_rows"), F.sum(F.col("exploded").cast("bigint")).alias("sum_exploded")
    )


def running_total(star: Star) -> DataFrame:
    """Running sum of amounts over time; sales at one time share the total."""
    rows = _sales(star).select("transaction_id", "transaction_time", "amount")
    out = running_sum(rows, "transaction_time", "amount", out="cumulative_sum")
    return out.select(
        "transaction_id", "transaction_time", F.col("cumulative_sum").cast("double").alias("cumulative_sum")
    )


def random_sort(star: Star) -> DataFrame:
    """All sales in a random but repeatable order, with their place in it."""
    rows = star["sales_fact"].select("transaction_id")
    keyed = rows.withColumn("shuffle_key", shuffle_key(F.col("transaction_id"), "shuffle"))
    return with_position(keyed, ["shuffle_key", "transaction_id"])


def skewed_self_join(star: Star) -> DataFrame:
    """Size of the fact joined with itself on the promotion, per promotion."""
    sales = star["sales_fact"]
    sizes = join_cardinality_by(sales, sales, "promotion_id")
    return sizes.select("promotion_id", F.col("n_rows").cast("bigint").alias("n_rows"))


def high_cardinality(star: Star) -> DataFrame:
    """Groups that are nearly all unique, then totals over the group results."""
    salted = star["sales_fact"].withColumn("tag", stable_id(F.col("transaction_id"), "tag"))
    groups = high_card_agg(salted, ["transaction_id", "tag"], "amount")
    return groups.agg(
        F.count(F.lit(1)).alias("n_groups"),
        F.sum(F.col("max_amount").cast(_MONEY)).cast("double").alias("sum_max"),
        F.max("avg_amount").alias("max_avg"),
    )


def cartesian_size(star: Star) -> DataFrame:
    """Size of the customers crossed with themselves."""
    out = cross_self_join_size(star["customer_dim"])
    return out.select(F.col("n_pairs").cast("bigint").alias("n_pairs"))


def python_two_columns(star: Star) -> DataFrame:
    """Arrow-batched Python function of two columns whose result is used."""
    out = _sales(star).withColumn("text", udfs.pair_text("transaction_id", "amount"))
    return out.groupBy("store_id").agg(
        F.sum(F.length("text").cast("bigint")).alias("n_chars"), F.max("text").alias("last_text")
    )


WORKLOADS: dict[str, Callable[[Star], DataFrame]] = {
    f.__name__: f
    for f in (
        baseline_scan,
        skewed_aggregation,
        sort_merge_join,
        broadcast_hash_join,
        python_function,
        cached_slices,
        global_sort,
        cross_join,
        explode_rows,
        running_total,
        random_sort,
        skewed_self_join,
        high_cardinality,
        cartesian_size,
        python_two_columns,
    )
}
