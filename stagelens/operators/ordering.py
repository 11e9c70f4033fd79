"""Order-dependent operators built in parallel: running sums, positions, sorts."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scalars import stable_id
from ..session import scratch_path
from ..sources.tables import read_table, write_table
from .joins import skew_join


def _tie(df: DataFrame) -> Column:
    """Trailing sort key: a hash of the row and of the input partition it came from.

    Cuts a value that fills much of the table into several ranges, exact copies
    included, and stays the same when a task is run again.
    """
    return F.xxhash64(*df.columns, F.spark_partition_id())


def _ranged(df: DataFrame, order: Sequence[Column | str], sort: bool = False) -> DataFrame:
    """Range-partitioned copy with its partition number fixed in ``_part``.

    Range bounds come from a sample, so two runs of the same plan may cut
    differently. The copy is written to the shared folder: every later use sees
    the same cut, also after an executor is lost, and reads only its columns.
    The number of ranges is left to AQE, which sizes them by bytes.
    """
    spark = df.sparkSession
    if sort:
        tied = df.withColumn("_tie", _tie(df))
        out = tied.repartitionByRange(*order, "_tie").sortWithinPartitions(*order, "_tie")
        out = out.drop("_tie").withColumn("_id", F.monotonically_increasing_id())
    else:
        out = df.repartitionByRange(*order)
    path = scratch_path(spark, "ranged")
    write_table(out.withColumn("_part", F.spark_partition_id()), path)
    return read_table(spark, path)


def running_sum(
    df: DataFrame, order: str, value: str, by: Sequence[str] = (), out: str = "running_sum"
) -> DataFrame:
    """Sum of ``value`` up to and including all rows with the same ``order`` value.

    Equals ``sum(value) over (partition by <by> order by <order>)`` with its
    default frame (rows with equal order values share one result), but neither
    a missing nor a hot partition key puts a group into a single task:

    1. rows collapse to one total per (by, order);
    2. totals are cut into ranges of (by, order), whatever the keys are;
    3. a range needs the sum of earlier ranges only for the one key it
       continues, so there are fewer offsets than ranges and they are broadcast;
    4. sums inside the range plus the offset join back to the rows, hot order
       values salted.

    Use a decimal or integer ``value``: double sums depend on their order.
    """
    by = list(by)
    keys = by or ["_all"]
    totals = df.groupBy(*by, order).agg(F.sum(value).alias("_total"), F.count(F.lit(1)).alias("n"))
    if not by:
        totals = totals.withColumn("_all", F.lit(0))
    cut = _ranged(totals, [*by, order])

    per_range = cut.groupBy("_part", *keys).agg(F.sum("_total").alias("_range_total"))
    earlier = (
        Window.partitionBy(*keys).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    )
    offsets = (
        per_range.withColumn("_offset", F.sum("_range_total").over(earlier))
        .filter(F.col("_offset").isNotNull())
        .select(
            F.col("_part").alias("_o_part"),
            *[F.col(k).alias(f"_o_{k}") for k in keys],
            "_offset",
        )
    )
    same = F.col("_part") == F.col("_o_part")
    for k in keys:
        same = same & F.col(k).eqNullSafe(F.col(f"_o_{k}"))
    inside = Window.partitionBy("_part", *keys).orderBy(order)
    inside = inside.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    sums = cut.withColumn("_sum", F.sum("_total").over(inside)).join(
        F.broadcast(offsets), same, "left"
    )
    # a total is null when all its values are; the sum so far stays null only
    # while nothing has been added yet
    running = F.when(F.col("_offset").isNull(), F.col("_sum")).otherwise(
        F.col("_offset") + F.coalesce(F.col("_sum"), F.lit(0))
    )
    sums = sums.select(*by, order, running.alias(out))
    counts = cut.select(*by, order, "n")
    return skew_join(df, sums, [*by, order], how="left", counts=counts)


def with_position(df: DataFrame, order: Sequence[Column | str], out: str = "position") -> DataFrame:
    """1-based position of every row in the given order, without a one-task window.

    ``order`` should end in a tie breaker. Positions come from the place inside
    a sorted range plus the row counts of the ranges before it.
    """
    cut = _ranged(df, order, sort=True)
    sizes = cut.groupBy("_part").agg(
        F.count(F.lit(1)).alias("_n"), F.min("_id").alias("_first")
    )
    # one row per range
    earlier = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    starts = sizes.select(
        "_part", "_first", F.coalesce(F.sum("_n").over(earlier), F.lit(0)).alias("_before")
    )
    position = F.col("_before") + F.col("_id") - F.col("_first") + 1
    return (
        cut.join(F.broadcast(starts), "_part")
        .withColumn(out, position)
        .drop("_part", "_id", "_first", "_before")
    )


def global_sort(df: DataFrame, col: str, ascending: bool = True) -> DataFrame:
    """Total order by value: range exchange plus sort, many partitions.

    Ties are broken by a hash, so a value that fills a third of the table is
    cut into several ranges instead of one.
    """
    key = F.col(col).asc() if ascending else F.col(col).desc()
    return df.withColumn("_tie", _tie(df)).orderBy(key, "_tie").drop("_tie")


def shuffle_rows(df: DataFrame, seed: int) -> DataFrame:
    """Rows in random order."""
    return df.orderBy(F.rand(seed))


def shuffle_key(id_col: Column, seed: str) -> Column:
    """Repeatable random sort key: any engine computes the same order."""
    return stable_id(id_col, seed)


def take_first(df: DataFrame, order: Sequence[Column | str], n: int) -> DataFrame:
    """First ``n`` rows of a stated order (each task keeps only its best ``n``)."""
    return df.orderBy(*order).limit(n)


def top_per_group(
    df: DataFrame, group: Sequence[str], order: Sequence[Column], k: int, out: str = "rank"
) -> DataFrame:
    """Best ``k`` rows per group.

    The rank filter sits directly on the window, so Spark drops all but ``k``
    rows per group in every map task before the shuffle.
    """
    ranked = df.withColumn(out, F.row_number().over(Window.partitionBy(*group).orderBy(*order)))
    return ranked.filter(F.col(out) <= k)
