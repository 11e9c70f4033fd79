"""Aggregations: combinable by construction, exact order statistics included."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources.tables import stored

# Bits of a digit of the radix selection: the sums of a group that one level puts in order are at most 2 ** DIGIT_BITS.
DIGIT_BITS = 12


def count_where(df: DataFrame, predicate: Column) -> DataFrame:
    """Rows that satisfy a predicate; the filter reaches the scan."""
    return df.filter(predicate).agg(F.count(F.lit(1)).alias("n_rows"))


def sum_count_by(df: DataFrame, key: str, value: str) -> DataFrame:
    """Sum and row count per key.

    Partial aggregation leaves one row per key and map task, so a key with most
    of the rows costs the reducer no more than any other.
    """
    return df.groupBy(key).agg(
        F.sum(value).alias(f"sum_{value}"), F.count(F.lit(1)).alias("n_rows")
    )


# kind -> (partial over salted groups, merge of the partials)
_MERGEABLE = {
    "sum": (F.sum, F.sum),
    "count": (F.count, F.sum),
    "min": (F.min, F.min),
    "max": (F.max, F.max),
}


def salted_agg(
    df: DataFrame,
    keys: Sequence[str],
    aggs: Mapping[str, tuple[str, str]],
    salt_by: Sequence[str],
    salts: int = 64,
) -> DataFrame:
    """Two-stage aggregate that spreads each key over ``salts`` groups first.

    For states that map-side combining does not shrink. ``aggs`` maps an output
    name to ``(kind, column)``, kind being sum, count, min, max or
    count_distinct; distinct values are salted by themselves, so each value is
    met in exactly one group and the partial counts add up.
    """
    distinct = {o: c for o, (k, c) in aggs.items() if k == "count_distinct"}
    plain = {o: (k, c) for o, (k, c) in aggs.items() if k != "count_distinct"}
    out = None
    if plain:
        salt = F.pmod(F.xxhash64(*salt_by), F.lit(salts))
        partial = df.groupBy(*keys, salt.alias("_salt")).agg(
            *[_MERGEABLE[k][0](c).alias(o) for o, (k, c) in plain.items()]
        )
        out = partial.groupBy(*keys).agg(
            *[_MERGEABLE[k][1](o).alias(o) for o, (k, _) in plain.items()]
        )
    for name, col in distinct.items():
        salt = F.pmod(F.xxhash64(col), F.lit(salts))
        values = df.groupBy(*keys, salt.alias("_salt"), col).agg(F.lit(1).alias("_seen"))
        partial = values.groupBy(*keys, "_salt").agg(F.count(col).alias(name))
        counted = partial.groupBy(*keys).agg(F.sum(name).alias(name))
        out = counted if out is None else _join_groups(out, counted, keys)
    return out


def _join_groups(left: DataFrame, right: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Two results per group side by side; null is a group like any other."""
    right = right.withColumnsRenamed({k: f"_r_{k}" for k in keys})
    same = F.lit(True)
    for k in keys:
        same = same & F.col(k).eqNullSafe(F.col(f"_r_{k}"))
    return left.join(right, same).drop(*[f"_r_{k}" for k in keys])


def high_card_agg(df: DataFrame, keys: Sequence[str], value: str) -> DataFrame:
    """Average and maximum per (nearly unique) group."""
    return df.groupBy(*keys).agg(
        F.avg(value).alias(f"avg_{value}"), F.max(value).alias(f"max_{value}")
    )


def skew_profile(df: DataFrame, key: str) -> DataFrame:
    """How unevenly rows spread over a key: one row.

    The median is taken over the histogram of group sizes. Group sizes add up
    to the table, so there are at most sqrt(2 * rows) different ones.
    """
    sizes = df.groupBy(key).agg(F.count(F.lit(1)).alias("n"))
    shape = sizes.groupBy("n").agg(
        F.count(F.lit(1)).alias("keys"), F.min(key).alias("smallest_key")
    )
    return shape.agg(
        F.sum("keys").alias("n_keys"),
        F.sum(F.col("n") * F.col("keys")).alias("n_rows"),
        F.max("n").alias("max_rows"),
        F.max_by("smallest_key", "n").alias("top_key"),
        F.percentile("n", 0.5, F.col("keys")).alias("median_rows"),
    ).withColumns(
        {
            "top_share": F.col("max_rows") / F.col("n_rows"),
            "max_over_median": F.col("max_rows") / F.col("median_rows"),
        }
    )


def value_counts(df: DataFrame, keys: Sequence[str], value: str) -> DataFrame:
    """Rows per group and integer value, ``n``; null values are left out. Written once, combined in the map tasks."""
    counted = df.filter(F.col(value).isNotNull()).groupBy(*keys, F.col(value).cast("bigint").alias("_v")).agg(F.count(F.lit(1)).alias("n"))
    return stored(counted, "value-counts")


def select_rank(counts: DataFrame, keys: Sequence[str], rank: Column, digit: int = DIGIT_BITS) -> DataFrame:
    """For each group its smallest and largest value and the one at a 0-based rank: keys, ``lo, mid, hi``.

    ``counts`` is what ``value_counts`` returns, ``rank`` an expression of the
    group's row count ``_n``. Radix selection: values are read as digits of
    ``digit`` bits, from the highest one in which the table's values differ. A
    level sums the counts per prefix, keeps the prefixes below the one chosen
    before and picks the one that holds the rank. So a level joins and orders at
    most ``2 ** digit`` sums of a group, whatever the group's size, how far
    its values reach or how many of them lie close together. Where values take
    more than one level, groups of no more than ``2 ** digit`` of them are put in
    order at once.
    """
    keys = list(keys)
    low, high = counts.agg(F.min("_v"), F.max("_v")).first()
    levels = 0
    while low is not None and digit * levels < 64 and low >> (digit * levels) != high >> (digit * levels):
        levels += 1
    if levels < 2 or not keys:
        return _rank_by_levels(counts, keys, rank, digit, levels, low)
    sizes = counts.groupBy(*keys).agg(F.count(F.lit(1)).alias("_values"))
    wide = stored(sizes.filter(F.col("_values") > 2**digit).select(*[F.col(k).alias(f"_w_{k}") for k in keys]), "wide-groups")
    if wide.isEmpty():
        return _rank_at_once(counts, keys, rank)
    same = reduce(Column.__and__, [F.col(k).eqNullSafe(F.col(f"_w_{k}")) for k in keys], F.lit(True))
    of_wide = _rank_by_levels(counts.join(wide, same, "left_semi"), keys, rank, digit, levels, low)
    return of_wide.unionByName(_rank_at_once(counts.join(wide, same, "left_anti"), keys, rank))


def _rank_at_once(counts: DataFrame, keys: list[str], rank: Column) -> DataFrame:
    """``select_rank`` of groups with few values, in one order of them."""
    ordered = Window.partitionBy(*keys).orderBy("_v")
    whole = ordered.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    upto = F.sum("n").over(ordered.rowsBetween(Window.unboundedPreceding, Window.currentRow))
    found = counts.withColumns(
        {"_n": F.sum("n").over(whole), "lo": F.min("_v").over(whole), "hi": F.max("_v").over(whole), "_upto": upto}
    ).withColumn("_rank", rank.cast("bigint"))
    holds = (F.col("_upto") > F.col("_rank")) & (F.col("_upto") - F.col("n") <= F.col("_rank"))
    return found.filter(holds).select(*keys, "lo", F.col("_v").alias("mid"), "hi")


def _rank_by_levels(counts: DataFrame, keys: list[str], rank: Column, digit: int, levels: int, low: int | None) -> DataFrame:
    """``select_rank`` of any groups, one digit after the other."""
    chosen = counts.groupBy(*keys).agg(F.sum("n").alias("_n"), F.min("_v").alias("lo"), F.max("_v").alias("hi"))
    chosen = chosen.select(*keys, "lo", "hi", rank.cast("bigint").alias("_rank"), F.lit(low).cast("bigint").alias("_prefix"))
    for level in reversed(range(levels)):
        if level:
            sums = counts.groupBy(*keys, F.shiftright("_v", digit * level).alias("_p")).agg(F.sum("n").alias("_pn"))
        else:
            # the counts themselves: summing them once more would only move all of them again
            sums = counts.select(*keys, F.col("_v").alias("_p"), F.col("n").alias("_pn"))
        # groups may share a null key, so keys compare null-safely
        parent = chosen.withColumnsRenamed({k: f"_t_{k}" for k in keys})
        # above the first level all values have the same digits
        same = F.lit(True) if level == levels - 1 else F.shiftright("_p", digit) == F.col("_prefix")
        for k in keys:
            same = same & F.col(k).eqNullSafe(F.col(f"_t_{k}"))
        inside = Window.partitionBy(*keys).orderBy("_p").rowsBetween(Window.unboundedPreceding, Window.currentRow)
        children = sums.join(parent, same).withColumn("_upto", F.sum("_pn").over(inside))
        before = F.col("_upto") - F.col("_pn")
        chosen = children.filter((F.col("_upto") > F.col("_rank")) & (before <= F.col("_rank"))).select(
            *keys, "lo", "hi", (F.col("_rank") - before).alias("_rank"), F.col("_p").alias("_prefix")
        )
    return chosen.select(*keys, "lo", F.col("_prefix").alias("mid"), "hi")


def order_stats(df: DataFrame, keys: Sequence[str], value: str) -> DataFrame:
    """Minimum, upper median and maximum of integer values per group: ``lo, mid, hi``.

    The median is exact: element ``floor(n / 2)`` of the group's sorted values.
    ``df`` is read once, for the counts of its values; the median comes from
    these by radix selection, so no group is gathered and no row is joined.
    """
    kind = df.schema[value].dataType
    found = select_rank(value_counts(df, keys, value), keys, F.floor(F.col("_n") / F.lit(2)))
    return found.select(*keys, *[F.col(c).cast(kind).alias(c) for c in ("lo", "mid", "hi")])


def upper_median(df: DataFrame, keys: Sequence[str], value: str, out: str) -> DataFrame:
    """The middle one of ``order_stats``."""
    return order_stats(df, keys, value).select(*keys, F.col("mid").alias(out))
