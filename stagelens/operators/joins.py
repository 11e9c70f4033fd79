"""Joins: strategy hints, skew-safe joins, and join sizes without joining."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# A key is hot when it holds more than 1/HOT_SHARES of the left rows, so there
# can never be more than HOT_SHARES hot keys: the table of hot keys is safe to
# broadcast whatever the data looks like.
HOT_SHARES = 256

# Largest table broadcast_join sends to every executor.
BROADCAST_ROWS = 100_000
BROADCAST_BYTES = 64 * 1024 * 1024


def _keys(on: str | Sequence[str]) -> list[str]:
    return [on] if isinstance(on, str) else list(on)


def shuffle_join(left: DataFrame, right: DataFrame, on: str | Sequence[str]) -> DataFrame:
    """Equi inner join of two large sides by sort-merge.

    The hint keeps the strategy stable; AQE still splits oversized partitions.
    """
    return left.join(right.hint("merge"), _keys(on))


def fits_broadcast(
    small: DataFrame, max_rows: int = BROADCAST_ROWS, max_bytes: int = BROADCAST_BYTES
) -> bool:
    """Rows and bytes of ``small`` checked against the bounds.

    Reads at most one row more than allowed; bytes are those of the row as text.
    """
    row = F.octet_length(F.to_json(F.struct(*[F.col(c) for c in small.columns])))
    checked = small.limit(max_rows + 1).agg(
        F.count(F.lit(1)).alias("n"), F.coalesce(F.sum(row), F.lit(0)).alias("size")
    )
    n, size = checked.first()
    return n <= max_rows and size <= max_bytes


def broadcast_join(
    left: DataFrame, small: DataFrame, on: str | Sequence[str], max_rows: int = BROADCAST_ROWS
) -> DataFrame:
    """Equi inner join with a small dimension: no shuffle of the large side.

    The dimension is measured first; beyond ``max_rows`` (or a fixed number of
    bytes) both sides move, hot keys split.
    """
    if fits_broadcast(small, max_rows):
        return left.join(F.broadcast(small), _keys(on))
    return skew_join(left, small, on)


def cross_join_totals(
    left: DataFrame, right: DataFrame, left_sums: Sequence[str] = (), right_sums: Sequence[str] = ()
) -> DataFrame:
    """Totals over all pairs of two tables, without forming a pair.

    Returns one row: ``n_pairs`` and, per listed column, its sum over all
    pairs, which is the column's own sum times the row count of the other side.
    Both sides are reduced by partial aggregation before anything is shuffled.
    """
    big = "decimal(38,0)"

    def side(df: DataFrame, tag: str, cols: Sequence[str]) -> DataFrame:
        return df.agg(
            F.lit(tag).alias("side"),
            F.count(F.lit(1)).cast(big).alias("n"),
            F.map_from_arrays(
                F.array(*[F.lit(c) for c in cols]).cast("array<string>"),
                F.array(*[F.sum(F.col(c).cast("decimal(18,2)")) for c in cols]).cast(
                    "array<decimal(28,2)>"
                ),
            ).alias("sums"),
        )

    both = side(left, "l", left_sums).unionByName(side(right, "r", right_sums))

    def of(tag: str, col: Column) -> Column:
        return F.max(F.when(F.col("side") == tag, col))

    n_left, n_right = of("l", F.col("n")), of("r", F.col("n"))
    out = [(n_left * n_right).cast(big).alias("n_pairs")]
    out += [(of("l", F.col("sums")[c]) * n_right).cast("double").alias(f"sum_{c}") for c in left_sums]
    out += [(of("r", F.col("sums")[c]) * n_left).cast("double").alias(f"sum_{c}") for c in right_sums]
    return both.agg(*out)


def cross_self_join_size(df: DataFrame) -> DataFrame:
    """Row count of a table crossed with itself."""
    n = F.count(F.lit(1)).cast("decimal(19,0)")
    return df.agg((n * n).cast("decimal(38,0)").alias("n_pairs"))


def rename_shared(df: DataFrame, suffix: str) -> DataFrame:
    """Every column renamed, so that a self-join has no ambiguous names."""
    return df.withColumnsRenamed({c: c + suffix for c in df.columns})


def join_cardinality(left: DataFrame, right: DataFrame, on: str | Sequence[str]) -> DataFrame:
    """Exact row count of an equi join, computed from per-key counts."""
    return join_cardinality_by(left, right, on).agg(
        F.coalesce(F.sum("n_rows"), F.lit(0)).cast("decimal(38,0)").alias("n_rows")
    )


def join_cardinality_by(left: DataFrame, right: DataFrame, on: str | Sequence[str]) -> DataFrame:
    """Per key: how many rows each side holds and how many the join would return."""
    keys = _keys(on)
    n_left = left.groupBy(*keys).agg(F.count(F.lit(1)).alias("n_left"))
    n_right = right.groupBy(*keys).agg(F.count(F.lit(1)).alias("n_right"))
    size = F.col("n_left").cast("decimal(19,0)") * F.col("n_right").cast("decimal(19,0)")
    return n_left.join(n_right, keys).withColumn("n_rows", size.cast("decimal(38,0)"))


def _hot_keys(counts: DataFrame, keys: list[str], shares: int, tag: str) -> DataFrame:
    """Keys with more than 1/``shares`` of the rows, and how many shares each one fills.

    One pass: the grand total comes with the per-key counts, and of those only
    the largest are looked at, as no more than ``shares`` keys can be hot.
    """
    level = F.grouping_id()
    rolled = counts.rollup(*keys).agg(F.sum("n").alias("n"), level.alias("_level"))
    whole = (1 << len(keys)) - 1
    top = rolled.filter(F.col("_level").isin(0, whole)).orderBy(F.desc("_level"), F.desc("n")).limit(shares + 1).collect()
    total = top[0]["n"] if top and top[0]["_level"] == whole else 0
    hot = [tuple(r[k] for k in keys) + (-(-r["n"] * shares // total),) for r in top[1:] if r["n"] * shares > total]
    types = {f.name: f.dataType.simpleString() for f in counts.schema.fields}
    schema = ", ".join([f"`_hot_{k}` {types[k]}" for k in keys] + [f"{tag} int"])
    return counts.sparkSession.createDataFrame(hot, schema)


def skew_join(
    left: DataFrame,
    right: DataFrame,
    on: str | Sequence[str],
    how: str = "inner",
    counts: DataFrame | None = None,
    salt_by: Sequence[str] | None = None,
    shares: int = HOT_SHARES,
) -> DataFrame:
    """Equi join whose sides may hold most of their rows under a few keys.

    Rows of a key that is hot on a side are spread over as many salts as the key
    has shares of that side; the other side's rows of that key are repeated once
    per salt. A key hot on both sides makes a grid of both salts, each left row
    meeting each right row in one cell. Other keys keep one salt, so nothing
    else is repeated. ``how`` is ``inner`` or ``left``; a left join also matches
    the null key, as a lookup of per-key results needs, and splits the left side only.

    The salt hashes the row and the input partition it came from: a row keeps its
    salt when a task is run again, and exact copies still spread as far as their
    input partitions do.

    counts   rows per key of ``left`` (key columns and ``n``) if already known
    salt_by  left columns that tell rows of one key apart (default: all others)
    """
    if how not in ("inner", "left"):
        raise ValueError("how must be inner or left")
    keys = _keys(on)
    one = F.lit(1).cast("bigint").alias("n")
    hot_left = _hot_keys(left.select(*keys, one) if counts is None else counts, keys, shares, "_left")
    hot_right = _hot_keys(right.select(*keys, one), keys, shares, "_right") if how == "inner" else None

    def with_salts(df: DataFrame, hot: DataFrame | None, out: str) -> DataFrame:
        if hot is None:
            return df.withColumn(out, F.lit(1))
        cond = reduce(lambda a, b: a & b, [F.col(k).eqNullSafe(F.col(f"_hot_{k}")) for k in keys])
        # at most ``shares`` rows
        found = df.join(F.broadcast(hot), cond, "left").drop(*[f"_hot_{k}" for k in keys])
        return found.withColumn(out, F.coalesce(out, F.lit(1)))

    def spread(df: DataFrame, by: Sequence[str], own: str, other: str) -> DataFrame:
        salted = with_salts(with_salts(df, hot_left, "_left"), hot_right, "_right")
        place = F.pmod(F.xxhash64(*by, F.spark_partition_id()), F.col(own)).cast("int")
        every = F.explode(F.sequence(F.lit(0), F.col(other) - 1))
        return salted.withColumn(f"{own}_salt", place).withColumn(f"{other}_salt", every).drop("_left", "_right")

    spread_left = spread(left, list(salt_by or [c for c in left.columns if c not in keys] or keys), "_left", "_right")
    spread_right = rename_shared(spread(right, [c for c in right.columns if c not in keys] or keys, "_right", "_left"), "__r")
    cond = (F.col("_left_salt") == F.col("_left_salt__r")) & (F.col("_right_salt") == F.col("_right_salt__r"))
    for k in keys:
        r = F.col(f"{k}__r")
        cond = cond & (F.col(k).eqNullSafe(r) if how == "left" else F.col(k) == r)
    joined = spread_left.join(spread_right, cond, how)
    payload = [c for c in right.columns if c not in keys]
    return joined.select(
        *[F.col(c) for c in left.columns], *[F.col(f"{c}__r").alias(c) for c in payload]
    )
