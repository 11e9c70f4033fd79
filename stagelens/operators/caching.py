"""Reuse of an intermediate result, always released."""

from __future__ import annotations

from collections.abc import Iterator, Mapping
from contextlib import contextmanager
from functools import reduce

from pyspark import StorageLevel
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


@contextmanager
def cached(df: DataFrame) -> Iterator[DataFrame]:
    """Keep ``df`` in memory, spilling to disk, for the length of the block."""
    df.persist(StorageLevel.MEMORY_AND_DISK)
    try:
        yield df
    finally:
        df.unpersist()


def count_slices_cached(df: DataFrame, slices: Mapping[str, Column]) -> DataFrame:
    """Row count per named slice; the input is read once, kept, and each slice counted from it."""
    with cached(df) as kept:
        counts = [
            kept.filter(predicate).agg(F.count(F.lit(1)).alias("n_rows")).select(F.lit(name).alias("slice"), "n_rows")
            for name, predicate in slices.items()
        ]
        # one row for each slice
        rows = reduce(DataFrame.unionByName, counts).collect()
    return df.sparkSession.createDataFrame(rows, "slice string, n_rows bigint")


def count_slices(df: DataFrame, slices: Mapping[str, Column]) -> DataFrame:
    """The same counts in one pass and without a cache."""
    counted = df.agg(*[F.count_if(p).alias(name) for name, p in slices.items()])
    return counted.unpivot([], list(slices), "slice", "n_rows")
