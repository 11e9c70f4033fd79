"""Python functions over columns, each beside its built-in rewrite."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType


@F.pandas_udf(StringType())
def mark_text(values: pd.Series) -> pd.Series:
    """Arrow-batched Python function of one column."""
    return values.map(str) + "X"


def mark_text_builtin(value: Column) -> Column:
    """``mark_text`` without leaving the JVM."""
    return F.concat(F.coalesce(value.cast("string"), F.lit("None")), F.lit("X"))


@F.pandas_udf(StringType())
def pair_text(ids: pd.Series, amounts: pd.Series) -> pd.Series:
    """Arrow-batched Python function of two columns."""
    return ("ID:" + ids.astype(str) + "_AMT:" + amounts.astype(str)).str.repeat(10)


def pair_text_builtin(id_col: Column, amount: Column) -> Column:
    """``pair_text`` without leaving the JVM."""
    text = F.concat(
        F.lit("ID:"), id_col.cast("string"), F.lit("_AMT:"), amount.cast("string")
    )
    return F.repeat(text, F.lit(10))


def explode_range(df, n: int, out: str = "exploded"):
    """Every row repeated ``n`` times, numbered from 0."""
    return df.withColumn(out, F.explode(F.sequence(F.lit(0), F.lit(n - 1))))
