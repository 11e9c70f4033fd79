"""Table sources, sinks and actions."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from ..session import scratch_path


def id_range(spark: SparkSession, start: int, end: int) -> DataFrame:
    """Consecutive ids ``start .. end - 1``."""
    return spark.range(start, end)


def path_exists(spark: SparkSession, path: str) -> bool:
    """Does a file or folder exist on the file system its path names?"""
    target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(target)


def read_csv(spark: SparkSession, path: str, schema: StructType | str) -> DataFrame:
    """CSV with a header and a stated schema."""
    return spark.read.schema(schema).option("header", True).csv(path)


def write_csv(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").option("header", True).csv(path)


def read_table(spark: SparkSession, path: str) -> DataFrame:
    """Columnar table: filters and column lists reach the scan."""
    return spark.read.parquet(path)


def write_table(df: DataFrame, path: str, partition_by: Sequence[str] | None = None) -> None:
    """Replace a columnar table.

    A partitioned write is rebalanced first: one partition value goes to few
    files, but a value with most of the rows is still split over many tasks.
    """
    if partition_by:
        df = df.hint("rebalance", *partition_by)
        df.write.mode("overwrite").partitionBy(*partition_by).parquet(path)
    else:
        df.write.mode("overwrite").parquet(path)


def stored(df: DataFrame, label: str) -> DataFrame:
    """The rows written to the shared folder, for steps that read them more than once."""
    path = scratch_path(df.sparkSession, label)
    write_table(df, path)
    return read_table(df.sparkSession, path)


def spread(scan: DataFrame, tasks: int, *by: str) -> DataFrame:
    """Scan dealt over a stated number of tasks ahead of costly per-row work; ``by`` should be close to unique."""
    return scan.repartition(tasks, *by)


def repartition_for_write(df: DataFrame, n: int | None = None) -> DataFrame:
    """Evenly sized output files whatever the key distribution: ``n`` of them, or as many as the data's size asks for."""
    return df.repartition(n) if n else df.hint("rebalance")


def materialize(df: DataFrame) -> None:
    """Run the whole plan and discard the rows."""
    df.write.format("noop").mode("overwrite").save()


def count_rows(df: DataFrame, out: str = "n_rows") -> DataFrame:
    """Row count as a table.

    A count needs no column, so Catalyst drops sorts, windows and functions
    below it; aggregate over their output where they are to be run.
    """
    return df.agg(F.count(F.lit(1)).alias(out))


def register_views(spark: SparkSession, tables: Mapping[str, DataFrame]) -> None:
    """Make tables available to ``spark.sql`` by name."""
    for name, df in tables.items():
        df.createOrReplaceTempView(name)
