"""The telemetry store: columnar tables loaded one set of applications at a time.

Layout: ``<out>/<table>/load_id=<name>/…`` and ``<out>/loads/load_id=<name>/…``,
which lists the applications of complete loads and when they were loaded. The
list of a load is written last and readers join it, so they see whole
applications or nothing, and loading an application again replaces it in one
step: the latest load counts. Every writer names its loads for itself, a batch
load by a random name, a stream by its own id and the batch number, so no
writer ever touches another one's folders; a load that is repeated under its
name overwrites its own.

Files follow the size of the data, not the number of applications: rows are
clustered by application inside a load, so a filter on ``app_id`` skips row
groups by their bounds.
"""

from __future__ import annotations

import time
import uuid
from collections.abc import Mapping

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.tables import path_exists
from .telemetry import LOG_TABLES, TABLES, conform

LOADS = "loads"


def _write(df: DataFrame, out: str, name: str, load_id: str) -> None:
    # rebalance keeps an application together and lets AQE split one that is
    # far larger than the others
    (
        df.hint("rebalance", "app_id")
        .sortWithinPartitions("app_id")
        .write.mode("overwrite")
        .parquet(f"{out}/{name}/load_id={load_id}")
    )


def load_tables(tables: Mapping[str, DataFrame], out: str, load_id: str) -> None:
    """Write the six tables of some applications, and what else event logs gave, then list them as loaded."""
    for name in [*TABLES, *(n for n in LOG_TABLES if n in tables)]:
        _write(tables[name], out, name, load_id)
    listed = tables["dim_applications"].select("app_id", F.lit(time.time_ns()).alias("loaded_ns"))
    _write(listed, out, LOADS, load_id)


def _all_loads(spark: SparkSession, out: str) -> DataFrame:
    schema = "app_id string, loaded_ns bigint, load_id string"
    path = f"{out}/{LOADS}"
    if not path_exists(spark, path):
        return spark.createDataFrame([], schema)
    return spark.read.schema(schema).parquet(path)


def loads(spark: SparkSession, out: str) -> DataFrame:
    """Latest complete load of each application."""
    latest = F.max(F.struct("loaded_ns", "load_id"))["load_id"]
    return _all_loads(spark, out).groupBy("app_id").agg(latest.alias("load_id"))


def other_loads(spark: SparkSession, out: str, load_id: str) -> DataFrame:
    """Applications in the store by other loads than this one, which may be a repetition."""
    return _all_loads(spark, out).filter(F.col("load_id") != load_id).select("app_id").distinct()


def read_store(spark: SparkSession, out: str) -> dict[str, DataFrame]:
    """The six tables, whole applications only, each from its latest load.

    With ``fact_stage_nodes`` if any load has it.
    """
    current = loads(spark, out)
    tables = {}
    for name, schema in {**TABLES, **LOG_TABLES}.items():
        path = f"{out}/{name}"
        if not path_exists(spark, path):
            if name in TABLES:
                tables[name] = spark.createDataFrame([], schema)
            continue
        stored = spark.read.schema(f"{schema}, load_id string").parquet(path)
        kept = stored.join(current, ["app_id", "load_id"], "left_semi")
        tables[name] = conform(kept, name)
    return tables


def new_apps(landed: DataFrame, loaded: DataFrame) -> DataFrame:
    """Landed applications that are not loaded yet."""
    return landed.join(loaded.select("app_id"), "app_id", "left_anti")


def load_new(spark: SparkSession, tables: Mapping[str, DataFrame], out: str, load_id: str | None = None) -> None:
    """Load only applications the store does not hold yet, under a name of its own."""
    load_id = load_id or uuid.uuid4().hex
    earlier = other_loads(spark, out, load_id)
    load_tables({n: new_apps(df, earlier) for n, df in tables.items()}, out, load_id)
