"""Run small applications with a known flaw each, with event logging on.

usage: python labelled_apps.py <log dir> <zstd|plain> [name ...]
"""

import sys
from pathlib import Path

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))

from pyspark.sql import SparkSession, Window  # noqa: E402
from pyspark.sql import functions as F  # noqa: E402
from pyspark.sql.types import StringType  # noqa: E402

from stagelens.sources import generators as gen  # noqa: E402
from stagelens.sources import tables as tb  # noqa: E402


def work(col):
    """Some CPU time per row."""
    return F.sha2(F.repeat(col.cast("string"), 10000), 512)


def skew(spark, data):
    # raw rows of the hot promotion meet in one task
    rows = tb.read_table(spark, f"{data}/sales").repartition(16, "promotion_id")
    tb.materialize(rows.select(work(F.col("transaction_id"))))


def sort_merge(spark, data):
    sales, customers = tb.read_table(spark, f"{data}/sales"), tb.read_table(spark, f"{data}/customers")
    tb.materialize(sales.join(customers.hint("merge"), "customer_id"))


def sort_after_join(spark, data):
    # the join's sorts are small, the sort of the copies is not
    customers = tb.read_table(spark, f"{data}/customers")
    joined = customers.join(customers.select("customer_id").hint("merge"), "customer_id")
    copies = joined.withColumn("copy", F.explode(F.sequence(F.lit(1), F.lit(40))))
    tb.materialize(copies.repartition("copy").sortWithinPartitions("copy", "customer_id"))


def broadcast(spark, data):
    sales, stores = tb.read_table(spark, f"{data}/sales"), tb.read_table(spark, f"{data}/stores")
    joined = sales.join(F.broadcast(stores), "store_id")
    joined.agg(F.sum("amount"), F.max("region"), F.max("store_name")).collect()


def window(spark, data):
    sales = tb.read_table(spark, f"{data}/sales")
    running = F.sum("amount").over(Window.orderBy("transaction_time"))
    tb.materialize(sales.withColumn("running", running))


def pairs(spark, data):
    stores = tb.read_table(spark, f"{data}/stores")
    other = stores.select(F.col("store_id").alias("other"))
    tb.materialize(stores.join(other, F.col("store_id") < F.col("other")).repartition(4))


def single(spark, data):
    sales = tb.read_table(spark, f"{data}/sales").select("transaction_id")
    tb.materialize(sales.repartition(8).repartition(1).select(work(F.col("transaction_id"))))


@F.udf(StringType())
def row_at_a_time(value):
    return f"{value}X"


def python(spark, data):
    customers = tb.read_table(spark, f"{data}/customers")
    customers.select(F.length(row_at_a_time("customer_name")).alias("n")).agg(F.sum("n")).collect()


def failing(spark, data):
    try:
        spark.range(4).select(F.raise_error(F.lit("planned"))).collect()
    except Exception:
        tb.materialize(spark.range(4))


PLAIN = {"spark.sql.adaptive.enabled": "false", "spark.sql.autoBroadcastJoinThreshold": "-1"}
APPS = {
    "skew": (skew, PLAIN),
    "sort_merge": (sort_merge, {**PLAIN, "spark.shuffle.spill.numElementsForceSpillThreshold": "1000"}),
    "sort_after_join": (sort_after_join, {**PLAIN, "spark.shuffle.spill.numElementsForceSpillThreshold": "1000"}),
    # two tasks: their partial sums are small beside what the join's own stage reads
    "broadcast": (broadcast, {"spark.sql.files.minPartitionNum": "2"}),
    "window": (window, {}),
    "pairs": (pairs, PLAIN),
    "single": (single, PLAIN),
    "python": (python, {}),
    "failing": (failing, {}),
}


def main(logs, form, *names):
    data = f"{logs}-data"
    base = {
        "spark.ui.enabled": "false",
        "spark.sql.shuffle.partitions": "8",
        "spark.eventLog.enabled": "true",
        "spark.eventLog.dir": f"file:{logs}",
        "spark.eventLog.logStageExecutorMetrics": "true",
        "spark.eventLog.compress": "true" if form == "zstd" else "false",
        "spark.eventLog.rolling.enabled": "true" if form == "zstd" else "false",
    }
    for name in ["setup", *(names or APPS)]:
        job, extra = APPS.get(name, (None, {}))
        builder = SparkSession.builder.master("local[8]").appName(name)
        conf = {**base, **extra}
        if job is None:
            conf["spark.eventLog.enabled"] = "false"
        for k, v in conf.items():
            builder = builder.config(k, v)
        spark = builder.getOrCreate()
        spark.sparkContext.setLogLevel("ERROR")
        if job is None:
            tb.write_table(tb.repartition_for_write(gen.gen_sales_skewed(spark, 60000, customers=3000), 8), f"{data}/sales")
            tb.write_table(gen.gen_customer_dim(spark, 3000), f"{data}/customers")
            tb.write_table(gen.gen_store_dim(spark), f"{data}/stores")
        else:
            job(spark, data)
        spark.stop()
        for k in conf:
            SparkSession.builder._options.pop(k, None)


if __name__ == "__main__":
    main(*sys.argv[1:])
