import itertools
from collections import Counter, defaultdict
from decimal import Decimal

import pytest
from conftest import plan_of
from pyspark.sql import Window
from pyspark.sql import functions as F

from stagelens.operators import aggregates as ag
from stagelens.operators import joins as jn
from stagelens.operators import ordering as od
from stagelens.operators import udfs
from stagelens.operators.caching import cached, count_slices, count_slices_cached
from stagelens.sources import generators as gen
from stagelens.sources import tables as tb


def rows(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


@pytest.fixture(scope="module")
def sales(spark):
    """One key with 80 % of the rows, some null keys, few distinct times."""
    return (
        gen.gen_sales_skewed(spark, 5000, customers=200)
        .withColumn("promotion_id", F.when(F.col("transaction_id") % 50 != 0, F.col("promotion_id")))
        .withColumn("at", F.when(F.col("transaction_id") % 3 == 0, 7).otherwise(F.col("transaction_id") % 90))
        .withColumn("at", F.when(F.col("transaction_id") % 41 != 0, F.col("at")))
        .withColumn("amount", F.col("amount").cast("decimal(18,2)"))
        .checkpoint()
    )


# --- joins ---------------------------------------------------------------------------


def test_join_strategies_show_in_the_plan(spark, sales):
    customers, stores = gen.gen_customer_dim(spark, 200), gen.gen_store_dim(spark, 100)
    assert "SortMergeJoin" in plan_of(jn.shuffle_join(sales, customers, "customer_id"))
    assert "BroadcastHashJoin" in plan_of(jn.broadcast_join(sales, stores, "store_id"))
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        too_big = jn.broadcast_join(sales, stores, "store_id", max_rows=99)
        # only the list of hot keys is broadcast; both sides of the join itself move
        assert "SortMergeJoin" in plan_of(too_big)
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert too_big.count() == jn.broadcast_join(sales, stores, "store_id").count() == 5000


@pytest.mark.parametrize("how", ["inner", "left"])
def test_skew_join_equals_plain_join(spark, sales, how):
    dim = spark.createDataFrame([(i, f"p{i}", i * 2) for i in range(1, 900)], "promotion_id int, name string, w int")
    salted = jn.skew_join(sales, dim, "promotion_id", how)
    assert rows(salted) == rows(sales.join(dim, "promotion_id", how).select(salted.columns))


def test_skew_join_matches_the_null_key_in_left_lookups_only(spark, sales):
    dim = spark.createDataFrame([(None, "none"), (1, "hot")], "promotion_id int, name string")
    counts = dict(rows(jn.skew_join(sales, dim, "promotion_id", "left").groupBy("name").count()))
    assert counts["none"] == sales.filter("promotion_id is null").count() > 0
    assert "none" not in dict(rows(jn.skew_join(sales, dim, "promotion_id").groupBy("name").count()))


def test_skew_join_many_to_many(spark, sales):
    left, right = sales.limit(400).checkpoint(), sales.select("promotion_id", F.col("transaction_id").alias("other"))
    joined = jn.skew_join(left, right, "promotion_id")
    plain = left.join(right, "promotion_id")
    assert joined.count() == plain.count()
    assert joined.agg(F.sum("other")).first() == plain.agg(F.sum("other")).first()


def test_skew_join_spreads_the_hot_key(spark, sales):
    dim = spark.createDataFrame([(i, i) for i in range(1, 1001)], "promotion_id int, w int")
    hot = sales.filter("promotion_id = 1").count()
    plan = jn.skew_join(sales, dim.hint("merge"), "promotion_id", shares=64)
    assert hot > 3000
    salts = (
        sales.filter("promotion_id = 1")
        .select(F.pmod(F.xxhash64("transaction_id"), F.lit(64)).alias("s"))
        .groupBy("s").count().agg(F.max("count")).first()[0]
    )
    assert salts < hot / 20
    assert plan.count() == sales.filter("promotion_id is not null").count()


def test_join_cardinality_is_the_join_size(spark, sales):
    left, right = sales.select("promotion_id"), sales.select("promotion_id").limit(300).checkpoint()
    assert jn.join_cardinality(left, right, "promotion_id").first()[0] == left.join(right, "promotion_id").count()
    assert jn.join_cardinality(left, right.filter("false"), "promotion_id").first()[0] == 0


def test_cross_join_totals(spark):
    a = spark.createDataFrame([(i, i * 2) for i in range(7)], "x int, y int")
    b = spark.createDataFrame([(i,) for i in range(5)], "z int")
    got = jn.cross_join_totals(a, b, ["x", "y"], ["z"]).first()
    pairs = list(itertools.product(a.collect(), b.collect()))
    want = (len(pairs), sum(p.x for p, _ in pairs), sum(p.y for p, _ in pairs), sum(q.z for _, q in pairs))
    assert (int(got[0]), *got[1:]) == want
    assert int(jn.cross_self_join_size(a).first()[0]) == 49
    assert int(jn.cross_join_totals(a, b.filter("false")).first()[0]) == 0


def test_rename_shared(spark):
    df = jn.rename_shared(spark.range(1), "_2")
    assert df.columns == ["id_2"]


# --- aggregates ------------------------------------------------------------------------


def test_salted_agg_equals_plain(sales):
    aggs = {"s": ("sum", "amount"), "n": ("count", "amount"), "lo": ("min", "amount"), "hi": ("max", "amount")}
    salted = ag.salted_agg(sales, ["promotion_id"], {**aggs, "d": ("count_distinct", "customer_id")}, ["transaction_id"])
    plain = sales.groupBy("promotion_id").agg(
        F.sum("amount").alias("s"), F.count("amount").alias("n"), F.min("amount").alias("lo"),
        F.max("amount").alias("hi"), F.countDistinct("customer_id").alias("d"),
    )
    cols = ["promotion_id", "s", "n", "lo", "hi", "d"]
    assert rows(salted.select(cols)) == rows(plain.select(cols))


def test_upper_median(spark):
    import random

    rnd = random.Random(3)
    data = [("hot", rnd.randrange(10**7)) for _ in range(4001)]
    data += [("copies", 5)] * 1000 + [("copies", 9)] * 1000 + [("even", 1), ("even", 2), ("one", -7), ("gap", None)]
    data += [("neg", v) for v in (-5000, -4096, -1, 0, 4095, 4096)]
    df = spark.createDataFrame(data, "k string, v bigint")
    groups = defaultdict(list)
    for k, v in data:
        if v is not None:
            groups[k].append(v)
    want = {k: sorted(v)[len(v) // 2] for k, v in groups.items()}
    got = ag.upper_median(df, ["k"], "v", "m")
    assert dict(rows(got)) == want


def test_order_stats_over_any_range(spark):
    import random

    rnd = random.Random(9)
    near = [("near", 2**62 + rnd.randrange(50)) for _ in range(3001)]  # all in one bucket of a level
    far = [("far", rnd.choice([-(2**63), 2**63 - 1, 0, -1, rnd.randrange(-(2**60), 2**60)])) for _ in range(2000)]
    wide = [(None, v * 2**40) for v in range(-300, 301)]
    data = near + far + wide + [("one", 2**63 - 1), ("gap", None)]
    groups = defaultdict(list)
    for k, v in data:
        if v is not None:
            groups[k].append(v)
    want = {k: (min(v), sorted(v)[len(v) // 2], max(v)) for k, v in groups.items()}
    df = spark.createDataFrame(data, "k string, v bigint")
    assert {r.k: (r.lo, r.mid, r.hi) for r in ag.order_stats(df, ["k"], "v").collect()} == want
    same = spark.createDataFrame([("a", 7)] * 5 + [("b", 7)], "k string, v int")
    assert rows(ag.order_stats(same, ["k"], "v")) == [("a", 7, 7, 7), ("b", 7, 7, 7)]
    assert ag.order_stats(same, ["k"], "v").dtypes == [("k", "string"), ("lo", "int"), ("mid", "int"), ("hi", "int")]
    assert ag.order_stats(same.limit(0), ["k"], "v").collect() == []


def test_order_stats_reads_rows_once(spark, tmp_path):
    spark.range(5000).selectExpr("id % 3 as k", "id * id as v").write.parquet(str(tmp_path / "t"))
    plan = plan_of(ag.order_stats(spark.read.parquet(str(tmp_path / "t")), ["k"], "v"))
    assert str(tmp_path / "t") not in plan  # everything after the counts reads the counts
    ranks = ag.value_counts(spark.range(1000).selectExpr("id % 2 as k", "id as v"), ["k"], "v")
    ninth = ag.select_rank(ranks, ["k"], F.floor(F.col("_n") * 0.9), digit=3)
    assert rows(ninth) == [(0, 0, 900, 998), (1, 1, 901, 999)]


def test_skew_profile(spark):
    df = spark.createDataFrame([(k,) for k in [1] * 8 + [2] * 2 + [3] * 2 + [4]], "k int")
    r = ag.skew_profile(df, "k").first()
    assert (r.n_keys, r.n_rows, r.max_rows, r.top_key, r.median_rows) == (4, 13, 8, 1, 2.0)
    assert r.top_share == 8 / 13 and r.max_over_median == 4.0


def test_sum_count_uses_map_side_partials(sales):
    plan = plan_of(ag.sum_count_by(sales, "promotion_id", "amount"))
    assert "partial_sum" in plan and "partial_count" in plan


# --- order --------------------------------------------------------------------------------


@pytest.mark.parametrize("by", [[], ["promotion_id"]])
def test_running_sum_equals_window(sales, by):
    rows_in = sales.select("transaction_id", "promotion_id", "at", "amount")
    window = Window.partitionBy(*by).orderBy("at")
    want = rows_in.withColumn("running_sum", F.sum("amount").over(window))
    got = od.running_sum(rows_in, "at", "amount", by)
    assert rows(got.select(want.columns)) == rows(want)


def test_running_sum_null_values(spark):
    df = spark.createDataFrame([(1, None), (2, Decimal(3)), (2, None), (3, None), (None, None)], "o int, v decimal(9,0)")
    want = df.withColumn("running_sum", F.sum("v").over(Window.orderBy("o")))
    assert rows(od.running_sum(df, "o", "v")) == rows(want)


def test_running_sum_has_no_single_task_window(sales):
    plan = plan_of(od.running_sum(sales.select("at", "amount", "transaction_id"), "at", "amount"))
    big_windows = [line for line in plan.split("\n") if "SinglePartition" in line]
    assert not big_windows


def test_with_position(sales):
    got = od.with_position(sales.select("amount", "transaction_id"), ["amount", "transaction_id"])
    ordered = sorted((r.amount, r.transaction_id, r.position) for r in got.collect())
    assert [p for *_, p in ordered] == list(range(1, 5001))
    down = od.with_position(sales.select("amount", "transaction_id"), [F.desc("amount"), F.desc("transaction_id")])
    ordered = sorted(((r.amount, r.transaction_id, r.position) for r in down.collect()), reverse=True)
    assert [p for *_, p in ordered] == list(range(1, 5001))


def test_global_sort_ranges_do_not_overlap(spark, sales):
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        parts = (
            od.global_sort(sales.select("at", "transaction_id"), "at")
            .filter("at is not null")
            .withColumn("p", F.spark_partition_id())
            .groupBy("p").agg(F.min("at").alias("lo"), F.max("at").alias("hi"), F.count("at").alias("n"))
            .orderBy("p").collect()
        )
    finally:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "true")
    assert all(a.hi <= b.lo for a, b in zip(parts, parts[1:]))
    # a third of the rows share one value, yet no range holds that many
    assert len(parts) > 4 and max(p.n for p in parts) < 5000 / 3


def test_exact_copies_spread_over_ranges_and_salts(spark):
    copies = spark.range(4000, numPartitions=16).select(F.lit(5).alias("k"), F.lit("same").alias("v"))
    rest = spark.range(4000, numPartitions=8).select(F.col("id").cast("int").alias("k"), F.lit("other").alias("v"))
    df = copies.unionByName(rest)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        parts = od.global_sort(df, "k").withColumn("p", F.spark_partition_id()).groupBy("p").count().collect()
    finally:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "true")
    assert sum(r["count"] for r in parts) == 8000 and max(r["count"] for r in parts) < 2500
    placed = od.with_position(df, ["k"])
    assert sorted(r.position for r in placed.collect()) == list(range(1, 8001))
    dim = spark.range(4000).select(F.col("id").cast("int").alias("k"), (F.col("id") * 2).alias("w"))
    assert rows(jn.skew_join(df, dim, "k")) == rows(df.join(dim, "k"))


def test_top_per_group_drops_rows_before_the_shuffle(sales):
    top = od.top_per_group(sales, ["promotion_id"], [F.desc("amount"), F.col("transaction_id")], 2)
    assert "WindowGroupLimit" in plan_of(top)
    assert max(Counter(r.promotion_id for r in top.collect()).values()) == 2


def test_take_first_and_shuffle(sales):
    first = od.take_first(sales, [F.desc("transaction_id")], 3)
    assert [r.transaction_id for r in first.collect()] == [5000, 4999, 4998]
    ids = [r.transaction_id for r in od.shuffle_rows(sales, 1).collect()]
    assert sorted(ids) == list(range(1, 5001)) and ids != sorted(ids)


# --- caching, Python functions, tables -------------------------------------------------------


def test_cached_releases(spark, sales):
    df = sales.filter("store_id > 3")
    with cached(df):
        assert df.is_cached
    assert not df.is_cached
    slices = {"hot": F.col("promotion_id") == 1, "other": F.col("promotion_id") != 1}
    assert rows(count_slices(sales, slices)) == rows(count_slices_cached(sales, slices))
    assert "InMemoryTableScan" not in plan_of(sales.filter(slices["hot"]))


def test_python_functions_equal_their_rewrites(spark):
    df = spark.createDataFrame([(1, "a", Decimal("1.50")), (2, None, Decimal("2.00"))], "i int, s string, d decimal(9,2)")
    marked = df.select(udfs.mark_text("s").alias("a"), udfs.mark_text_builtin(F.col("s")).alias("b"))
    assert "ArrowEvalPython" in plan_of(marked)
    assert [tuple(r) for r in marked.collect()] == [("aX", "aX"), ("NoneX", "NoneX")]
    pairs = df.select(udfs.pair_text("i", "d").alias("a"), udfs.pair_text_builtin(F.col("i"), F.col("d")).alias("b"))
    assert "ArrowEvalPython" in plan_of(pairs)
    assert all(r.a == r.b == f"ID:{i}_AMT:{d}" * 10 for r, (i, _, d) in zip(pairs.collect(), df.collect()))


def test_explode_range(spark):
    assert udfs.explode_range(spark.range(3), 200).agg(F.count("exploded"), F.sum("exploded")).first() == (600, 59700)


def test_tables(spark, tmp_path):
    df = gen.gen_store_dim(spark, 20)
    tb.write_csv(df, f"{tmp_path}/csv")
    assert rows(tb.read_csv(spark, f"{tmp_path}/csv", df.schema)) == rows(df)
    tb.write_table(tb.repartition_for_write(df, 4), f"{tmp_path}/t")
    assert len(list((tmp_path / "t").glob("part-*"))) == 4
    assert rows(tb.read_table(spark, f"{tmp_path}/t")) == rows(df)
    tb.write_table(df, f"{tmp_path}/p", ["region"])
    assert {p.name for p in (tmp_path / "p").glob("region=*")} == {"region=North", "region=South"}
    scan = tb.read_table(spark, f"{tmp_path}/t").filter(F.col("store_id") > 5).select("store_name")
    assert "GreaterThan(store_id,5)" in plan_of(scan)
    tb.materialize(df)
    assert tb.count_rows(df).first()[0] == 20
    tb.register_views(spark, {"stores_v": df})
    assert spark.sql("select count(*) from stores_v where region = 'North'").first()[0] == 5


def test_generators(spark):
    n = 20000
    sales = gen.gen_sales_skewed(spark, n)
    assert rows(sales.limit(50)) == rows(gen.gen_sales_skewed(spark, n).repartition(3).filter("transaction_id <= 50"))
    r = sales.agg(
        F.count_if(F.col("promotion_id") == 1) / n, F.min("promotion_id"), F.max("promotion_id"),
        F.min("amount"), F.max("amount"), F.min("store_id"), F.max("store_id"),
    ).first()
    assert abs(r[0] - 0.8) < 0.01 and (r[1], r[2]) == (1, 1000) and r[3] >= 10 and r[4] <= 110 and r[5:] == (1, 100)
    customers = gen.gen_customer_dim(spark, 2000).agg(F.min("loyalty_score"), F.max("loyalty_score"), F.count("*")).first()
    assert customers == (0, 99, 2000)
    assert gen.gen_store_dim(spark).filter("region = 'North'").count() == 25
    assert gen.gen_sales(spark, 10).columns == ["transaction_id", "transaction_time", "customer_id", "store_id", "amount"]
