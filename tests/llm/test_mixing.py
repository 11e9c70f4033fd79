import re

import duckdb
from helpers import by_id, no_documents, odd_documents
from pyspark.sql import functions as F

from stagelens.llm.mixing import mix_plan, mixed_documents, source_targets
from stagelens.llm.queries import QUERIES


def water(sizes, weights=(5, 2, 1), most=3):
    """Targets by repeated sharing, sources in order with null last."""
    names = sorted(sizes, key=lambda s: (s is None, s))
    weight = {s: weights[i % len(weights)] for i, s in enumerate(names)}
    capped, total = set(), sum(sizes.values())
    while True:
        rest = total - sum(most * sizes[s] for s in capped)
        share = sum(weight[s] for s in names if s not in capped)
        over = {s for s in names if s not in capped and rest * weight[s] > most * sizes[s] * share}
        if not over:
            return {s: most * sizes[s] if s in capped else rest * weight[s] / share for s in names}
        capped |= over


def test_targets_by_brute_force(spark):
    for sizes in ({"a": 10, "b": 1, "c": 500}, {"a": 1, "b": 1, None: 100}, {"x": 7}, {"a": 0, "b": 5}, {chr(97 + i): i * i for i in range(9)}):
        rows = spark.createDataFrame([(s, n) for s, n in sizes.items()], "source string, size long")
        got = {r["source"]: r["target"] for r in source_targets(rows).collect()}
        want = water(sizes)
        assert got.keys() == want.keys()
        assert all(abs(got[s] - want[s]) < 1e-6 for s in want), (sizes, got, want)


def test_query_equals_sql(spark, sf):
    duck = duckdb.connect()
    duck.execute(f"create view documents as select * from '{sf}/documents.parquet'")
    want = {r[0]: r for r in duck.execute(QUERIES["op1_mix_sources"].sql).fetchall()}
    got = QUERIES["op1_mix_sources"].run(spark, sf)
    assert got.columns == ["doc_id", "size", "source_size", "target", "taken"]
    assert {r["doc_id"]: tuple(r) for r in got.collect()} == want


def test_taken_is_near_target_and_reruns_agree(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet").withColumn("source", F.concat(F.lit("s"), F.col("doc_id") % 3))
    plan = mix_plan(docs)
    assert all(r["taken"] <= 3 * r["size"] for r in plan.collect())
    sums = plan.groupBy("source").agg(F.sum("taken").alias("t"), F.max("target").alias("goal"), F.max("size").alias("big")).collect()
    assert all(abs(r["t"] - r["goal"]) <= 2 * r["big"] for r in sums)
    assert by_id(plan) == by_id(mix_plan(docs.repartition(5)))


def test_odd_rows(spark):
    docs = odd_documents(spark)
    plan = mix_plan(docs)
    rows = plan.collect()
    assert len(rows) == docs.count()
    texts = {r["doc_id"]: r["text"] for r in docs.collect()}
    for r in rows:
        assert r["size"] == len(re.findall(r"[^\x20\x09-\x0D]+", texts[r["doc_id"]] or ""))
    mixed = mixed_documents(docs)
    assert mixed.columns == docs.columns
    want = {}
    for r in rows:
        want.setdefault(r["doc_id"], []).append(r["copies"])
    got = {r["doc_id"]: r["count"] for r in mixed.groupBy("doc_id").count().collect()}
    assert all(got.get(i, 0) == -(-sum(c) // len(c)) * len(c) for i, c in want.items())


def test_no_rows(spark):
    assert mix_plan(no_documents(spark)).collect() == []
    assert mixed_documents(no_documents(spark)).collect() == []
