import math
import random

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from stagelens.llm import whitening
from stagelens.llm.negatives import Bucket, feasible, mine_negatives
from stagelens.llm.queries import QUERIES
from stagelens.llm.whitening import bit_planes, plane_products, whiten

ROWS = "vec_id long, embedding array<double>, label string, dim int, n long, whitened double, _one string"


def frame(spark, rows):
    return spark.createDataFrame([(i, v, label, 7, 1, 0.5, "x") for i, v, label in rows], ROWS)


def whole(v, scale, shift):
    return None if not v or any(c is None or not math.isfinite(c) for c in v) else [math.floor(c * scale) + shift for c in v]


def whitened_by_brute_force(rows, components=8):
    """Per length of vector: ids, deviations, whitened rows, explained shares, all from whole numbers."""
    out = {}
    usable = [(i, whole(v, 1024, 100_000)) for i, v, _ in rows]
    for dim in {len(x) for _, x in usable if x}:
        ids = [i for i, x in usable if x and len(x) == dim]
        x = np.array([x for _, x in usable if x and len(x) == dim], object)
        n, s = len(x), x.sum(0)
        cov = (n * (x.T @ x) - np.outer(s, s)) / (n * n)
        values, vectors = np.linalg.eigh(cov.astype(float))
        order = np.argsort(-values)[:components]
        deviations = [int(d) for d in ((n * x - s) ** 2).sum(1)]
        centred = ((n * x - s) / n).astype(float)
        out[dim] = ids, deviations, centred @ vectors[:, order], values[order], float(np.trace(cov.astype(float)))
    return out


@pytest.mark.parametrize("low,high,rows", [(0, 1, 5), (0, 1270, 700), (-(2**40), 2**40, 130), (-(2**62), 2**62, 65)])
def test_plane_products(low, high, rows):
    rnd = random.Random(rows)
    x = np.array([[rnd.randint(low, high) for _ in range(5)] for _ in range(rows)], np.int64)
    y = x.astype(np.uint64) - x.min(0).astype(np.uint64)
    exact = np.array([[int(a) - int(m) for a, m in zip(r, x.min(0), strict=True)] for r in x], object)
    assert (y.astype(object) == exact).all()
    assert (plane_products(bit_planes(y)).astype(object) == np.triu((exact.T @ exact).astype(object))).all()


def check_whitened(found, rows):
    want = whitened_by_brute_force(rows)
    assert len(found) == sum(len(ids) * min(8, dim) for dim, (ids, *_) in want.items())
    for dim, (ids, deviations, projected, values, trace) in want.items():
        mine = [r for r in found if r["n"] == len(ids) and r["vec_id"] in set(ids)]
        for k, value in enumerate(values):
            part = {r["vec_id"]: r for r in mine if r["component"] == k + 1}
            assert {i: int(part[i]["deviation"]) for i in ids} == dict(zip(ids, deviations, strict=True))
            if value > 1e-6 * values[0]:
                sign = np.sign(sum(part[i]["whitened"] * p for i, p in zip(ids, projected[:, k], strict=True)))
                assert all(abs(sign * part[i]["whitened"] - p / math.sqrt(value)) < 1e-6 for i, p in zip(ids, projected[:, k], strict=True))
                assert all(abs(r["explained"] - value / trace) < 1e-9 for r in part.values())
            else:
                assert all(r["whitened"] is None for r in part.values())


def test_whiten_by_brute_force(spark, monkeypatch):
    monkeypatch.setattr(whitening, "BLOCK", 64 * 12)
    rnd = random.Random(4)
    rows = [(i, [rnd.gauss(0, 1 + d) for d in range(12)], "a") for i in range(300)]
    found = whiten(frame(spark, rows).repartition(5)).collect()
    check_whitened(found, rows)
    assert all(r["identity_error"] < 1e-9 for r in found)


def test_whiten_query_by_brute_force(spark, sf):
    rows = [(r["vec_id"], r["embedding"], r["label"]) for r in spark.read.parquet(f"{sf}/embeddings.parquet").collect()]
    got = QUERIES["op11_whiten_vectors"].run(spark, sf)
    assert dict(got.dtypes) == {
        "vec_id": "bigint", "component": "int", "n": "bigint", "deviation": "bigint", "whitened": "double", "explained": "double",
        "identity_error": "double",
    }
    check_whitened(got.collect(), rows)


def test_whiten_odd_rows(spark):
    rnd = random.Random(5)
    rows = [(i, [rnd.uniform(-1, 1) for _ in range(3)], "a") for i in range(40)]
    rows += [(100, None, "a"), (101, [], "a"), (102, [1.0, None, 2.0], "a"), (103, [1.0, float("nan"), 0.0], "b")]
    rows += [(104, [float("inf"), 0.0, 0.0], None), (105, [1e300, 0.0, 0.0], "a"), (106, [2.0, 3.0], "a")]
    usable = [r for r in rows if r[0] != 105]
    found = whiten(frame(spark, rows)).collect()
    alone = [r for r in found if r["vec_id"] == 106]
    assert [(r["component"], r["n"], int(r["deviation"]), r["whitened"], r["explained"], r["identity_error"]) for r in alone] == [
        (1, 1, 0, None, None, None), (2, 1, 0, None, None, None),
    ]
    check_whitened([r for r in found if r["vec_id"] != 106], [r for r in usable if r[0] != 106])
    # repeated rows count each, a null id is an id
    twice = whiten(frame(spark, rows[:10] + rows[:10] + [(None, [0.0, 0.0, 0.0], None)])).collect()
    assert len(twice) == 21 * 3 and {r["n"] for r in twice} == {21}
    assert whiten(frame(spark, rows).limit(0)).collect() == []
    # far from zero, and deviations beyond a long
    wide = [(i, [rnd.uniform(-1e12, 1e12), rnd.uniform(-1e3, 1e3)], "a") for i in range(70)]
    check_whitened(whiten(frame(spark, wide)).collect(), wide)


def mined_by_brute_force(rows, every=100, positives=5, negatives=10, least=30, most=90, scale=256):
    usable = [(i, whole(v, scale, 0), label) for i, v, label in rows if i is not None and label is not None]
    usable = [r for r in usable if r[1]]
    anchors = {}
    for i, x, label in sorted(usable, key=lambda r: (r[0], r[2], len(r[1]), r[1])):
        if i % every == 0:
            anchors.setdefault(i, (x, label))
    out = []
    for a, (q, label) in anchors.items():
        scored = [(-sum(p * r for p, r in zip(q, x, strict=True)), i, other == label) for i, x, other in usable if len(x) == len(q)]
        for score, p, _ in sorted(r for r in scored if r[2] and r[1] != a)[:positives]:
            band = sorted(r for r in scored if not r[2] and least * -score <= 100 * -r[0] <= most * -score)
            out += [(a, p, k, i, -score, -s) for k, (s, i, _) in enumerate(band[:negatives], 1)]
    return sorted(out)


def test_feasible_range_holds_every_vector():
    rnd = np.random.default_rng(3)
    for dim in (2, 3, 8):
        unit = rnd.normal(size=(4000, dim))
        unit /= np.linalg.norm(unit, axis=1)[:, None]
        for q in unit[:40]:
            cosines = unit @ q
            least, most = sorted(rnd.uniform(-1, 1, 2))
            inside = (cosines >= least) & (cosines <= most)
            for f in range(dim):
                low, high = feasible(q[f], least, most)
                assert ((unit[inside, f] >= low) & (unit[inside, f] <= high)).all()


def test_candidates_lose_no_score():
    rnd = np.random.default_rng(8)
    vectors = rnd.integers(-40, 40, (500, 6))
    vectors[::50] = 0
    bucket = Bucket(np.arange(500), np.zeros(500), vectors, np.sqrt((vectors.astype(float) ** 2).sum(1)))
    dropped = 0
    for anchor in vectors[:60]:
        scores = vectors @ anchor
        for low, high in [(2000, 4000), (-100, 100), (-3000, -1500), (3000, 1 << 62)]:
            found = bucket.candidates(anchor, float(np.sqrt((anchor.astype(float) ** 2).sum())), low, high)
            assert set(np.flatnonzero((scores >= low) & (scores <= high))) <= set(found)
            dropped += 500 - len(found)
    assert dropped > 0


@pytest.mark.parametrize("block,anchor_block", [(1 << 19, 2048), (160, 3)])
def test_mine_negatives_by_brute_force(spark, block, anchor_block):
    rnd = random.Random(block)
    rows = []
    for i in range(400):
        scale = rnd.choice([0.2, 1, 1, 4])
        rows.append((i, [round(scale * rnd.gauss(0.3, 0.5), 1) for _ in range(4)], rnd.choice("aaaab" if i < 300 else "cdefg")))
    rows += [(1000 + i, [0.5, 0.5, 0.5, 0.5], "a") for i in range(60)]  # ties
    got = mine_negatives(frame(spark, rows).repartition(3), every=20, block=block, anchor_block=anchor_block)
    assert got.columns == ["anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score"]
    want = mined_by_brute_force(rows, every=20)
    assert sorted(map(tuple, got.collect())) == want and len(want) > 200


def test_mine_negatives_equals_sql(spark, sf):
    duck = duckdb.connect()
    duck.execute(f"create view embeddings as select * from '{sf}/embeddings.parquet'")
    got = QUERIES["op12_mine_negatives"].run(spark, sf)
    cursor = duck.execute(QUERIES["op12_mine_negatives"].sql)
    assert got.columns == [c[0] for c in cursor.description]
    assert sorted(map(tuple, got.collect())) == sorted(cursor.fetchall())


def test_mine_negatives_odd_rows(spark):
    rows = [(i, [math.sin(i), math.cos(i), 0.3], "ab"[i % 2]) for i in range(0, 230, 10)]
    rows += [(100, [0.0, 0.0, 1.0], "b"), (7, [0.1, 0.2, 0.3], "a"), (7, [0.1, 0.2, 0.3], "a"), (300, [0.0, 0.0, 0.0], "a")]
    rows += [(400, None, "a"), (500, [], "a"), (600, [1.0, None, 2.0], "a"), (700, [1.0, float("nan"), 0.0], "b"), (800, [float("-inf"), 0.0, 0.0], "a")]
    rows += [(900, [1.0, 1.0, 1.0], None), (None, [1.0, 1.0, 1.0], "a"), (1000, [1e30, 0.0, 0.0], "b"), (1100, [1.0, 2.0], "a"), (1101, [1.0, 2.0], "b")]
    rows += [(1102, [1.0, 3.0], "a"), (1200, [1.0], "a")]
    want = mined_by_brute_force([r for r in rows if r[0] != 1000])
    assert sorted(map(tuple, mine_negatives(frame(spark, rows)).collect())) == want
    assert any(r[0] == 1100 for r in want)
    one_label = frame(spark, rows).withColumn("label", F.lit("x"))
    assert mine_negatives(one_label).collect() == []
    assert mine_negatives(frame(spark, rows).limit(0)).collect() == []
