import random
import re

import duckdb
import numpy as np
import pytest
from helpers import by_id, link_groups, no_documents, odd_documents

from stagelens.llm import common, ngram_join
from stagelens.llm.common import components, shingle_hashes, text_buffer, word_hashes
from stagelens.llm.ngram_join import distinct_documents, near_documents
from stagelens.llm.queries import QUERIES
from stagelens.llm.vector_join import near_vectors


def lowered(text):
    return re.sub("[A-Z]", lambda m: m[0].lower(), text or "")


def gram_set(text, k):
    words = re.findall(r"[^\x20\x09-\x0D]+", lowered(text))
    if len(words) < k:
        return {tuple(words)} if words else set()
    return {tuple(words[i : i + k]) for i in range(len(words) - k + 1)}


def near_by_brute_force(rows, k, threshold):
    sets = {r["doc_id"]: gram_set(r["text"], k) for r in rows}
    ids = sorted(i for i in sets if i is not None)
    linked = [
        (a, b) for a in ids for b in ids
        if a < b and sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= threshold * len(sets[a] | sets[b])
    ]
    low = link_groups(ids, linked)
    return {i: (len(s), low.get(i)) for i, s in sets.items()}


def edited_copies(seed, groups=6, size=25):
    """Chains and clumps of copies with a few words changed, and texts that share long passages without being near."""
    rnd = random.Random(seed)
    word = lambda: "".join(rnd.choice("abcdefgh") for _ in range(rnd.randint(2, 6)))
    passage = [word() for _ in range(40)]
    rows = []
    for _ in range(groups):
        base = [word() for _ in range(rnd.randint(8, 120))]
        for _ in range(size):
            text = list(base)
            for _ in range(rnd.choice([0, 0, 1, 1, 2, 3, 6])):
                text[rnd.randrange(len(text))] = word()
            rows.append(" ".join(text))
        rows.append(" ".join(passage + base))
    rnd.shuffle(rows)
    return list(enumerate(rows, 10))


@pytest.mark.parametrize("k,threshold", [(3, 90), (5, 80), (1, 50)])
def test_near_documents_by_brute_force(spark, k, threshold):
    docs = spark.createDataFrame(edited_copies(k), "doc_id long, text string")
    want = near_by_brute_force(docs.collect(), k, threshold)
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in near_documents(docs, k, threshold).collect()}
    assert got == want
    assert len({c for _, c in want.values()}) < len(want)


def test_near_documents_equals_sql(spark, sf):
    duck = duckdb.connect()
    duck.execute(f"create view documents as select * from '{sf}/documents.parquet'")
    want = {r[0]: [r] for r in duck.execute(QUERIES["op7_ngram_join"].sql).fetchall()}
    assert by_id(QUERIES["op7_ngram_join"].run(spark, sf)) == want


def test_near_documents_with_odd_rows(spark):
    docs = odd_documents(spark)
    rows = docs.collect()
    want = near_by_brute_force(rows, 5, 80)
    found = near_documents(docs).collect()
    assert len(found) == len(rows)
    assert {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in found} == want
    kept = distinct_documents(docs)
    assert kept.columns == docs.columns
    assert {r["doc_id"] for r in kept.collect()} == {i for i, (_, c) in want.items() if c == i or i is None}
    assert near_documents(no_documents(spark)).collect() == []
    assert distinct_documents(no_documents(spark)).collect() == []


def test_word_and_gram_hashes_tell_words_apart():
    import pyarrow as pa

    texts = ["Ab c", "ab  c", "abc", "", "a bc x", "c ab"]
    words, at = word_hashes(*text_buffer(pa.array(texts)))
    assert np.diff(at).tolist() == [2, 2, 1, 0, 3, 2]
    assert (words[:2] == words[2:4]).all() and words[0] == words[-1] and len(set(words.tolist())) == 6
    grams, at = shingle_hashes(words, at, 2)
    assert np.diff(at).tolist() == [1, 1, 1, 0, 2, 1]
    assert grams[0] == grams[1] and len(set(grams.tolist())) == 5


@pytest.mark.parametrize("a_task", [4, 1 << 19])
def test_components(spark, monkeypatch, a_task):
    monkeypatch.setattr(common, "LINKS_A_TASK", a_task)
    chain = [(i, i + 1) for i in range(0, 30)] + [(100, i) for i in range(101, 140)] + [(7, 7), (None, 3), (50, 51), (51, 50)]
    random.Random(1).shuffle(chain)
    links = spark.createDataFrame(chain, "a long, b long")
    got = {r["node"]: r["component"] for r in components(links).collect()}
    want = {i: 0 for i in range(31)} | {i: 100 for i in range(100, 140)} | {50: 50, 51: 50}
    assert got == want
    assert components(links.filter("a < 0")).collect() == []


def test_filter_bits_only_save_work(spark, monkeypatch):
    monkeypatch.setattr(ngram_join, "FILTER_BITS", 1)
    docs = spark.createDataFrame(edited_copies(11, 2, 12), "doc_id long, text string")
    want = near_by_brute_force(docs.collect(), 5, 80)
    assert {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in near_documents(docs, bits=2).collect()} == want


def vectors_by_brute_force(rows, cosine):
    usable = {}
    for r in rows:
        v = r["embedding"]
        if r["label"] is None or v is None or any(x is None for x in v):
            continue
        x = np.array(v, float)
        if len(x) and np.isfinite(x).all() and (x != 0).any():
            usable[r["vec_id"]] = (r["label"], x / np.linalg.norm(x))
    linked = [
        (a, b) for a, (la, x) in usable.items() for b, (lb, y) in usable.items() if a < b and la == lb and len(x) == len(y) and x @ y >= cosine
    ]
    low = link_groups([r["vec_id"] for r in rows], linked)
    n = {r["vec_id"]: 0 for r in rows}
    for a, b in linked:
        n[a] += 1
        n[b] += 1
    return {i: (n[i], low[i], low[i] == i) for i in n}


def vector_rows(seed):
    rng = np.random.default_rng(seed)
    rows = []
    for c in range(5):
        centre = rng.normal(size=8)
        rows += [((centre + rng.normal(size=8) * s).tolist(), c % 2) for s in (0, 0, 0.05, 0.1, 0.1, 0.2, 0.3) for _ in range(6)]
    rows += [(rng.normal(size=8).tolist(), 1) for _ in range(60)]
    rows += [(None, 0), ([0.0] * 8, 0), ([float("nan")] + [1.0] * 7, 0), ([float("inf")] + [1.0] * 7, 0), ([None] + [1.0] * 7, 1), ([], 1),
             ([1.0] * 8, None), ([1.0] * 8, None), ([1.0] * 4, 0), ([2.0] * 4, 0), ([1e150] * 8, 1), ([1e-30] * 8, 1)]
    return [(i, v, c, "x", 1) for i, (v, c) in enumerate(rows)]


@pytest.mark.parametrize("pivots,block", [(1, 2048), (3, 7), (8, 50)])
def test_near_vectors_by_brute_force(spark, pivots, block):
    vectors = spark.createDataFrame(vector_rows(pivots), "vec_id long, embedding array<double>, label int, unit string, copies int")
    got = near_vectors(vectors, pivots=pivots, block=block)
    assert got.columns == ["vec_id", "n_links", "component_id", "kept"]
    found = {r["vec_id"]: (r["n_links"], r["component_id"], r["kept"]) for r in got.collect()}
    assert found == vectors_by_brute_force(vectors.collect(), 0.93)


def test_near_vectors_equals_sql(spark, sf):
    duck = duckdb.connect()
    duck.execute(f"create view embeddings as select * from '{sf}/embeddings.parquet'")
    want = {r[0]: tuple(r) for r in duck.execute(QUERIES["op8_near_vectors"].sql).fetchall()}
    assert {r["vec_id"]: tuple(r) for r in QUERIES["op8_near_vectors"].run(spark, sf).collect()} == want


def test_repeated_and_missing_vectors(spark):
    schema = "vec_id long, embedding array<float>, label int"
    rows = [(1, [1.0, 0.0], 0), (1, [1.0, 0.0], 0), (2, [2.0, 0.0], 0), (None, [1.0, 0.0], 0)]
    found = [tuple(r) for r in near_vectors(spark.createDataFrame(rows, schema)).collect()]
    assert sorted(found, key=str) == sorted([(1, 2, 1, True), (1, 2, 1, True), (2, 2, 1, False), (None, 0, None, True)], key=str)
    assert near_vectors(spark.createDataFrame([], schema)).collect() == []
