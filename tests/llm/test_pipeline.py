import hashlib

import corpus_pipeline
import public_tokenizers
from tokenizers import Tokenizer

from stagelens.llm.lang_id import documents_in_a_language
from stagelens.llm.mixing import mix_plan
from stagelens.llm.ngram_join import near_documents


def test_stages_and_run(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    columns, seen, before = docs.columns, [], docs
    for name, stage in corpus_pipeline.STAGES:
        after = stage(spark, before, sf)
        seen.append((name, before, after))
        if name != corpus_pipeline.STAGES[-1][0]:
            assert after.columns == columns
        path = f"{corpus_pipeline.scratch_path(spark, 'test-stage')}"
        after.write.parquet(path)
        before = spark.read.parquet(path)
        seen[-1] = (name, seen[-1][1], before)
    (_, start, clean), (_, _, told), (_, _, one), (_, _, mixed), (_, _, coded) = seen
    ids = lambda df: sorted(r["doc_id"] for r in df.select("doc_id").collect())
    # toxic documents go, clean ones stay
    toxic = {r["doc_id"] for r in spark.read.parquet(f"{sf}/labels.parquet").filter("toxic = 1").collect()}
    gone = set(ids(start)) - set(ids(clean))
    assert gone and len(gone & toxic) >= len(gone) / 2 and len(gone) < 0.2 * start.count()
    assert ids(told) == ids(documents_in_a_language(clean)) and told.count() >= 0.98 * clean.count()
    # one document of each group
    groups = {r["component_id"] for r in near_documents(told).collect()}
    assert ids(one) == sorted(groups)
    copies = {r["doc_id"]: r["copies"] for r in mix_plan(one).collect()}
    assert ids(mixed) == sorted(i for i, n in copies.items() for _ in range(n))
    library = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    texts = {r["doc_id"]: r["text"] for r in mixed.collect()}
    rows = coded.collect()
    assert sorted(r["doc_id"] for r in rows) == ids(mixed)
    for r in rows:
        found = library.encode(texts[r["doc_id"]], add_special_tokens=False).ids
        assert r["n_tokens"] == len(found) and r["ids_sha256"] == hashlib.sha256(",".join(map(str, found)).encode()).hexdigest()
        assert r["decoded_sha256"] == hashlib.sha256(texts[r["doc_id"]].encode()).hexdigest()
    again = corpus_pipeline.run(spark, sf)
    assert sorted(map(tuple, again.collect())) == sorted(map(tuple, rows))


def test_names_in_the_driver_contract():
    import __spark_entry__

    names = set(__spark_entry__.queries())
    assert "pipeline" in names and {int(n[2:].split("_")[0]) for n in names if n.startswith("op")} == set(range(1, 14))
