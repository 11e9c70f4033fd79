import hashlib
import random
import zlib

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from helpers import by_id, no_documents, odd_documents

from stagelens.llm import byte_bpe, token_shards
from stagelens.llm.bpe_words import encode_and_decode
from stagelens.llm.byte_bpe import cut_words, encoded_texts, remembered_ids, tokenizer, word_ids
from stagelens.llm.common import text_buffer
from stagelens.llm.queries import QUERIES
from stagelens.llm.token_count import count_tokens, RUN, merged_counts, piece_table
from stagelens.llm.token_shards import _block, compress, expand, expansion_lengths, read_range, read_token_shards, write_token_shards

BYTE = public_tokenizers.path("byte_bpe_50k.json")
PIECE = public_tokenizers.path("piece_bpe_32k.model")
PARTS = [" ", "  ", "\n", "\t", "a", "the", "é", "日本", "🤯", " ", "'", "'s", "'S", "'re", "'llama", "''s", "<|endoftext|>", "<|end", "2024",
         "\x00", "\x1c", "▁", "!", "\r\n", "²", "ing", "ab", "<s>", "<0x0A>"]


@pytest.fixture(scope="module")
def library():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(BYTE)


@pytest.fixture(scope="module")
def pieces():
    import sentencepiece

    return sentencepiece.SentencePieceProcessor(model_file=PIECE)


def fuzz(n=1500):
    rnd = random.Random(7)
    return ["".join(rnd.choice(PARTS) for _ in range(rnd.randint(0, 30))) for _ in range(n)]


def test_words_and_ids_as_the_library_has_them(library):
    texts = fuzz()
    ids, at = encoded_texts(*text_buffer(pa.array(texts)), BYTE)
    want = library.encode_batch(texts, add_special_tokens=False)
    assert [ids[a:b].tolist() for a, b in zip(at, at[1:], strict=False)] == [e.ids for e in want]


def test_cut_covers_the_text():
    raw, at = text_buffer(pa.array(fuzz(200)))
    starts, first = cut_words(raw, at, tokenizer(BYTE)[1])
    assert starts[0] == 0 and starts[-1] == len(raw) and (np.diff(starts) > 0).all()
    assert (starts[first] == at).all()


def test_merging_equals_the_library(pieces):
    table = piece_table(PIECE)
    rng = random.Random(1)
    any_length = ["".join(rng.choices("etaoinshrdlu", k=n)) for n in (RUN - 2, RUN - 1, RUN, RUN + 1, 2 * RUN - 1, 2 * RUN, 9 * RUN + 7)]
    mixed = "".join(rng.choices(["tion", "nation", "al", "日本", "é", "qq", "\U0001f600"], k=2000))
    words = ["▁" + w for w in ("abab" * 30, "the", "x", "日本語", "a" * 300, "nationalisation", "zzzz", "a" * 5000, *any_length, mixed)]
    codes = np.frombuffer("".join(words).encode("utf-32-le"), np.uint32)
    starts = np.concatenate([[0], np.cumsum([len(w) for w in words])])
    want = [len(pieces.encode(w[1:])) for w in words]
    assert merged_counts(codes, starts, table).tolist() == want
    assert [merged_counts(codes[a:b], np.array([0, b - a]), table)[0] for a, b in zip(starts, starts[1:], strict=False)] == want


def test_counts_of_documents(spark, sf, pieces):
    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()
    want = {r["doc_id"]: [(r["doc_id"], len(r["text"].encode()), n := len(pieces.encode(r["text"])), n > 4096)] for r in docs}
    assert by_id(QUERIES["op5_count_tokens"].run(spark, sf)) == want


def test_counts_of_odd_rows(spark, pieces):
    docs = odd_documents(spark)
    texts = docs.select("doc_id", "text").collect() + []
    want = {}
    for r in texts:
        text = r["text"] or ""
        n = len(pieces.encode(text))
        want.setdefault(r["doc_id"], []).append((r["doc_id"], len(text.encode()), n, n > 4096))
    assert by_id(count_tokens(docs, PIECE)) == {k: sorted(v) for k, v in want.items()}
    assert count_tokens(no_documents(spark), PIECE).collect() == []


def test_grammar_round_trip():
    rng = np.random.default_rng(3)
    for ids in (
        np.zeros(0, np.uint32), np.zeros(1, np.uint32), np.zeros(1000, np.uint32), np.tile(np.array([1, 2, 3, 1, 2], np.uint32), 400),
        rng.integers(0, 40, 20000).astype(np.uint32), rng.zipf(1.3, 20000).clip(0, 50000).astype(np.uint32),
    ):
        terminals, rules, symbols = compress(ids)
        assert (expand(symbols, terminals, rules) == ids).all()
        assert len(ids) < 1000 or len(symbols) < len(ids)
        block = _block(0, 0, 0, [1], [ids])
        for a, b in ((0, min(10, len(ids))), (len(ids) // 3, len(ids) // 2), (max(len(ids) - 5, 0), len(ids)), (0, len(ids))):
            assert (read_range(block, a, b) == ids[a:b]).all()


def test_grammar_leaves_no_pair_twice():
    rng = np.random.default_rng(4)
    passage = rng.integers(0, 50000, 5000).astype(np.uint32)
    assert len(compress(np.tile(passage, 2))[2]) == 2
    for ids in (
        np.tile(passage, 3), rng.integers(0, 40, 20000).astype(np.uint32), rng.zipf(1.3, 20000).clip(0, 50000).astype(np.uint32),
        rng.integers(0, 2, 3000).astype(np.uint32), np.repeat(rng.integers(0, 9, 500), rng.integers(1, 9, 500)).astype(np.uint32),
    ):
        terminals, rules, symbols = compress(ids)
        assert (expand(symbols, terminals, rules) == ids).all()
        last, places = {}, {}
        for i, pair in enumerate(zip(symbols.tolist(), symbols[1:].tolist(), strict=False)):
            if last.get(pair, -2) < i - 1:
                last[pair], places[pair] = i, places.get(pair, 0) + 1
        assert max(places.values(), default=0) < 2
        assert len({tuple(r) for r in rules.tolist()}) == len(rules)


def test_most_pairs_of_one_place_are_not_sorted(monkeypatch):
    ids = np.random.default_rng(5).zipf(1.2, 100000).clip(0, 50000).astype(np.uint32)
    want, sort, sizes = compress(ids), token_shards._pairs_in_order, []
    monkeypatch.setattr(token_shards, "_pairs_in_order", lambda *a: sizes.append(len(a[1])) or sort(*a))
    compress(ids)
    fewer = sum(sizes)
    monkeypatch.setattr(token_shards, "_may_be_often", lambda key, *_: np.ones(len(key), bool))
    sizes.clear()
    assert all(np.array_equal(a, b) for a, b in zip(compress(ids), want, strict=True))
    assert fewer < 0.9 * sum(sizes)


@pytest.mark.parametrize("depth", [5, 500])
def test_lengths_of_chained_rules(depth):
    rules = np.array([(0, 1)] + [(2 + i, 0) for i in range(depth)])
    assert expansion_lengths(2, rules).tolist() == list(range(2, depth + 3))


@pytest.mark.parametrize("alike", [False, True])
def test_known_words_are_found_without_a_new_table(monkeypatch, alike):
    monkeypatch.setattr(byte_bpe, "_MEMORY", {})
    monkeypatch.setattr(byte_bpe.pc, "index_in", None)
    if alike:  # words of one hash
        monkeypatch.setattr(byte_bpe, "span_hashes", lambda raw, starts, ends: np.zeros(len(starts), np.uint64))
    for words in (["a", " the", "", "日本"], [" the", "b", "\n", "a"], ["b", "zebra", "日本", "a"], []):
        words = pa.array(words, pa.large_string())
        assert remembered_ids(words, BYTE).equals(word_ids(words, BYTE))
    monkeypatch.setattr(byte_bpe, "REMEMBERED", 2)
    for words in (["c", "a"], ["a", "d", "e"], ["e", "c", "a"]):
        words = pa.array(words, pa.large_string())
        assert remembered_ids(words, BYTE).equals(word_ids(words, BYTE))


def expected_shards(library, rows):
    at, out = 0, {}
    for doc_id, text in rows:
        ids = [*library.encode(text or "", add_special_tokens=False).ids, 0]
        out[doc_id] = [(doc_id, at, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()))]
        at += len(ids)
    return out


def test_shards_of_documents(spark, sf, library):
    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").orderBy("doc_id").collect()
    assert by_id(QUERIES["op2_store_tokens"].run(spark, sf)) == expected_shards(library, docs)


def test_shards_of_odd_rows(spark, tmp_path, library):
    docs = odd_documents(spark).dropDuplicates(["doc_id"])
    write_token_shards(docs, str(tmp_path / "a"), BYTE)
    rows = sorted(((r["doc_id"], r["text"]) for r in docs.collect()), key=lambda r: (r[0] is not None, r[0]))
    assert by_id(read_token_shards(spark, str(tmp_path / "a"))) == expected_shards(library, rows)
    write_token_shards(odd_documents(spark), str(tmp_path / "b"), BYTE)
    assert read_token_shards(spark, str(tmp_path / "b")).count() == odd_documents(spark).count()
    write_token_shards(no_documents(spark), str(tmp_path / "c"), BYTE)
    assert read_token_shards(spark, str(tmp_path / "c")).collect() == []


def expected_digests(library, rows):
    out = {}
    for r in rows:
        ids = library.encode(r["text"] or "", add_special_tokens=False).ids
        back = library.decode(ids, skip_special_tokens=False)
        row = (r["doc_id"], len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256(back.encode()).hexdigest())
        out.setdefault(r["doc_id"], []).append(row)
    return {k: sorted(v) for k, v in out.items()}


def test_round_trip_of_documents(spark, sf, library):
    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()
    assert by_id(QUERIES["op6_encode_and_decode"].run(spark, sf)) == expected_digests(library, docs)


def test_round_trip_of_odd_rows(spark, library):
    docs = odd_documents(spark)
    assert by_id(encode_and_decode(docs, BYTE)) == expected_digests(library, docs.collect())
    assert encode_and_decode(no_documents(spark), BYTE).collect() == []
