"""Token ids in shards compressed by Re-Pair: a grammar of id pairs, with expansion lengths for random access."""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..session import scratch_path
from .byte_bpe import encoded_texts, tokenizer
from .common import mixed, text_buffer, text_or_empty, text_slices

END_ID = 0
#: Ids of a block, unless one document alone has more.
BLOCK_IDS = 1 << 20
#: Text whose distinct words are encoded together.
ENCODED_BYTES = 12 << 20
#: A pair with so many places is replaced; rounds go on until no pair has them.
FEWEST = 2
#: Every so many symbols of a block, the position of the next id is stored.
ANCHOR = 256

_STIR = np.uint64(0x9E3779B97F4A7C15)

FORMAT = (
    "shard int, block int, before long, n_ids long, doc_ids array<{doc_id}>, lengths array<int>, terminals int, "
    "rules binary, expansion binary, symbols binary, anchors binary"
)


def _pairs_in_order(key: np.ndarray, at: np.ndarray, bits: int, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Sorted keys, ``bits`` a symbol, of the pairs that start at ``at`` in ``size`` symbols, and where each one starts."""
    low = size.bit_length()
    if 2 * bits + low > 64:
        order = np.argsort(key, kind="stable")
        return key[order], at[order]
    # sorted with their places in the low bits, which is faster than sorting places
    key = (key << np.uint64(low)) | at.view(np.uint64)
    key.sort()
    place = (key & np.uint64((1 << low) - 1)).view(np.int64)
    key >>= np.uint64(low)
    return key, place


def _may_be_often(key: np.ndarray, known: np.ndarray, fewest: int) -> np.ndarray:
    """Is a pair possibly one with ``fewest`` places or a rule? Told by counts of hashes, so some others pass too."""
    shift = np.uint64(64 - max(len(key).bit_length(), 8))
    slot = ((key * _STIR) >> shift).view(np.int64)
    counts = np.bincount(slot, minlength=1 << (64 - int(shift)))
    counts[((known * _STIR) >> shift).view(np.int64)] = fewest
    return (counts >= fewest)[slot]


def compress(ids: np.ndarray, fewest: int = FEWEST) -> tuple[int, np.ndarray, np.ndarray]:
    """Terminals, rules (one pair a nonterminal) and the symbols left, where no pair has ``fewest`` places that do not overlap.

    A round counts all adjacent pairs exactly and replaces each pair with enough
    places where it comes before both pairs it overlaps in order of frequency, so
    the most frequent one goes everywhere and rounds end. A pair has one rule:
    places it lost to others and still has in a later round take the same
    nonterminal. Rules only use earlier symbols.
    """
    terminals = top = int(ids.max()) + 1 if len(ids) else 1
    symbols, rules = ids.astype(np.uint32), [np.zeros((0, 2), np.int64)]
    known, named = np.zeros(0, np.uint64), np.zeros(0, np.int64)  # pairs with a rule, in order, and their nonterminals
    # where a pair starts that can still be replaced: only pairs with a symbol written in the last round ever get more places
    live = np.ones(len(symbols), bool)
    rare = False  # were many of the last round's places of pairs that are not replaced?
    while True:
        live[-1:] = False
        at = np.flatnonzero(live)
        left, right = symbols[at], symbols[at + 1]
        same = np.flatnonzero(left == right)
        if len(same):
            # in a run of one symbol every other place overlaps the one before
            run = at[same]
            starts = np.where(np.diff(run, prepend=-2) > 1, np.arange(len(run)), 0)
            lost = same[(run - run[np.maximum.accumulate(starts)]) % 2 == 1]
            if len(lost):
                kept = np.ones(len(at), bool)
                kept[lost] = False
                kept = np.flatnonzero(kept)
                at, left, right = at[kept], left[kept], right[kept]
        if len(at) < fewest:
            break
        bits = (top - 1).bit_length()
        key = left.astype(np.uint64)
        key <<= np.uint64(32)
        key |= right
        if rare and len(at) > len(known):
            kept = _may_be_often(key, known, fewest)
            live[at[np.flatnonzero(~kept)]] = False
            kept = np.flatnonzero(kept)
            at, key = at[kept], key[kept]
            if not len(at):
                break
        if bits < 32:
            key = ((key >> np.uint64(32)) << np.uint64(bits)) | (key & np.uint64(0xFFFFFFFF))
        key, place = _pairs_in_order(key, at, bits, len(symbols))
        first = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))
        counts = np.diff(first, append=len(key))
        pairs = key[first]
        pairs = ((pairs >> np.uint64(bits)) << np.uint64(32)) | (pairs & np.uint64((1 << bits) - 1))
        slot = np.searchsorted(known, pairs)
        has_rule = np.append(known, np.uint64(0))[slot] == pairs if len(known) else np.zeros(len(pairs), bool)
        often = (counts >= fewest) | has_rule
        if not often.any():
            break
        kept = np.repeat(often, counts)
        live[place[np.flatnonzero(~kept)]] = False
        place = place[np.flatnonzero(kept)]
        rare = rare or 5 * len(place) < 4 * len(kept)
        pairs, counts, slot, has_rule = pairs[often], counts[often], slot[often], has_rule[often]
        # ties in order of a hash, so that a long passage is halved in a few rounds
        order = np.argsort((mixed(pairs) >> np.uint64(32)).astype(np.int64) - (counts << 32))
        rank_of = np.empty(len(pairs), np.int32)
        rank_of[order] = np.arange(len(pairs))
        own = np.repeat(rank_of, counts)
        rank = np.full(len(symbols) + 1, len(pairs), np.int32)
        rank[place + 1] = own
        # compared in order of place: reading ranks at scattered places costs more
        place = np.flatnonzero((rank[1:-1] < rank[:-2]) & (rank[1:-1] < rank[2:]))
        own = rank[place + 1]
        uses = np.bincount(own, minlength=len(pairs))
        used = uses >= np.where(has_rule[order], 1, fewest)
        place, own = place[used[own]], own[used[own]]
        again, fresh = used & has_rule[order], used & ~has_rule[order]
        name = top + np.cumsum(fresh) - 1
        name[again] = named[slot[order[again]]]
        symbols[place] = name[own]
        new = pairs[order[fresh]]
        rules.append(np.stack([new >> np.uint64(32), new & np.uint64(0xFFFFFFFF)], 1).astype(np.int64))
        touched = place
        if again.any():
            written = np.zeros(top + len(new), bool)
            written[name[again]] = True
            touched = np.concatenate([place, np.flatnonzero(written.take(symbols))])
        live[touched] = live[np.maximum(touched - 1, 0)] = True
        top += len(new)
        by_pair = np.argsort(new)
        at = np.searchsorted(known, new[by_pair])
        known, named = np.insert(known, at, new[by_pair]), np.insert(named, at, name[fresh][by_pair])
        kept = np.ones(len(symbols), bool)
        kept[place + 1] = False
        if 8 * len(place) > len(symbols):
            kept = np.flatnonzero(kept)  # faster than a mask where many symbols go
        symbols, live = symbols[kept], live[kept]
    return terminals, np.concatenate(rules), symbols


def expansion_lengths(terminals: int, rules: np.ndarray) -> np.ndarray:
    """Ids each nonterminal stands for."""
    size = np.concatenate([np.ones(terminals, np.int64), np.zeros(len(rules), np.int64)])
    open_ = np.arange(len(rules))
    for _ in range(64):
        # rules of one round stand on those of earlier rounds, so few passes settle them
        both = size[rules[open_]]
        done = both.all(1)
        size[terminals + open_[done]] = both[done].sum(1)
        open_ = open_[~done]
        if not len(open_):
            return size[terminals:]
    sizes = size.tolist()
    for i in open_.tolist():
        a, b = rules[i].tolist()
        sizes[terminals + i] = sizes[a] + sizes[b]
    return np.array(sizes[terminals:], np.int64)


def expand(symbols: np.ndarray, terminals: int, rules: np.ndarray, sizes: np.ndarray | None = None) -> np.ndarray:
    """The ids that symbols stand for; ``sizes`` are the expansion lengths, where they are known."""
    sizes = expansion_lengths(terminals, rules) if sizes is None else sizes
    symbols, rules = symbols.astype(np.int64), rules.astype(np.uint32)
    width = np.ones(len(symbols), np.int64)
    held = np.flatnonzero(symbols >= terminals)
    width[held] = sizes[symbols[held] - terminals]
    at = np.cumsum(width) - width
    out = np.empty(int(width.sum()), np.uint32)
    out[at] = symbols
    open_, at = symbols[held] - terminals, at[held]
    while len(open_):
        # every nonterminal writes its two symbols where their ids start
        left, right = rules[open_, 0], rules[open_, 1]
        again = left >= terminals
        step = np.ones(len(left), np.int64)
        step[again] = sizes[left[again] - np.uint32(terminals)]
        out[at], out[at + step] = left, right
        more = right >= terminals
        open_ = np.concatenate([left[again], right[more]]).astype(np.int64) - terminals
        at = np.concatenate([at[again], (at + step)[more]])
    return out


def _numbers(data: bytes) -> np.ndarray:
    return np.frombuffer(data, "<u4").astype(np.int64)


def read_range(block: dict, start: int, stop: int) -> np.ndarray:
    """Ids ``start .. stop - 1`` of a block, expanding only the symbols that hold them."""
    rules, sizes = _numbers(block["rules"]).reshape(-1, 2), _numbers(block["expansion"])
    symbols, terminals = np.frombuffer(block["symbols"], "<u4"), block["terminals"]
    anchors = _numbers(block["anchors"])
    first = max(int(np.searchsorted(anchors, start, "right")) - 1, 0)
    last = int(np.searchsorted(anchors, stop, "left"))
    some = symbols[first * ANCHOR : last * ANCHOR].astype(np.int64)
    widths = np.concatenate([np.ones(terminals, np.int64), sizes])[some] if len(some) else some
    ends = (anchors[first] if len(anchors) else 0) + np.cumsum(widths)
    held = (ends > start) & (ends - widths < stop)
    begin = int((ends - widths)[held][0]) if held.any() else start
    return expand(some[held], terminals, rules, sizes)[start - begin : stop - begin]


def _block(shard: int, number: int, before: int, doc_ids: list, parts: list[np.ndarray]) -> dict:
    ids = np.concatenate(parts) if parts else np.zeros(0, np.uint32)
    terminals, rules, symbols = compress(ids)
    sizes = expansion_lengths(terminals, rules)
    widths = np.concatenate([np.ones(terminals, np.int64), sizes])[symbols]
    anchors = (np.cumsum(widths) - widths)[::ANCHOR]
    return {
        "shard": shard, "block": number, "before": before, "n_ids": len(ids), "doc_ids": doc_ids, "lengths": [len(p) for p in parts], "terminals": terminals,
        "rules": rules.astype("<u4").tobytes(), "expansion": sizes.astype("<u4").tobytes(),
        "symbols": symbols.astype("<u4").tobytes(), "anchors": anchors.astype("<u4").tobytes(),
    }


def _schema(doc_id: pa.DataType) -> pa.Schema:
    return pa.schema(
        [("shard", pa.int32()), ("block", pa.int32()), ("before", pa.int64()), ("n_ids", pa.int64()), ("doc_ids", pa.list_(doc_id)), ("lengths", pa.list_(pa.int32())),
         ("terminals", pa.int32()), ("rules", pa.binary()), ("expansion", pa.binary()), ("symbols", pa.binary()), ("anchors", pa.binary())]
    )


def _write_blocks(path: str, end: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shard, number, before, held, doc_ids, parts, kind = TaskContext.get().partitionId(), 0, 0, 0, [], [], None
        tail = np.array([end], np.uint32)
        for batch in batches:
            kind = kind or _schema(batch.schema.field("doc_id").type)
            for part in text_slices(batch, "text", ENCODED_BYTES):
                ids, at = encoded_texts(*text_buffer(part.column("text")), path)
                for i, name in enumerate(part.column("doc_id").to_pylist()):
                    one = np.concatenate([ids[at[i] : at[i + 1]], tail])
                    if parts and held + len(one) > BLOCK_IDS:
                        yield pa.RecordBatch.from_pylist([_block(shard, number, before, doc_ids, parts)], kind)
                        number, before, held, doc_ids, parts = number + 1, before + held, 0, [], []
                    doc_ids.append(name)
                    parts.append(one)
                    held += len(one)
        if parts:
            yield pa.RecordBatch.from_pylist([_block(shard, number, before, doc_ids, parts)], kind)

    return run


def write_token_shards(docs: DataFrame, path: str, vocabulary: str, text: str = "text", doc_id: str = "doc_id", end: int = END_ID) -> None:
    """Ids of whole texts, each text ended by ``end``, in ascending order of id, as a table of Re-Pair blocks.

    Shards are ranges of ids: shard numbers, blocks in a shard and documents in
    a block all ascend. A block holds whole documents, about ``BLOCK_IDS`` ids; it
    has its own grammar: ``terminals`` (symbols below are ids), ``rules`` (two
    symbols for each nonterminal), ``expansion`` (ids each one stands for),
    ``symbols``, and ``anchors`` (position of the first id of every
    ``ANCHOR``-th symbol), all as little-endian unsigned 32-bit numbers.

    A null text is empty; null ids come first; rows that share an id stand
    side by side in order of a hash of their text; no rows give an empty table.
    """
    rows = docs.select(F.col(doc_id).alias("doc_id"), text_or_empty(text).alias("text")).withColumn("_tie", F.xxhash64("text"))
    ordered = rows.repartitionByRange("doc_id", "_tie").sortWithinPartitions("doc_id", "_tie").drop("_tie")
    tokenizer(vocabulary)
    made = ordered.mapInArrow(_write_blocks(vocabulary, end), FORMAT.format(doc_id=dict(rows.dtypes)["doc_id"]))
    made.write.mode("overwrite").option("compression", "zstd").parquet(path)


def _read_blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for i in range(batch.num_rows):
            row = batch.slice(i, 1)
            one = {name: row.column(name)[0].as_py() for name in ("terminals", "rules", "expansion", "symbols", "lengths", "_start")}
            rules, sizes = _numbers(one["rules"]).reshape(-1, 2), _numbers(one["expansion"])
            ids = expand(np.frombuffer(one["symbols"], "<u4"), one["terminals"], rules, sizes).astype("<u4")
            ends = np.cumsum(one["lengths"])
            starts = ends - one["lengths"]
            view = memoryview(ids.tobytes())
            sums = [zlib.crc32(view[4 * a : 4 * b]) for a, b in zip(starts.tolist(), ends.tolist(), strict=True)]
            yield pa.RecordBatch.from_arrays(
                [row.column("doc_ids").flatten(), pa.array(starts + one["_start"]), pa.array(ends - starts), pa.array(sums, pa.int64())],
                names=["doc_id", "start", "n_tokens", "ids_crc32"],
            )


def read_token_shards(spark: SparkSession, path: str) -> DataFrame:
    """doc_id, start, n_tokens and ids_crc32 of every document, from the ids read back out of the files.

    ``start`` counts the ids of all documents before: those before the block in its
    shard, which the block knows, and those of earlier shards.
    """
    blocks = spark.read.parquet(path)
    before = Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)
    shards = blocks.groupBy("shard").agg(F.sum("n_ids").alias("_n"))
    shards = shards.select("shard", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_shard"))
    kind = blocks.schema["doc_ids"].dataType.elementType.simpleString()
    # one row a shard, and a shard is a task of the writer
    needed = blocks.join(F.broadcast(shards), "shard").select(
        "doc_ids", "lengths", "terminals", "rules", "expansion", "symbols", (F.col("before") + F.col("_shard")).alias("_start")
    )
    return needed.mapInArrow(_read_blocks, f"doc_id {kind}, start long, n_tokens long, ids_crc32 long")


def stored_tokens(docs: DataFrame, vocabulary: str, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """The shards written below ``spark.checkpoint.dir`` and read back."""
    path = scratch_path(docs.sparkSession, "token-shards")
    write_token_shards(docs, path, vocabulary, text, doc_id)
    return read_token_shards(docs.sparkSession, path)
