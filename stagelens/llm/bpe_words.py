"""BPE encoding and decoding through a table of distinct words, joined back by position."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .byte_bpe import coded_words, piece_bytes, word_ids
from .common import giving_back, binary_slices, text_buffer, text_or_empty, text_slices

#: Text of a block, unless one document alone has more.
BLOCK_BYTES = 16 << 20
#: Words whose ids a task holds before it sends them on.
HELD = 1 << 18
_ANSWER, _SEQUENCE = 0, 1


def _packed(numbers: np.ndarray) -> bytes:
    """Numbers as compressed 32-bit integers, all lowest bytes first, then the next ones."""
    return zstandard.compress(np.ascontiguousarray(numbers.astype("<u4").view(np.uint8).reshape(-1, 4).T).tobytes(), 3)


def _unpacked(data: bytes) -> np.ndarray:
    planes = np.frombuffer(zstandard.decompress(data), np.uint8).reshape(4, -1)
    return np.ascontiguousarray(planes.T).view("<u4").ravel()


def _framed(*parts: bytes) -> bytes:
    return b"".join(len(x).to_bytes(8, "little") + x for x in parts)


def _blocks(batches: Iterator[pa.RecordBatch], path: str) -> Iterator[tuple[int, pa.RecordBatch, pa.DictionaryArray, np.ndarray]]:
    """Runs of a task's rows: block name, ids of its documents, its words, and each document's first word.

    A block is named after its content, so that a second reading of the same
    rows gives the same blocks, and one of other rows shows. Blocks of the same
    name are the same.
    """
    held: list[pa.RecordBatch] = []

    def made():
        block = pa.Table.from_batches(held).combine_chunks().to_batches()[0]
        raw, at = text_buffer(block.column("text"))
        digest = hashlib.blake2b(repr((block.column("doc_id").to_pylist(), at.tolist())).encode(), digest_size=8)
        digest.update(raw.tobytes())
        return int.from_bytes(digest.digest(), "little", signed=True), block.select(["doc_id"]), *coded_words(raw, at, path)

    size = 0
    for batch in batches:
        for part in text_slices(batch, "text"):
            own = len(text_buffer(part.column("text"))[0])
            if held and size + own > BLOCK_BYTES:
                yield made()
                held, size = [], 0
            held.append(part)
            size += own
    if held:
        yield made()


def _word_rows(path: str):
    """(word, block, place): the distinct words of each block."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for name, _, words, _ in _blocks(batches, path):
            distinct = words.dictionary.cast(pa.string())
            for i in range(0, len(distinct), 1 << 16):
                some = distinct.slice(i, 1 << 16)
                yield pa.RecordBatch.from_arrays(
                    [some, pa.array(np.full(len(some), name, np.int64)), pa.array(np.arange(i, i + len(some), dtype=np.int32))], names=["word", "block", "place"]
                )

    return run


def _sequence_rows(path: str):
    """One row per block: ids of its documents, words in each, and every position's word."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for name, doc_ids, words, first in _blocks(batches, path):
            sink = pa.BufferOutputStream()
            with pa.ipc.new_stream(sink, doc_ids.schema) as writer:
                writer.write_batch(doc_ids)
            payload = _framed(zstandard.compress(sink.getvalue().to_pybytes(), 3), _packed(np.diff(first)), _packed(words.indices.to_numpy()))
            yield pa.RecordBatch.from_arrays(
                [pa.array([name], pa.int64()), pa.array([_SEQUENCE], pa.int32()), pa.array([payload], pa.binary())],
                names=["block", "kind", "payload"],
            )

    return run


def _answer_rows(path: str):
    """Sorted words in, each distinct word encoded once, and its ids sent to each block that has it."""

    def packed(held: list[tuple[np.ndarray, np.ndarray, pa.Array]]) -> pa.RecordBatch:
        block = np.concatenate([b for b, _, _ in held])
        place = np.concatenate([p for _, p, _ in held])
        ids = pa.concat_arrays([i for _, _, i in held])
        order = np.lexsort((place, block))
        cuts = np.flatnonzero(np.append(True, block[order][1:] != block[order][:-1]))
        names, payloads = [], []
        for a, b in zip(cuts, np.append(cuts[1:], len(order)), strict=True):
            mine = order[a:b]
            data, at = binary_slices(ids.take(pa.array(mine)))
            steps = np.diff(place[mine], prepend=0)
            names.append(block[order[a]])
            payloads.append(_framed(_packed(steps), _packed(np.diff(at) // 4), _packed(np.frombuffer(data[at[0] : at[-1]], "<u4"))))
        return pa.RecordBatch.from_arrays(
            [pa.array(names, pa.int64()), pa.array([_ANSWER] * len(names), pa.int32()), pa.array(payloads, pa.binary())],
            names=["block", "kind", "payload"],
        )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, count, last = [], 0, None
        for batch in batches:
            if not batch.num_rows:
                continue
            words = batch.column("word").dictionary_encode()
            ids = word_ids(words.dictionary.filter(pc.not_equal(words.dictionary, last[0])) if last else words.dictionary, path)
            if last and words.dictionary[0].as_py() == last[0]:
                # the last word of the batch before goes on
                ids = pa.concat_arrays([pa.array([last[1]], pa.large_binary()), ids])
            coded = ids.take(words.indices)
            last = (batch.column("word")[-1].as_py(), coded[-1].as_py())
            held.append((batch.column("block").to_numpy(), batch.column("place").to_numpy(), coded))
            count += batch.num_rows
            if count >= HELD:
                yield packed(held)
                held, count = [], 0
        if held:
            yield packed(held)

    return run


def _opened(payload: bytes) -> list[bytes]:
    data, out, at = bytes(payload), [], 0
    while at < len(data):
        size = int.from_bytes(data[at : at + 8], "little")
        out.append(data[at + 8 : at + 8 + size])
        at += 8 + size
    return out


def _joined(answers: list[list[bytes]], sequence: list[bytes]) -> tuple[pa.RecordBatch, np.ndarray, pa.Array, np.ndarray]:
    """Ids of the documents, each one's first word (and the end), the ids of each distinct word, each position's word."""
    doc_ids = pa.ipc.open_stream(zstandard.decompress(sequence[0])).read_all().combine_chunks().to_batches()
    first = np.concatenate([[0], np.cumsum(_unpacked(sequence[1]).astype(np.int64))])
    order = _unpacked(sequence[2])
    none = [np.zeros(0, np.uint32)]
    place = np.concatenate([np.cumsum(_unpacked(a[0]).astype(np.int64)) for a in answers] + none).astype(np.int64)
    sizes = np.concatenate([_unpacked(a[1]) for a in answers] + none).astype(np.int64)
    data = np.concatenate([_unpacked(a[2]) for a in answers] + none).astype(np.uint32)
    at = np.concatenate([[0], np.cumsum(sizes)])
    ids = pa.ListArray.from_arrays(pa.array(at, pa.int32()), pa.array(data))
    wanted = int(order.max()) + 1 if len(order) else 0
    back = np.full(wanted, -1, np.int64)
    back[place] = np.arange(len(place))
    if (back < 0).any():
        raise ValueError("the documents read for their words were not the documents read for their order; store them first")
    return doc_ids[0], first, ids.take(pa.array(back)), order


def _joined_strings(ids: pa.Array, table: pa.Array, order: np.ndarray) -> tuple[memoryview, np.ndarray]:
    """Each word's ids replaced by their strings of ``table``, then strung together by position: data, and where each position starts."""
    strings = table.take(ids.flatten())
    _, at = binary_slices(strings)
    ends = at[np.frombuffer(ids.buffers()[1], np.int32)[ids.offset : ids.offset + len(ids) + 1]]
    data, _ = binary_slices(strings)
    words = pa.Array.from_buffers(pa.large_binary(), len(ids), [None, pa.py_buffer(np.ascontiguousarray(ends)), pa.py_buffer(data)])
    return binary_slices(words.take(pa.array(order)))


def _digests(path: str):
    """Blocks with their answers in, one row per document out."""

    def rows(answers: list[list[bytes]], sequence: list[bytes]) -> pa.RecordBatch:
        doc_ids, first, ids, order = _joined(answers, sequence)
        pieces = piece_bytes(path)
        numbers = pa.array([f"{i},".encode() for i in range(len(pieces))], pa.large_binary())
        tokens = np.concatenate([[0], np.cumsum(pc.list_value_length(ids).to_numpy()[order])])[first]
        out = []
        for table, cut in ((numbers, 1), (pieces, 0)):
            data, at = _joined_strings(ids, table, order)
            if not cut:
                try:
                    str(data[at[0] : at[-1]], "utf-8")
                    whole = True
                except UnicodeDecodeError:
                    whole = False
            at = at[first] if len(order) else np.zeros(len(first), np.int64)
            digests = []
            for a, b in zip(at[:-1].tolist(), at[1:].tolist(), strict=True):
                part = data[a : max(a, b - cut)]
                # bytes that are no text become replacement characters, as the library has it
                digests.append(hashlib.sha256(part if cut or whole else bytes(part).decode("utf-8", "replace").encode()).hexdigest())
            out.append(pa.array(digests, pa.string()))
        return pa.RecordBatch.from_arrays(
            [doc_ids.column(0), pa.array(np.diff(tokens)), *out], names=["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"]
        )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block, answers = None, []
        for batch in batches:
            for name, kind, payload in zip(*(batch.column(c) for c in ("block", "kind", "payload")), strict=True):
                if name.as_py() != block:
                    block, answers = name.as_py(), []
                if kind.as_py() == _ANSWER:
                    answers.append(_opened(payload.as_buffer()))
                else:
                    yield rows(answers, _opened(payload.as_buffer()))

    return run


def encode_and_decode(docs: DataFrame, vocabulary: str, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """Byte-level BPE ids of whole texts and what they decode to: doc_id, n_tokens, ids_sha256, decoded_sha256.

    1. Each task cuts its texts into words, in blocks of about ``BLOCK_BYTES``, and
       sends out each block's distinct words.
    2. Words meet by word: each distinct word is encoded once, by one task, and
       its ids go back to the blocks that have it. A frequent word has one row
       for each block, not for each place.
    3. A block's sequence of words, cut again from the same rows, meets its
       words' ids; ids are put in by position, and decoded through the table
       that has each id's piece.

    Texts never move, only words and positions. ``docs`` must read the same both
    times: a table, not a sample or a random split; a block that reads
    otherwise raises. ``vocabulary`` is a path that every executor has. A null
    text counts as empty: no ids, empty texts. Null or repeated ids are kept; no
    rows give no rows; other columns are ignored.
    """
    rows = docs.select(F.col(doc_id).alias("doc_id"), text_or_empty(text).alias("text"))
    kind = dict(rows.dtypes)["doc_id"]
    words = rows.mapInArrow(giving_back(_word_rows(vocabulary)), "word string, block long, place int")
    by_word = words.repartition("word").sortWithinPartitions("word")
    answers = by_word.mapInArrow(giving_back(_answer_rows(vocabulary)), "block long, kind int, payload binary")
    sequences = rows.mapInArrow(giving_back(_sequence_rows(vocabulary)), "block long, kind int, payload binary")
    blocks = answers.unionByName(sequences).repartition("block").sortWithinPartitions("block", "kind")
    return blocks.mapInArrow(giving_back(_digests(vocabulary)), f"doc_id {kind}, n_tokens long, ids_sha256 string, decoded_sha256 string")
