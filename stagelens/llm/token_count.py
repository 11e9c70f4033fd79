"""Token counts of a piece vocabulary by rank-synchronous merging of whole batches."""

from __future__ import annotations

import functools
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import pieces_array, text_buffer, text_or_empty, text_slices

SPACE = "▁"
NEVER = np.int64(1) << 62
#: The lowest rank of a sequence is the least of those of its runs of so many symbols; a merge looks only at the runs it changes.
RUN = 512
#: Pre-tokens are merged in groups of so many code points, or of one that has more.
GROUP = 1 << 19
#: Distinct pre-tokens a worker remembers before it starts its memory anew.
REMEMBERED = 400_000


@dataclass(frozen=True)
class PieceTable:
    """Merges of a piece vocabulary: two symbols merge if their text is a piece, best score first."""

    symbol_of: np.ndarray  # code point -> symbol, -1 where no piece has it
    weight: np.ndarray  # tokens a symbol ends as: one, or its bytes where it is no piece
    pairs: np.ndarray  # sorted left * n + right
    merged: np.ndarray
    rank: np.ndarray
    neighbours: np.ndarray  # sorted left * n + right of characters that stand side by side in some piece

    def find(self, left: np.ndarray, right: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Rank and merged symbol of pairs, rank ``NEVER`` where they don't merge. Symbols below 0 merge with nothing."""
        key = left * np.int64(len(self.weight)) + right
        at = np.minimum(np.searchsorted(self.pairs, key), len(self.pairs) - 1)
        hit = (self.pairs[at] == key) & (left >= 0) & (right >= 0)
        return np.where(hit, self.rank[at], NEVER), self.merged[at]


@functools.lru_cache(2)
def piece_table(model: str) -> PieceTable:
    """Merges of a sentencepiece BPE model with byte fallback and no text normalisation."""
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_file=model)
    plain = [
        i for i in range(sp.get_piece_size())
        if not (sp.is_control(i) or sp.is_unknown(i) or sp.is_byte(i) or sp.is_unused(i))
    ]
    names = [sp.id_to_piece(i) for i in plain]
    if any(SPACE in name.lstrip(SPACE) or (name[:2] == SPACE * 2 and name.strip(SPACE)) for name in names):
        raise ValueError("pieces that go on after a space mark cannot be counted word by word")
    order = {score: r for r, score in enumerate(sorted({sp.get_score(i) for i in plain}, reverse=True))}
    rank_of = {name: order[sp.get_score(i)] for name, i in zip(names, plain, strict=True)}
    symbols = {name: s for s, name in enumerate([*names, *sorted({c for name in names for c in name} - set(names))])}
    pairs = {}
    for name in names:
        for cut in range(1, len(name)):
            left, right = symbols.get(name[:cut]), symbols.get(name[cut:])
            if left is not None and right is not None:
                pairs[left * len(symbols) + right] = (symbols[name], rank_of[name])
    keys = np.array(sorted(pairs), np.int64)
    symbol_of = np.full(0x110000, -1, np.int64)
    for name, s in symbols.items():
        if len(name) == 1:
            symbol_of[ord(name)] = s
    weight = np.array([1 if name in rank_of else len(name.encode()) for name in symbols], np.int64)
    return PieceTable(
        symbol_of, weight, keys, np.array([pairs[k][0] for k in keys.tolist()], np.int64),
        np.array([pairs[k][1] for k in keys.tolist()], np.int64),
        np.array(sorted({symbols[a] * len(symbols) + symbols[b] for name in names for a, b in zip(name, name[1:], strict=False)}), np.int64),
    )


def _byte_length(codes: np.ndarray) -> np.ndarray:
    return 1 + (codes >= 0x80) + (codes >= 0x800) + (codes >= 0x10000)


def merged_counts(codes: np.ndarray, starts: np.ndarray, table: PieceTable) -> np.ndarray:
    """Tokens of each sequence; ``codes`` are the code points of all of them, ``starts`` ends with their number.

    All sequences advance together. A round finds each sequence's leftmost pair
    of lowest rank with two reductions over ragged arrays, one over the runs of
    symbols that the last round changed and one over the runs of each sequence,
    merges it, and looks up the two pairs this makes. Sequences without a pair
    to merge leave. Characters that no piece has side by side part a sequence
    beforehand; what is left whole takes a round for each of its merges.
    """
    symbol = table.symbol_of[codes]
    weight = np.where(symbol >= 0, table.weight[np.maximum(symbol, 0)], _byte_length(codes))
    n = len(codes)
    if not n:
        return np.zeros(len(starts) - 1, np.int64)
    # no merge crosses two characters that no piece has side by side: what they part are sequences of their own
    side = symbol[:-1] * np.int64(len(table.weight)) + symbol[1:]
    near = np.minimum(np.searchsorted(table.neighbours, side), len(table.neighbours) - 1)
    parted = (table.neighbours[near] != side) | (symbol[:-1] < 0) | (symbol[1:] < 0)
    counted, starts = starts, np.union1d(starts, np.flatnonzero(parted) + 1)
    last = np.zeros(n, bool)
    last[starts[1:] - 1] = True
    first = np.zeros(n, bool)
    first[starts[:-1]] = True
    following = np.where(last, -1, np.arange(1, n + 1))
    before = np.where(first, -1, np.arange(-1, n - 1))
    rank, into = np.full(n, NEVER), np.zeros(n, np.int64)
    rank[:-1], into[:-1] = table.find(symbol[:-1], symbol[1:])
    rank[last] = NEVER
    slot = np.arange(n)
    size = np.int64(n)
    key = np.where(rank < NEVER, rank * size + slot, NEVER)
    lengths = np.diff(starts)
    runs = -(-lengths // RUN)
    first_run = np.concatenate([[0], np.cumsum(runs)])
    place = np.arange(first_run[-1]) - np.repeat(first_run[:-1], runs)
    run_begin = np.repeat(starts[:-1], runs) + place * RUN
    run_bounds = np.stack([run_begin, np.append(run_begin[1:], n)], 1)
    # the last one stands for what comes after the end of the arrays
    key, lowest = np.append(key, NEVER), np.full(len(place) + 1, NEVER)
    lowest[:-1] = np.minimum.reduceat(key, run_bounds.ravel())[::2]
    bounds, changed = np.stack([first_run[:-1], first_run[1:]], 1), np.zeros(len(place), bool)
    open_run = first_run[:-1]
    while True:
        best = np.minimum.reduceat(lowest, bounds.ravel())[::2]
        open_ = best < NEVER
        bounds, open_run, at = bounds[open_], open_run[open_], best[open_] % size
        if not len(at):
            break
        gone = following[at]
        symbol[at], weight[at], weight[gone] = into[at], table.weight[into[at]], 0
        key[gone] = NEVER
        after = following[gone]
        following[at] = after
        has = after >= 0
        before[after[has]] = at[has]
        for left, right, there in ((at, after, has), (before[at], at, before[at] >= 0)):
            left, right, lone = left[there], right[there], left[~there]
            rank, new = table.find(symbol[left], symbol[right])
            into[left] = new
            key[left] = np.where(rank < NEVER, rank * size + left, NEVER)
            if there is has:
                key[lone] = NEVER
        # the pairs before, at and after the merge have changed
        for slots in (at, gone, np.where(before[at] >= 0, before[at], at)):
            changed[open_run + (slots - run_begin[open_run]) // RUN] = True
        redo = np.flatnonzero(changed)
        changed[redo] = False
        lowest[redo] = np.minimum.reduceat(key, run_bounds[redo].ravel())[::2]
    return np.add.reduceat(weight, counted[:-1])


def _counts_of(words: pa.Array, table: PieceTable, known: dict[str, int]) -> np.ndarray:
    names = words.to_pylist()
    new = [w for w in names if w not in known]
    if len(known) + len(new) > REMEMBERED:
        known.clear()
        new = names
    ends = np.concatenate([[0], np.cumsum(np.fromiter(map(len, new), np.int64, len(new)))])
    start = 0
    while start < len(new):
        stop = max(start + 1, int(np.searchsorted(ends, ends[start] + GROUP, "right")) - 1)
        codes = np.frombuffer("".join(new[start:stop]).encode("utf-32-le"), np.uint32)
        known.update(zip(new[start:stop], merged_counts(codes, ends[start : stop + 1] - ends[start], table).tolist(), strict=True))
        start = stop
    return np.fromiter(map(known.__getitem__, names), np.int64, len(names))


def _count(model: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table, known = piece_table(model), {}
        for batch in batches:
            for part in text_slices(batch, "text"):
                texts = part.column("text")
                sizes = np.diff(text_buffer(texts)[1])
                # one space mark goes before a text that isn't empty; spaces and space marks are one symbol
                marked = pc.replace_substring(pc.binary_join_element_wise(" ", texts, ""), SPACE, " ")
                raw, at = text_buffer(marked)
                space = raw == 0x20
                opens = space.copy()
                opens[1:] &= ~space[:-1]
                opens[at[:-1]] = True
                starts = np.append(np.flatnonzero(opens), len(raw))
                coded = pieces_array(raw, starts).dictionary_encode()
                # the mark itself takes the place of the space
                words = pc.replace_substring(coded.dictionary, " ", SPACE)
                counts = _counts_of(words, table, known)[coded.indices.to_numpy()]
                tokens = np.add.reduceat(counts, np.searchsorted(starts, at[:-1]))
                yield pa.RecordBatch.from_arrays(
                    [part.column("doc_id"), pa.array(sizes), pa.array(np.where(sizes, tokens, 0))], names=["doc_id", "n_bytes", "n_tokens"]
                )

    return run


def count_tokens(docs: DataFrame, model: str, limit: int = 4096, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """Tokens of each whole text under a sentencepiece BPE model with byte fallback.

    Returns doc_id, n_bytes, n_tokens and over_limit, one row per row of
    ``docs``. ``model`` is a path that every executor has. The counts are those
    of the library's default encoding, without begin or end marks.

    A batch's texts are cut before each run of spaces, which no piece crosses;
    distinct pre-tokens are merged together (``merged_counts``) and each worker
    remembers a bounded number of counts. There is no shuffle.

    A null text counts as empty: 0 bytes, 0 tokens. Very long texts and very
    long words are counted whole. Ids may be null or repeat; no rows give no
    rows; other columns are ignored.
    """
    rows = docs.select(F.col(doc_id).alias("doc_id"), text_or_empty(text).alias("text"))
    kind = rows.schema["doc_id"].dataType.simpleString()
    counted = rows.mapInArrow(_count(model), f"doc_id {kind}, n_bytes long, n_tokens long")
    return counted.withColumn("over_limit", F.col("n_tokens") > limit)
