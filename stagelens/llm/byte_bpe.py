"""Byte-level BPE over distinct words: the cut into words, their ids, and the ids' pieces."""

from __future__ import annotations

import functools
import json
import unicodedata

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from tokenizers import pre_tokenizers

from .common import SLICE_BYTES, binary_slices, pieces_array, span_hashes, text_buffer

#: Distinct words a worker remembers before it starts its memory anew.
REMEMBERED = 1 << 21

# White space of Unicode, and the endings that the cut keeps with their apostrophe.
WHITE = (*range(0x09, 0x0E), 0x20, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000)
ENDINGS = ("s", "t", "re", "ve", "m", "ll", "d")

_OTHER, _LETTER, _NUMBER, _SPACE = range(4)


@functools.lru_cache(1)
def _classes() -> np.ndarray:
    table = np.zeros(0x110000, np.uint8)
    for code in range(0x110000):
        kind = unicodedata.category(chr(code))[0]
        table[code] = _LETTER if kind == "L" else _NUMBER if kind == "N" else _OTHER
    table[list(WHITE)] = _SPACE
    # the library may know characters that this Python doesn't yet: ask it about those
    unknown = [chr(c) for c in range(0x40000) if unicodedata.category(chr(c)) == "Cn"]
    ask = pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=True)
    for before, kind in (("a", _LETTER), ("1", _NUMBER)):
        whole = {at for _, at in ask.pre_tokenize_str("".join(f"{before}{c}\n" for c in unknown))}
        table[[ord(c) for i, c in enumerate(unknown) if (3 * i, 3 * i + 2) in whole]] = kind
    return table


@functools.lru_cache(2)
def tokenizer(path: str):
    """The library's tokenizer without truncation and padding; it must be byte-level BPE with the usual cut."""
    from tokenizers import Tokenizer

    with open(path, encoding="utf-8") as file:
        spec = json.load(file)
    cut = spec["pre_tokenizer"]
    if cut["type"] != "ByteLevel" or cut["add_prefix_space"] or not cut.get("use_regex", True) or spec["normalizer"]:
        raise ValueError("not a byte-level tokenizer that cuts whole texts by its own pattern")
    if any(t["single_word"] or t["lstrip"] or t["rstrip"] for t in spec["added_tokens"]):
        raise ValueError("added tokens that depend on their surroundings cannot be encoded word by word")
    made = Tokenizer.from_file(path)
    made.no_truncation()
    made.no_padding()
    return made, tuple(t["content"].encode() for t in spec["added_tokens"])


def _marks(raw: np.ndarray, marks: tuple[bytes, ...]) -> list[tuple[int, int]]:
    data, found = raw.tobytes(), []
    for mark in marks:
        at = data.find(mark)
        while at >= 0:
            found.append((at, at + len(mark)))
            at = data.find(mark, at + len(mark))
    return sorted(found)


def cut_words(raw: np.ndarray, at: np.ndarray, marks: tuple[bytes, ...] = ()) -> tuple[np.ndarray, np.ndarray]:
    """Where words start in the bytes of texts (with the end of the last), and each text's first word.

    The cut of byte-level BPE: endings after a lone apostrophe; runs of letters,
    of numbers, or of neither, each with one space before it; runs of white
    space, whose last character goes to what follows if it is a space and
    stands alone if not. ``marks`` (strings of added tokens) are words.
    """
    if not len(raw):
        return np.zeros(1, np.int64), np.zeros(len(at), np.int64)
    edges = at
    spans = [(a, b) for a, b in _marks(raw, marks) if np.searchsorted(at, a, "right") == np.searchsorted(at, b - 1, "right")] if marks else []
    if spans:
        edges = np.unique(np.concatenate([at, np.array(spans).ravel()]))
    codes = np.frombuffer(raw.tobytes().decode("utf-8").encode("utf-32-le"), np.uint32)
    lead = np.flatnonzero((raw & 0xC0) != 0x80)
    n = len(codes)
    kind = _classes()[codes]
    fresh = np.zeros(n + 1, bool)  # first character of a text
    fresh[np.searchsorted(lead, edges)] = True
    fresh = fresh[:n]
    start = fresh.copy()
    start[1:] |= kind[1:] != kind[:-1]
    first = np.flatnonzero(start)
    last = np.append(first[1:], n)
    # white space before something
    after = first[(kind[first] != _SPACE) & ~fresh[first]]
    after = after[kind[after - 1] == _SPACE]
    start[after - 1] = True
    start[after[codes[after - 1] == 0x20]] = False
    # endings after an apostrophe that no space is before
    lone = first[(last - first == 1) & (codes[first] == ord("'"))]
    lone = lone[(lone + 1 < n) & (fresh[lone] | (codes[np.maximum(lone - 1, 0)] != 0x20))]
    lone = lone[~fresh[lone + 1]]
    if len(lone):
        padded = np.append(codes, [0, 0])
        stop = np.append(fresh, [True, True])
        one, two = padded[lone + 1], np.where(stop[lone + 2], 0, padded[lone + 2])
        size = np.zeros(len(lone), np.int64)
        for ending in ENDINGS:
            same = one == ord(ending[0])
            if len(ending) == 2:
                same &= two == ord(ending[1])
            size[same & (size == 0)] = len(ending)
        lone, size = lone[size > 0], size[size > 0]
        start[lone + 1] = False
        begins = lone + 1 + size
        start[begins[begins < n]] = True
    starts = np.append(lead[start], len(raw))
    if spans:
        inside = np.zeros(len(raw) + 1, np.int8)
        for a, b in spans:
            inside[a + 1] += 1
            inside[b] -= 1
        starts = starts[np.cumsum(inside)[starts] == 0]
    return starts, np.searchsorted(starts, at)


def _one_by_one(words: list[str], made) -> list[np.ndarray]:
    return [np.array(e.ids, "<u4") for e in made.encode_batch_fast(words, add_special_tokens=False)]


def word_ids(words: pa.Array, path: str) -> pa.Array:
    """Ids of distinct words, each as little-endian unsigned 32-bit integers, in one call of the library.

    Words go in as the lines of one text: a line break is a word and an id of
    its own between words. White space, which would run into the break, is
    encoded by itself.
    """
    made = tokenizer(path)[0]
    (line,) = _one_by_one(["\n"], made)
    alone = pc.or_(pc.utf8_is_space(words), pc.match_substring(words, "\n")).to_numpy(zero_copy_only=False)
    lines = words.filter(pa.array(~alone))
    parts: list[np.ndarray] = []
    if len(lines):
        raw, at = text_buffer(lines)
        spread = np.full(len(raw) + len(lines), ord("\n"), np.uint8)
        spread[np.arange(len(raw)) + np.repeat(np.arange(len(lines)), np.diff(at))] = raw
        ids = _one_by_one([spread.tobytes().decode("utf-8")], made)[0]
        breaks = np.flatnonzero(ids == line[0]) if len(line) == 1 else []
        if len(breaks) != len(lines):
            raise ValueError("a vocabulary in which a line break is not an id of its own")
        parts = [ids[ids != line[0]]]
        sizes_of_lines = np.diff(np.append(-1, breaks)) - 1
    single = _one_by_one(words.filter(pa.array(alone)).to_pylist(), made)
    sizes = np.zeros(len(words), np.int64)
    sizes[alone] = [len(x) for x in single]
    if len(lines):
        sizes[~alone] = sizes_of_lines
    # lines first, then the others: put each word's ids where the word stands
    order = np.concatenate([np.flatnonzero(~alone), np.flatnonzero(alone)])
    data = np.concatenate([*parts, *single, np.zeros(0, "<u4")]).astype("<u4")
    ends = np.concatenate([[0], np.cumsum(sizes[order])]) * 4
    found = pa.Array.from_buffers(pa.large_binary(), len(words), [None, pa.py_buffer(ends.astype(np.int64)), pa.py_buffer(data)])
    back = np.empty(len(words), np.int64)
    back[order] = np.arange(len(words))
    return found.take(pa.array(back))


# words and their ids; the words' hashes in order, and which word each one is
_MEMORY: dict[str, tuple[pa.Array, pa.Array, np.ndarray, np.ndarray]] = {}


def _places(words: pa.Array, own: np.ndarray, known: pa.Array, hashes: np.ndarray, holder: np.ndarray) -> np.ndarray:
    """Where in ``known`` each word is, -1 if it isn't; what has a word's hash is compared with the word."""
    at = np.full(len(words), -1, np.int64)
    by_hash = np.argsort(own)
    slot = np.searchsorted(hashes, own[by_hash])
    hit = np.flatnonzero(np.append(hashes, np.uint64(0))[slot] == own[by_hash])
    hit = hit[slot[hit] < len(hashes)]
    at[by_hash[hit]] = holder[slot[hit]]
    hit = np.flatnonzero(at >= 0)
    alike = pc.equal(known.take(pa.array(at[hit])), words.take(pa.array(hit))).to_numpy(zero_copy_only=False)
    at[hit[~alike]] = -1
    return at


def remembered_ids(words: pa.Array, path: str) -> pa.Array:
    """``word_ids`` of distinct words; a worker asks the library for those it has not met, and keeps a bounded number.

    Known words are found by hashes kept in order, as a table of them made anew for each call costs more the more are known.
    """
    words = words.cast(pa.large_string())
    nothing = (pa.array([], pa.large_string()), pa.array([], pa.large_binary()), np.zeros(0, np.uint64), np.zeros(0, np.int64))
    known, ids, hashes, holder = _MEMORY.get(path, nothing)
    raw, starts = text_buffer(words)
    own = span_hashes(raw, starts[:-1], starts[1:])
    at = _places(words, own, known, hashes, holder)
    new = at < 0
    if new.any():
        fresh = words.filter(pa.array(new))
        at[new] = np.arange(len(known), len(known) + len(fresh))
        known, ids = pa.concat_arrays([known, fresh]), pa.concat_arrays([ids, word_ids(fresh, path)])
        more = np.flatnonzero(new)
        more = more[np.argsort(own[more])]
        where = np.searchsorted(hashes, own[more])
        hashes, holder = np.insert(hashes, where, own[more]), np.insert(holder, where, at[more])
    found = ids.take(pa.array(at))
    if len(known) > REMEMBERED:
        holder = np.argsort(own)
        known, ids, hashes = words, found, own[holder]
    _MEMORY[path] = (known, ids, hashes, holder)
    return found


def coded_words(raw: np.ndarray, at: np.ndarray, path: str) -> tuple[pa.DictionaryArray, np.ndarray]:
    """All words of texts as a dictionary array, and each text's first word; texts are cut in bounded runs."""
    marks, starts, first, i, count = tokenizer(path)[1], [], [], 0, 0
    while i < len(at) - 1:
        j = max(i + 1, int(np.searchsorted(at, at[i] + SLICE_BYTES, "right")) - 1)
        cuts, firsts = cut_words(raw[at[i] : at[j]], at[i : j + 1] - at[i], marks)
        starts.append(cuts[:-1] + at[i])
        first.append(firsts[:-1] + count)
        count += len(cuts) - 1
        i = j
    whole = np.concatenate([*starts, [len(raw)]]).astype(np.int64)
    return pieces_array(raw, whole).dictionary_encode(), np.concatenate([*first, [count]]).astype(np.int64)


def encoded_texts(raw: np.ndarray, at: np.ndarray, path: str) -> tuple[np.ndarray, np.ndarray]:
    """Ids of all texts one after another, and where each text's ids start (and the last one's end)."""
    if not len(raw):
        return np.zeros(0, np.uint32), np.zeros(len(at), np.int64)
    words, first = coded_words(raw, at, path)
    data, ends = binary_slices(remembered_ids(words.dictionary, path).take(words.indices))
    return np.frombuffer(data, "<u4"), ends[first] // 4


@functools.lru_cache(2)
def piece_bytes(path: str) -> pa.Array:
    """Bytes of each id: the id-to-piece table; ids without a piece are null."""
    made, _ = tokenizer(path)
    printable = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in printable]
    byte_of = {chr(b): b for b in printable} | {chr(256 + i): b for i, b in enumerate(rest)}
    added = {i: t.content for i, t in made.get_added_tokens_decoder().items()}
    out: list[bytes | None] = []
    for i in range(made.get_vocab_size(with_added_tokens=True)):
        piece = added.get(i) or made.id_to_token(i)
        if piece is None:
            out.append(None)
        elif all(c in byte_of for c in piece):
            out.append(bytes(byte_of[c] for c in piece))
        else:
            out.append(piece.encode())
    return pa.array(out, pa.large_binary())
