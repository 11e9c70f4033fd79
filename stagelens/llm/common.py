"""Helpers the operators of this package share: stored steps, Arrow text, word hashes, link components."""

from __future__ import annotations

import ctypes
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import scratch_path
from ..sources.tables import read_table, write_table

SLICE_BYTES = 2 << 20
LINKS_A_TASK = 1 << 19


def stored(df: DataFrame, label: str) -> DataFrame:
    """``df`` written below ``spark.checkpoint.dir`` and read back: cuts lineage, survives lost executors."""
    path = scratch_path(df.sparkSession, label)
    write_table(df, path)
    release_memory()
    return read_table(df.sparkSession, path)


def release_memory() -> None:
    """Memory that was freed goes back to the system instead of staying with the allocators of this process."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # glibc has it
    if trim:
        trim(0)


def giving_back(run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]):
    """``run`` for mapInArrow, with freed memory handed back to the system when its task ends.

    Python workers outlive a stage: what their allocators keep would count beside what the next stage needs.
    """

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            yield from run(batches)
        finally:
            release_memory()

    return task


def text_or_empty(column: str):
    return F.coalesce(F.col(column).cast("string"), F.lit(""))


def text_buffer(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes of all texts in a row, and where each one starts (and the last one ends)."""
    texts = texts.cast(pa.large_string())
    if texts.null_count:
        texts = pc.fill_null(texts, "")
    _, offsets, data = texts.buffers()
    at = np.frombuffer(offsets, np.int64)[texts.offset : texts.offset + len(texts) + 1]
    raw = np.frombuffer(data, np.uint8)[at[0] : at[-1]] if data is not None else np.zeros(0, np.uint8)
    return raw, at - at[0]


def text_slices(batch: pa.RecordBatch, column: str, limit: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """The batch in runs of rows with at most ``limit`` bytes of text, one row at least: bounds working memory."""
    if not batch.num_rows:
        return
    _, at = text_buffer(batch.column(column))
    start = 0
    while start < batch.num_rows:
        stop = max(start + 1, int(np.searchsorted(at, at[start] + limit, "right")) - 1)
        yield batch.slice(start, stop - start)
        start = stop


def pieces_array(raw: np.ndarray, starts: np.ndarray) -> pa.Array:
    """Adjoining byte pieces as an Arrow string array; ``starts`` ends with the end of the last piece."""
    return pa.Array.from_buffers(
        pa.large_string(), len(starts) - 1, [None, pa.py_buffer(np.ascontiguousarray(starts, np.int64)), pa.py_buffer(raw)]
    )


def binary_slices(values: pa.Array) -> tuple[memoryview, np.ndarray]:
    """Data and offsets of a large binary or large string array."""
    _, offsets, data = values.buffers()
    at = np.frombuffer(offsets, np.int64)[values.offset : values.offset + len(values) + 1]
    return memoryview(data if data is not None else b""), at


_SEPARATOR = np.zeros(256, bool)
_SEPARATOR[[0x20, *range(0x09, 0x0E)]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[ord("A") : ord("Z") + 1] += 32
_STEP = np.uint64(0x9E3779B97F4A7C15)
_STEP_BACK = np.uint64(pow(int(_STEP), -1, 1 << 64))
_BYTE_CODES = np.random.default_rng(20240229).integers(0, 1 << 64, 256, np.uint64, endpoint=False)


def mixed(x: np.ndarray) -> np.ndarray:
    """Bits of 64-bit numbers stirred: one-to-one, all output bits depend on all input bits."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def span_hashes(raw: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64-bit hash of the bytes in each span, from one running polynomial over the buffer."""
    n = len(raw)
    power = np.full(n + 1, _STEP)
    power[0] = 1
    np.cumprod(power, out=power)
    run = np.zeros(n + 1, np.uint64)
    np.cumsum(_BYTE_CODES[raw] * power[:-1], out=run[1:])
    back = np.full(n + 1, _STEP_BACK)
    back[0] = 1
    np.cumprod(back, out=back)
    return mixed((run[ends] - run[starts]) * back[starts] + (ends - starts).astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93))


def word_hashes(raw: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hash of every word ``[^\\x20\\x09-\\x0D]+`` with A-Z lower-cased, and where each text's words start."""
    raw = _LOWER[raw]
    inside = ~_SEPARATOR[raw]
    before, after = np.zeros(len(raw), bool), np.zeros(len(raw), bool)
    before[1:], after[:-1] = inside[:-1], inside[1:]
    edges = at[(at > 0) & (at < len(raw))]
    before[edges], after[edges - 1] = False, False
    starts, ends = np.flatnonzero(inside & ~before), np.flatnonzero(inside & ~after) + 1
    return span_hashes(raw, starts, ends), np.searchsorted(starts, at)


def shingle_hashes(words: np.ndarray, at: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Hash of every run of ``k`` words of each text (a shorter text is one run), and where each text's runs start."""
    n = np.diff(at)
    factors = mixed(np.arange(1, k + 1, dtype=np.uint64) * _STEP) | np.uint64(1)
    total = np.zeros(len(words), np.uint64)
    length = np.minimum(np.repeat(at[1:], n) - np.arange(len(words)), k)
    for j in range(min(k, len(words))):
        total[: len(words) - j] += np.where(length[: len(words) - j] > j, words[j:] * factors[j], np.uint64(0))
    keep = (length == k) | ((np.repeat(n, n) < k) & (np.arange(len(words)) == np.repeat(at[:-1], n)))
    counts = np.where(n >= k, n - k + 1, np.minimum(n, 1))
    return mixed(total[keep] + length[keep].astype(np.uint64)), np.concatenate([[0], np.cumsum(counts)])


def star_roots(n: int, left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """For nodes 0 .. n-1, the smallest node each one reaches over the links."""
    root = np.arange(n)
    while True:
        low = np.minimum(root[left], root[right])
        new = root.copy()
        np.minimum.at(new, left, low)
        np.minimum.at(new, right, low)
        np.minimum.at(new, root[left], low)
        np.minimum.at(new, root[right], low)
        new = new[new]
        if (new == root).all():
            return root
        root = new


def _contract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A task's links as stars around the smallest node of each of its components."""
    links = [[batch.column(i).to_numpy(zero_copy_only=False) for i in (0, 1)] for batch in batches]
    if not links:
        return
    a, b = (np.concatenate(side) for side in zip(*links, strict=True))
    nodes, ends = np.unique(np.concatenate([a, b]), return_inverse=True)
    root = star_roots(len(nodes), ends[: len(a)], ends[len(a) :])
    leaf = np.flatnonzero(root != np.arange(len(nodes)))
    yield pa.RecordBatch.from_arrays([pa.array(nodes[leaf]), pa.array(nodes[root[leaf]])], names=["u", "v"])


def _with_low(links: DataFrame, low: DataFrame, salts: int = 8) -> DataFrame:
    """Links with the minimum of their first end; a node with very many links is dealt over ``salts`` keys."""
    low = low.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    salted = links.withColumn("_salt", F.pmod(F.xxhash64("v"), F.lit(salts)).cast("int"))
    return salted.join(low, (salted.u == low.c) & (salted._salt == low._salt)).select("u", "v", "m")


def components(links: DataFrame) -> DataFrame:
    """(node, component) for every node of ``links`` (two long columns); component is the smallest node reached.

    Links are dealt evenly over tasks of about ``LINKS_A_TASK``, and each task
    contracts its own to stars. What one task has seen whole is done; otherwise
    large-star and small-star rounds run until all links are stars. Minima
    combine in the map tasks and no neighbour list is gathered. Every round is a
    written table, so lost executors cost one round at most. Null ends and
    loops are left out.
    """
    a, b = links.columns
    ends = stored(links.select(F.col(a).cast("long").alias("u"), F.col(b).cast("long").alias("v")).filter("u <> v"), "links")
    tasks = -(-ends.count() // LINKS_A_TASK)
    now = stored(ends.repartition(max(tasks, 1)).mapInArrow(giving_back(_contract), "u long, v long"), "links")
    mark = None
    while tasks > 1:
        new = now.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(20,0)"))).first()
        if new == mark:
            break
        mark = new
        both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy(F.col("u").alias("c")).agg(F.least(F.min("v"), F.col("c")).alias("m"))
        large = _with_low(both, low).filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        low = large.groupBy(F.col("u").alias("c")).agg(F.min("v").alias("m"))
        small = _with_low(large, low).select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u <> v")
        small = small.unionByName(low.select(F.col("c").alias("u"), F.col("m").alias("v"))).distinct()
        now = stored(small, "links")
    leaves = now.select(F.col("u").alias("node"), F.col("v").alias("component"))
    return leaves.unionByName(now.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())
