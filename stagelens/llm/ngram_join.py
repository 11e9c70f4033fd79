"""Exact set-similarity join on word n-grams: rare-first prefixes with length, positional and suffix filters."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import giving_back, components, mixed, shingle_hashes, stored, text_buffer, text_or_empty, text_slices, word_hashes

#: Size of the table of n-gram counts that orders n-grams from rare to frequent.
COUNT_BITS = 18
#: A set's n-grams are dealt into so many hash ranges for the suffix filter, which has one bit for each.
RANGES = 512
#: Size of the bit table that keeps texts without a candidate pair out of verification.
FILTER_BITS = 22


def _bucket(grams: np.ndarray, bits: int) -> np.ndarray:
    return (grams >> np.uint64(64 - bits)).astype(np.int64)


def _counts(k: int, bits: int):
    """Occurrences of n-grams by bucket, summed over a task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(1 << bits, np.int64)
        for batch in batches:
            for part in text_slices(batch, "text"):
                grams, _ = shingle_hashes(*word_hashes(*text_buffer(part.column("text"))), k)
                total += np.bincount(_bucket(grams, bits), minlength=len(total))
        at = np.flatnonzero(total)
        for i in range(0, len(at), 1 << 16):
            some = at[i : i + (1 << 16)]
            yield pa.RecordBatch.from_arrays([pa.array(some.astype(np.int32)), pa.array(total[some])], names=["bucket", "n"])

    return run


def _sets(part: pa.RecordBatch, k: int) -> Iterator[np.ndarray]:
    grams, at = shingle_hashes(*word_hashes(*text_buffer(part.column("text"))), k)
    for i in range(part.num_rows):
        yield np.unique(grams[at[i] : at[i + 1]])


def _signatures(k: int, threshold: int, bits: int, order):
    """Per document: set size, two sums that name the set, odd or even in each hash range, prefix in rare-first order."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        frequency = order.value
        for batch in batches:
            for part in text_slices(batch, "text"):
                n, names, odd, prefixes = [], [], [], []
                for grams in _sets(part, k):
                    size = len(grams)
                    n.append(size)
                    names.append((int(grams.sum().view(np.int64)), int(mixed(grams).sum().view(np.int64))) if size else (0, 0))
                    ranges = (grams & np.uint64(RANGES - 1)).astype(np.int64)
                    odd.append(np.packbits(np.bincount(ranges, minlength=RANGES) & 1).view(np.int64))
                    length = size - -(-threshold * size // 100) + 1 if size else 0
                    rank = frequency[_bucket(grams, bits)]
                    prefixes.append(grams[np.lexsort((grams, rank))[:length]].view(np.int64))
                yield pa.RecordBatch.from_arrays(
                    [part.column("doc_id"), pa.array(n, pa.int32()), pa.array([a for a, _ in names], pa.int64()),
                     pa.array([b for _, b in names], pa.int64()), pa.array(odd, pa.list_(pa.int64())),
                     pa.array(prefixes, pa.list_(pa.int64()))],
                    names=["doc_id", "n", "name_a", "name_b", "odd", "prefix"],
                )

    return run


def _wanted(table):
    """Rows whose slot is set in the bit table."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        wanted = np.unpackbits(table.value).astype(bool)
        for batch in batches:
            yield batch.filter(pa.array(wanted[batch.column("slot").to_numpy()])).select(["node", "text"])

    return run


def _similar(k: int, threshold: int):
    """Pairs of texts whose whole n-gram sets reach the threshold."""

    def sets(texts: pa.Array) -> list[np.ndarray]:
        coded = texts.dictionary_encode()
        distinct = list(_sets(pa.RecordBatch.from_arrays([coded.dictionary], names=["text"]), k))
        return [distinct[i] for i in coded.indices.to_pylist()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in text_slices(batch, "text_a"):
                keep = []
                for x, y in zip(sets(part.column("text_a")), sets(part.column("text_b")), strict=True):
                    common = len(np.intersect1d(x, y, assume_unique=True))
                    keep.append(100 * common >= threshold * (len(x) + len(y) - common))
                yield part.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))

    return run


def _least_apart(a: Column, b: Column) -> Column:
    """A lower bound on how many n-grams two sets do not share: each one changes one range from odd to even or back."""
    return sum((F.bit_count(a[i].bitwiseXOR(b[i])) for i in range(RANGES // 64)), F.lit(0))


def _need(nx: Column, ny: Column, threshold: int) -> Column:
    """N-grams that two sets of these sizes must share: t / (100 + t) of both together."""
    return F.ceil((nx + ny) * F.lit(threshold) / F.lit(100 + threshold) - F.lit(1e-9))


def _may_link(x: str, y: str, threshold: int) -> Column:
    """Length and positional filters on two prefix rows that share an n-gram."""
    nx, ny = F.col(f"{x}.n"), F.col(f"{y}.n")
    most = F.least(nx - F.col(f"{x}.pos"), ny - F.col(f"{y}.pos"))
    long_enough = F.least(nx, ny) * 100 >= F.greatest(nx, ny) * threshold
    return long_enough & (most >= _need(nx, ny, threshold))


def _suffix_filtered(pairs: DataFrame, sizes: DataFrame, threshold: int) -> DataFrame:
    """Pairs (a, b) whose sets cannot be told too far apart by their ranges."""
    left = sizes.select(F.col("node").alias("a"), F.col("n").alias("n_a"), F.col("odd").alias("odd_a"))
    right = sizes.select(F.col("node").alias("b"), F.col("n").alias("n_b"), F.col("odd").alias("odd_b"))
    room = F.col("n_a") + F.col("n_b") - 2 * _need(F.col("n_a"), F.col("n_b"), threshold)
    near = pairs.join(left, "a").join(right, "b").filter(_least_apart(F.col("odd_a"), F.col("odd_b")) <= room)
    return near.select("a", "b")


def _verified(pairs: DataFrame, texts: DataFrame, k: int, threshold: int, filter_bits: int = FILTER_BITS) -> DataFrame:
    """The pairs (a, b) whose whole sets reach the threshold.

    Only texts of pairs move. A bit table of fixed size keeps most others from
    moving; the joins decide.
    """
    spark = pairs.sparkSession
    ids = pairs.select(F.explode(F.array("a", "b")).alias("node")).distinct()
    slot = lambda c: F.shiftrightunsigned(F.xxhash64(c), 64 - filter_bits).cast("int").alias("slot")
    wanted = np.zeros(1 << filter_bits, bool)
    wanted[ids.select(slot("node")).distinct().toPandas()["slot"].to_numpy(np.int64)] = True
    table = spark.sparkContext.broadcast(np.packbits(wanted))
    some = texts.select(F.col("doc_id").alias("node"), "text", slot("doc_id")).mapInArrow(giving_back(_wanted(table)), "node long, text string")
    some = stored(some, "pair-texts")
    left = some.select(F.col("node").alias("a"), F.col("text").alias("text_a"))
    right = some.select(F.col("node").alias("b"), F.col("text").alias("text_b"))
    both = pairs.join(left, "a").join(right, "b").select("a", "b", "text_a", "text_b")
    return both.mapInArrow(giving_back(_similar(k, threshold)), "a long, b long")


def near_documents(
    docs: DataFrame, k: int = 5, threshold: int = 80, text: str = "text", doc_id: str = "doc_id", bits: int = COUNT_BITS
) -> DataFrame:
    """Groups of documents whose word n-gram sets have Jaccard similarity of ``threshold`` percent or more.

    Returns doc_id, n_shingles, component_id, one row per row of ``docs``.
    Words are ``[^\\x20\\x09-\\x0D]+`` with A-Z lower-cased; a document of fewer
    than ``k`` words is one n-gram. The groups are those of all exact links;
    n-grams are compared as 64-bit hashes.

    1. All n-grams are counted by hash bucket in a table of fixed size
       (``2 ** bits`` numbers, the only thing broadcast). It orders n-grams from
       rare to frequent; being an order for all documents is all that
       exactness asks of it.
    2. Documents with the same set become one node.
    3. Each node's prefix, its rarest ``n - ceil(t n) + 1`` n-grams, meets other
       prefixes by n-gram. First only with the node that has the n-gram
       earliest in its prefix, so that a large group of near copies links
       through few nodes; the links found there are contracted.
    4. Then prefixes of different components meet in full, under the length,
       positional and suffix filters; each pair is verified once, on its whole
       sets. Nodes already connected need no further link, so no group emits
       all its pairs.

    An empty, null or separator-only text has size 0 and links with nothing.
    Rows that share a doc_id are one node. A null doc_id links with nothing and
    has a null component. No rows give no rows; other columns are ignored.
    """
    spark = docs.sparkSession
    texts = docs.select(F.col(doc_id).cast("long").alias("doc_id"), text_or_empty(text).alias("text"))
    counted = texts.select("text").mapInArrow(giving_back(_counts(k, bits)), "bucket int, n long").groupBy("bucket").agg(F.sum("n").alias("n"))
    frequency = np.zeros(1 << bits, np.int64)
    table = counted.toPandas()  # 2 ** bits rows at most
    frequency[table["bucket"].to_numpy()] = table["n"].to_numpy()
    order = spark.sparkContext.broadcast(frequency)

    signed = stored(
        texts.mapInArrow(
            _signatures(k, threshold, bits, order),
            "doc_id long, n int, name_a long, name_b long, odd array<long>, prefix array<long>",
        ),
        "signatures",
    )
    name = ["n", "name_a", "name_b"]
    linkable = signed.filter("n > 0 and doc_id is not null")
    # stored, so that a set that very many documents share meets its class in a join that can be split
    classes = stored(linkable.groupBy(*name).agg(F.min("doc_id").alias("node")), "set-classes")
    same_set = linkable.join(classes, name).filter("doc_id <> node").select(F.col("doc_id").alias("a"), F.col("node").alias("b"))

    # only n-grams that several prefixes have can link; they are found by n-gram
    # alone, counted in the map tasks, before wider rows move
    nodes = linkable.join(classes.select(*name, F.col("node").alias("doc_id")), [*name, "doc_id"], "left_semi")
    nodes = nodes.withColumnRenamed("doc_id", "node")
    grams = nodes.select("node", "n", F.posexplode("prefix").alias("pos", "gram"))
    several = stored(grams.groupBy("gram").agg(F.count(F.lit(1)).alias("_c")).filter("_c > 1").select("gram"), "several")
    shared = stored(grams.join(several, "gram"), "shared-grams")
    sizes = nodes.select("node", "n", "odd")

    def links_of(pairs: DataFrame, label: str) -> DataFrame:
        return stored(_verified(stored(_suffix_filtered(pairs.distinct(), sizes, threshold), label), texts, k, threshold), f"{label}-links")

    hubs = shared.groupBy("gram").agg(F.min(F.struct("pos", "node", "n")).alias("y"))
    to_hub = shared.select("gram", F.struct("pos", "node", "n").alias("x")).join(hubs, "gram")
    to_hub = to_hub.filter((F.col("x.node") != F.col("y.node")) & _may_link("x", "y", threshold))
    hub_links = links_of(to_hub.select(F.least("x.node", "y.node").alias("a"), F.greatest("x.node", "y.node").alias("b")), "hub-pairs")
    groups = components(hub_links)

    labelled = shared.join(groups, "node", "left").withColumn("component", F.coalesce("component", "node"))
    mixed_grams = labelled.groupBy("gram").agg(F.min("component").alias("_low"), F.max("component").alias("_high"))
    mixed_grams = mixed_grams.filter("_low <> _high").select("gram")
    open_rows = stored(labelled.join(mixed_grams, "gram"), "open-grams")
    x, y = open_rows.alias("x"), open_rows.alias("y")
    apart = (F.col("x.gram") == F.col("y.gram")) & (F.col("x.component") < F.col("y.component"))
    rest = x.join(y, apart & _may_link("x", "y", threshold)).select(F.col("x.node").alias("a"), F.col("y.node").alias("b"))
    rest_links = links_of(rest, "rest-pairs")
    links = hub_links.unionByName(rest_links).unionByName(same_set)
    final = components(links).withColumnRenamed("node", "_node")
    sized = signed.select("doc_id", F.col("n").cast("long").alias("n_shingles"))
    return sized.join(final, sized.doc_id == F.col("_node"), "left").select(
        "doc_id", "n_shingles", F.coalesce("component", "doc_id").alias("component_id")
    )


def distinct_documents(docs: DataFrame, k: int = 5, threshold: int = 80, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """``docs`` without the documents that are near another one with a smaller id in their group; all columns are kept.

    Rows with a null id stay. Rows that share an id stand and fall together.
    """
    dropped = near_documents(docs, k, threshold, text, doc_id).filter("component_id < doc_id").select(F.col("doc_id").alias("_drop")).distinct()
    return docs.join(dropped, docs[doc_id] == dropped["_drop"], "left_anti")
