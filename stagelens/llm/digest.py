"""Improbable-feature digests: rare byte windows of a document in chained Bloom filters."""

from __future__ import annotations

import base64
import hashlib
from bisect import bisect_right
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import mixed, span_hashes, stored, text_buffer, text_or_empty, text_slices

WINDOW = 64
#: A feature is kept if it is the rarest of its neighbours in this many places of WINDOW.
POPULAR = 16
FILTER_BITS = 2048
HASHES = 5
#: Features of one Bloom filter; the next one goes to a new filter.
MOST_FEATURES = 128

#: Documents are dealt into ranges of some RANGE_BYTES; so few ranges that their bounds fit everywhere.
RANGE_BYTES = 64 << 20
MOST_RANGES = 1 << 16
#: Copies of one document leave a task in runs of at most this many.
RUN = 4096

# c * log2 c of a byte's count in whole numbers, so that sums are the same in any order;
# a window's entropy is log2(WINDOW) less their sum, and a step of it 2 ** STEP of these
_LOG = np.rint(np.concatenate([[0.0], np.arange(1, WINDOW + 1) * np.log2(np.arange(1, WINDOW + 1))]) * 4096).astype(np.int32)
STEP = 13
LEVELS = (int(_LOG[WINDOW]) >> STEP) + 1


def window_levels(raw: np.ndarray) -> np.ndarray:
    """Entropy step of the window at each byte (len - WINDOW + 1 of them), counts updated as the window slides.

    What a byte changes when it joins or leaves a window follows from how often
    it occurs in the rest of the window; both counts come from comparing the
    bytes with themselves at each distance.
    """
    n = len(raw)
    if n < WINDOW:
        return np.zeros(0, np.uint8)
    earlier, later = np.zeros(n, np.uint8), np.zeros(n, np.uint8)
    for d in range(1, WINDOW):
        same = (raw[d:] == raw[:-d]).view(np.uint8)
        earlier[d:] += same
        later[:-d] += same
    gain = np.diff(_LOG)
    first = _LOG[np.bincount(raw[:WINDOW], minlength=256)].sum()
    steps = gain[earlier[WINDOW:]] - gain[later[: n - WINDOW]]
    return (np.concatenate([[first], first + np.cumsum(steps, dtype=np.int64)]) >> STEP).astype(np.uint8)


def _popular(priority: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Selected windows of each text, and the text of each; ``priority`` has one number per byte.

    Selected is the leftmost window of lowest priority value in at least
    ``POPULAR`` runs of WINDOW neighbouring windows of a text. A text with fewer
    windows, or none that popular, has its one lowest.
    """
    n = len(priority)
    kind, shift = (np.uint32, 24) if n < 1 << 24 else (np.uint64, 48)
    never = np.iinfo(kind).max
    windows = np.maximum(np.diff(at) - WINDOW + 1, 0)  # windows of each text, at its first bytes
    key = (priority.astype(kind) << kind(shift)) | np.arange(n, dtype=kind)
    some = np.flatnonzero(windows)
    for a, b in zip((at[:-1] + windows).tolist(), at[1:].tolist(), strict=True):
        key[a:b] = never
    if not len(some):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    mask = kind((1 << shift) - 1)
    lowest = (np.minimum.reduceat(key, at[some]) & mask).astype(np.int64)
    low, width = key, 1
    while width < WINDOW and width < len(low):
        low = np.minimum(low[:-width], low[width:])
        width *= 2
    popular = np.zeros(0, np.int64)
    if width == WINDOW:
        best = low & mask
        edge = np.flatnonzero(np.append(True, best[1:] != best[:-1]))
        # a run reaching into the next text is cut where its own text's runs end
        place, begin, stop = best[edge].astype(np.int64), edge, np.append(edge[1:], len(best))
        real = place < n  # runs between texts have none
        place, begin, stop = place[real], begin[real], stop[real]
        home = np.searchsorted(at, place, "right") - 1
        begin = np.maximum(begin, at[home])
        stop = np.minimum(stop, at[home] + windows[home] - WINDOW + 1)
        popular = place[(stop - begin >= POPULAR) & (place < at[home] + windows[home])]
    text = np.searchsorted(at, popular, "right") - 1
    alone = np.setdiff1d(some, text)
    chosen = np.sort(np.concatenate([popular, lowest[np.searchsorted(some, alone)]]))
    return chosen, np.searchsorted(at, chosen, "right") - 1


def features(raw: np.ndarray, at: np.ndarray, rarity: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the features of all texts, and the text of each; a text shorter than a window is one feature."""
    sizes = np.diff(at)
    if len(raw) >= WINDOW:
        levels = window_levels(raw)
        priority = np.append(rarity[levels], np.full(WINDOW - 1, LEVELS - 1, rarity.dtype))
        chosen, text = _popular(priority, at)
    else:
        chosen, text = np.zeros(0, np.int64), np.zeros(0, np.int64)
    hashes = np.zeros(len(chosen), np.uint64)
    for i in range(0, len(chosen), 1 << 14):
        windows = raw[chosen[i : i + (1 << 14), None] + np.arange(WINDOW)]
        ends = np.arange(1, len(windows) + 1) * WINDOW
        hashes[i : i + (1 << 14)] = span_hashes(windows.ravel(), ends - WINDOW, ends)
    short = np.flatnonzero((sizes > 0) & (sizes < WINDOW))
    whole = span_hashes(raw, at[short], at[short + 1]) if len(short) else np.zeros(0, np.uint64)
    hashes, text = np.concatenate([hashes, whole]), np.concatenate([text, short])
    order = np.argsort(text, kind="stable")
    return hashes[order], text[order]


def filters(hashes: np.ndarray, text: np.ndarray, n: int) -> list[tuple[np.ndarray, np.ndarray]]:
    """For each of ``n`` texts, bits of its chained Bloom filters and the number of features in each. A feature counts once."""
    order = np.lexsort((np.arange(len(hashes)), hashes, text))
    new = np.append(True, (hashes[order][1:] != hashes[order][:-1]) | (text[order][1:] != text[order][:-1]))[: len(order)]
    once = np.sort(order[new])
    hashes, text = hashes[once], text[once]
    counts = np.bincount(text, minlength=n)
    chains = -(-counts // MOST_FEATURES)
    first, base = np.cumsum(counts) - counts, np.cumsum(chains) - chains
    link = base[text] + (np.arange(len(text)) - first[text]) // MOST_FEATURES
    bits = np.zeros((int(chains.sum()), FILTER_BITS), bool)
    for j in range(HASHES):
        place = mixed(hashes + np.uint64(j * 0x9E3779B97F4A7C15 % (1 << 64))) >> np.uint64(64 - 11)
        bits[link, place.astype(np.int64)] = True
    sizes = np.bincount(link, minlength=len(bits))
    return [(bits[b : b + c], sizes[b : b + c]) for b, c in zip(base.tolist(), chains.tolist(), strict=True)]


def digests(texts: pa.Array, rarity: np.ndarray) -> list[tuple[np.ndarray, np.ndarray]]:
    """Filters of each text."""
    raw, at = text_buffer(texts)
    return filters(*features(raw, at, rarity), len(texts))


def written(bits: np.ndarray, counts: np.ndarray) -> str:
    """A digest as text: for each filter its number of features and its bits."""
    return ";".join(f"{n}:{base64.b64encode(np.packbits(b).tobytes()).decode()}" for b, n in zip(bits, counts.tolist(), strict=True))


def parsed(digest: str) -> tuple[np.ndarray, np.ndarray]:
    parts = [p.split(":") for p in digest.split(";")] if digest else []
    bits = [np.unpackbits(np.frombuffer(base64.b64decode(b), np.uint8)).astype(bool) for _, b in parts]
    return np.array(bits).reshape(-1, FILTER_BITS), np.array([int(n) for n, _ in parts], np.int64)


def likeness(one: tuple[np.ndarray, np.ndarray], other: tuple[np.ndarray, np.ndarray]) -> float:
    """0 to 1: how far the filters of the shorter digest are found in the longer, beyond overlap by chance.

    Each filter's best overlap with one of the other's counts by its features.
    Two empty digests are alike; an empty one is unlike any other.
    """
    if not len(one[1]) or not len(other[1]):
        return float(len(one[1]) == len(other[1]))
    if one[1].sum() > other[1].sum() or (one[1].sum() == other[1].sum() and len(one[1]) > len(other[1])):
        one, other = other, one
    mine, theirs = one[0].sum(1), other[0].sum(1)
    shared = one[0].astype(np.float32) @ other[0].astype(np.float32).T
    most = np.minimum(mine[:, None], theirs[None])
    chance = mine[:, None] * theirs[None] / FILTER_BITS
    score = np.clip((shared - chance) / np.maximum(most - chance, 1e-9), 0, 1).max(1)
    return float(min(1.0, (score * one[1]).sum() / one[1].sum()))


def _level_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Entropy steps of all windows of the texts, counted over a task."""
    total = np.zeros(LEVELS, np.int64)
    for batch in batches:
        for part in text_slices(batch, "text"):
            raw, at = text_buffer(part.column("text"))
            levels = window_levels(raw)
            # windows that reach into the next text are none
            inside = np.arange(WINDOW, WINDOW + len(levels)) <= np.repeat(at[1:], np.diff(at))[: len(levels)]
            total += np.bincount(levels[inside], minlength=LEVELS)
    yield pa.RecordBatch.from_arrays([pa.array(np.arange(LEVELS, dtype=np.int32)), pa.array(total)], names=["level", "n"])


def level_counts(texts: DataFrame) -> np.ndarray:
    """Windows of each entropy step over all texts; ``LEVELS`` numbers whatever the corpus."""
    counted = texts.select("text").mapInArrow(_level_counts, "level int, n long").groupBy("level").agg(F.sum("n").alias("n"))
    counts = np.zeros(LEVELS, np.int64)
    for row in counted.collect():
        counts[row["level"]] = row["n"]
    return counts


def _rarity(counts: np.ndarray) -> np.ndarray:
    rank = np.empty(LEVELS, np.uint8)
    rank[np.lexsort((np.arange(LEVELS), counts))] = np.arange(LEVELS)
    return rank


def rarity_table(texts: DataFrame) -> np.ndarray:
    """Rank of each entropy step over all texts, the rarest first."""
    return _rarity(level_counts(texts))


_DIGEST = [("n_chars", pa.int64()), ("edited_sha256", pa.string()), ("fingerprint", pa.string()), ("edited_fingerprint", pa.string()),
           ("near_edited", pa.float64()), ("near_next", pa.float64()), ("n", pa.int64())]


def _rows(doc_ids: list, texts: list[str], copies: list[int], rarity: np.ndarray) -> list[dict]:
    """Rows of all documents but the last, each followed by the next one; many copies in several runs."""
    found = digests(pa.array(texts, pa.large_string()), rarity)
    halves = [len(text) // 2 for text in texts]
    edited = [text[: len(text) - half] + follower[:half] for text, half, follower in zip(texts, halves, texts[1:], strict=False)]
    changed = digests(pa.array(edited, pa.large_string()), rarity)
    out = []
    for i, (new, other) in enumerate(zip(edited, changed, strict=True)):
        row = {
            "doc_id": doc_ids[i], "n_chars": len(texts[i]), "edited_sha256": hashlib.sha256(new.encode()).hexdigest(),
            "fingerprint": written(*found[i]), "edited_fingerprint": written(*other),
            "near_edited": likeness(found[i], other), "near_next": likeness(found[i], found[i + 1]),
        }
        out += [{**row, "n": min(RUN, copies[i] - done)} for done in range(0, copies[i], RUN)]
    return out


def _digests(rank):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rarity = rank.value
        # documents that wait for their next one, of one range: id, text, tie and number of copies
        waiting, home = [], None
        for batch in batches:
            schema = pa.schema([("doc_id", batch.schema.field("doc_id").type), *_DIGEST])
            for part in text_slices(batch, "text", 1 << 20):
                rows = []
                for row in part.to_pylist():
                    if row["home"] != home:
                        # the range before ended in its guest
                        rows += _rows(*_columns(waiting), rarity) if len(waiting) > 1 else []
                        waiting, home = [], row["home"]
                    same = waiting and not row["guest"] and _place(waiting[-1]) == _place(row)
                    if same:
                        waiting[-1]["n"] += row["n"]
                    else:
                        waiting.append(row)
                if len(waiting) > 1:
                    rows += _rows(*_columns(waiting), rarity)
                    waiting = waiting[-1:]
                yield pa.RecordBatch.from_pylist(rows, schema)

    return run


def _columns(rows: list[dict]) -> tuple[list, list[str], list[int]]:
    return [r["doc_id"] for r in rows], [r["text"] for r in rows], [r["n"] for r in rows]


def _place(row: dict) -> tuple:
    return _order(row["doc_id"]), row["_tie"]


def _order(doc_id) -> tuple:
    """Sorts as Spark does: null first, not-a-number last."""
    if doc_id is None:
        return (0,)
    return (2,) if doc_id != doc_id else (1, doc_id)


def _dealt(bounds):
    """Range of each (id, tie) and its number of copies in the batch: 0 for all but the first of them."""

    def deal(batches: Iterator[tuple[pa.Array, pa.Array]]) -> Iterator[pa.Array]:
        for doc_ids, ties in batches:
            places = [(_order(i), t) for i, t in zip(doc_ids.to_pylist(), ties.to_pylist(), strict=True)]
            first: dict[tuple, int] = {}
            copies = np.zeros(len(places), np.int64)
            for at, place in enumerate(places):
                copies[first.setdefault(place, at)] += 1
            homes = np.array([max(bisect_right(bounds.value, place) - 1, 0) for place in places], np.int32)
            yield pa.StructArray.from_arrays([pa.array(homes, pa.int32()), pa.array(copies)], names=["home", "n"])

    return deal


def fingerprints(docs: DataFrame, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """Digest of each whole text, and its likeness to an edited text's and to the next document's.

    Returns doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint,
    near_edited, near_next. The edited text has its last ``n_chars // 2`` code
    points replaced by the first as many of the next document in order of id;
    the last document's next is the first.

    Every window of ``WINDOW`` bytes has an entropy; how rare its step is over all
    texts ranks it. Windows that are the rarest of their neighbourhood often
    enough are the features, put into chained Bloom filters.

    Documents are dealt into ranges of (id, hash of the text), more ranges the more
    text there is; the first document of a range also goes, as a guest, to the
    end of the range before, so every document meets its next one inside a task.
    Ids may be of any type that sorts. Rows that share an id stand in order of a
    hash of their text, so an id that many rows have, or null, is cut like any
    other; rows that share id and text are one document here, whose row is returned
    as often, and meet before they move. A null id comes first; a null text is
    empty, with an empty fingerprint; a single document is its own next. No rows
    give no rows; other columns are ignored.
    """
    spark = docs.sparkSession
    rows = docs.select(F.col(doc_id).alias("doc_id"), text_or_empty(text).alias("text")).withColumn("_tie", F.xxhash64("text"))
    counts = level_counts(rows)
    rank = spark.sparkContext.broadcast(_rarity(counts))

    # ids and hashes only; at most MOST_RANGES of them come to the driver
    ranges = max(int(spark.conf.get("spark.sql.shuffle.partitions")), int(counts.sum()) // RANGE_BYTES, 1)
    cut = rows.select("doc_id", "_tie").distinct().repartitionByRange(min(ranges, MOST_RANGES), "doc_id", "_tie")
    cut = stored(cut.withColumn("_part", F.spark_partition_id()), "ranges")
    firsts = cut.groupBy("_part").agg(F.min(F.struct("doc_id", "_tie")).alias("first")).orderBy("_part").collect()
    if not firsts:
        return spark.createDataFrame([], _output(rows))
    starts = [(row["first"]["doc_id"], row["first"]["_tie"]) for row in firsts]
    bounds = spark.sparkContext.broadcast([(_order(i), tie) for i, tie in starts])
    # not run again behind the filter, on fewer rows
    deal = F.arrow_udf(_dealt(bounds), "home int, n long", F.ArrowUDFType.SCALAR_ITER).asNondeterministic()
    placed = rows.withColumn("_d", deal("doc_id", "_tie")).select("doc_id", "text", "_tie", "_d.home", "_d.n").filter("n > 0")

    last = len(starts) - 1
    moves = [(i, tie, home - 1 if home else last) for home, (i, tie) in enumerate(starts)]
    moves = spark.createDataFrame(moves, f"_id {dict(rows.dtypes)['doc_id']}, _t long, _to int")
    # one row a range, MOST_RANGES at most
    guest = rows.join(F.broadcast(moves), rows.doc_id.eqNullSafe(moves._id) & (rows._tie == moves._t), "inner")
    guest = guest.groupBy("_to").agg(F.min(F.struct("doc_id", "text", "_tie")).alias("g"))
    guest = guest.select("g.*", F.col("_to").alias("home"), F.lit(1).cast("long").alias("n"), F.lit(True).alias("guest"))
    dealt = placed.withColumn("guest", F.lit(False)).unionByName(guest)
    dealt = dealt.repartitionById(len(starts), F.col("home")).sortWithinPartitions("home", "guest", "doc_id", "_tie")
    found = dealt.select("doc_id", "text", "_tie", "home", "n", "guest").mapInArrow(_digests(rank), f"{_output(rows)}, n long")
    return found.withColumn("_copy", F.explode(F.sequence(F.lit(1), "n"))).drop("n", "_copy")


def _output(rows: DataFrame) -> str:
    kind = dict(rows.dtypes)["doc_id"]
    return f"doc_id {kind}, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"
