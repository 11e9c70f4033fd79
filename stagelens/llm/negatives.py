"""Hard negatives by inner product: length buckets, sorted coordinate lists and feasible ranges before exact scores."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..operators.ordering import with_position
from .common import stored

SCALE = 256
EVERY = 100
POSITIVES, NEGATIVES = 5, 10
LEAST_PERCENT, MOST_PERCENT = 30, 90
#: Entries of the vectors in a block of rows, and anchors in a block of anchors.
BLOCK, ANCHORS = 1 << 19, 2048
MOST_TASKS = 20_000
#: Coordinates of an anchor whose feasible ranges are intersected.
FOCUS = 5
#: A length bucket ends where vectors are this much shorter than its longest one.
SHORTER = 0.9
#: Room for rounding in normalised coordinates; scores decide.
SLACK = 1e-5
#: Scaled entries are smaller; scores of up to 32,768 of them then fit a long.
BEYOND = 1 << 24
ANY = (1 << 63) - 1


def _whole(scale: float):
    """Rows (vec_id, label, dim, length2, vec) of the usable vectors: floor(scale*x) as 32-bit numbers."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            vectors = batch.column("vector").cast(pa.large_list(pa.float64()))
            lengths = pc.fill_null(pc.list_value_length(vectors), 0).to_numpy(zero_copy_only=False)
            for dim in np.unique(lengths[lengths > 0]):
                rows = np.flatnonzero(lengths == dim)
                flat = pc.fill_null(pc.list_flatten(vectors.take(pa.array(rows))), float("nan"))
                x = np.floor(flat.to_numpy(zero_copy_only=False).reshape(-1, dim) * scale)
                usable = (np.abs(x) < BEYOND).all(1)
                x, rows = x[usable].astype(np.int64), rows[usable]
                ids = batch.select(["vec_id", "label"]).take(pa.array(rows))
                yield pa.RecordBatch.from_arrays(
                    [
                        ids.column(0), ids.column(1), pa.array(np.full(len(x), dim, np.int32)), pa.array((x * x).sum(1)),
                        pa.array([v.tobytes() for v in x.astype(np.int32)], pa.binary()),
                    ],
                    names=["vec_id", "label", "dim", "length2", "vec"],
                )

    return run


def feasible(q: float, least: float, most: float) -> tuple[float, float]:
    """Range of a coordinate of unit vectors whose cosine with one that has ``q`` there can lie in [least, most].

    With angles a and b to the axis, cosines between cos(a+b) and cos(a-b) are possible.
    """
    angle = np.arccos(np.clip(q, -1, 1))
    far = np.arccos(np.clip(least, -1, 1))
    near = np.arccos(np.clip(most, -1, 1))
    low, high = max(0.0, angle - far, near - angle), min(np.pi, angle + far, 2 * np.pi - near - angle)
    return (2.0, -2.0) if low > high + SLACK else (np.cos(high) - SLACK, np.cos(low) + SLACK)


class Bucket:
    """Vectors of similar length with a sorted list for each coordinate that an anchor has asked for."""

    def __init__(self, ids: np.ndarray, labels: np.ndarray, whole: np.ndarray, lengths: np.ndarray):
        self.ids, self.labels, self.whole = ids, labels, whole
        self.shortest, self.longest = lengths.min(), lengths.max()
        self.unit = (whole / np.maximum(lengths, 1)[:, None]).astype(np.float32)
        self.lists: dict[int, tuple[np.ndarray, np.ndarray]] = {}

    def sorted_list(self, f: int) -> tuple[np.ndarray, np.ndarray]:
        if f not in self.lists:
            order = np.argsort(self.unit[:, f], kind="stable")
            self.lists[f] = order, self.unit[order, f]
        return self.lists[f]

    def cosines(self, low: int, high: int, length: float) -> tuple[float, float]:
        """Cosines that scores from ``low`` to ``high`` can have here."""
        reach = [length * self.longest, length * self.shortest]
        least = low / reach[0] if low > 0 else low / reach[1] if reach[1] else -1.0
        most = (high / reach[1] if reach[1] else 1.0) if high >= 0 else high / reach[0]
        return least, most

    def candidates(self, anchor: np.ndarray, length: float, low: int, high: int) -> np.ndarray:
        """Places that no focus coordinate rules out for a score from ``low`` to ``high``; none where the length does."""
        everything = np.arange(len(self.ids))
        if not length or not self.longest:
            return everything if low <= 0 <= high else everything[:0]
        least, most = self.cosines(low, high, length)
        if least > 1 + SLACK or most < -1 - SLACK:
            return everything[:0]
        unit = anchor / length
        ranges = []
        for f in np.argsort(-np.abs(unit), kind="stable")[:FOCUS]:
            order, values = self.sorted_list(int(f))
            bounds = feasible(unit[f], least, most)
            a, b = np.searchsorted(values, bounds[0], "left"), np.searchsorted(values, bounds[1], "right")
            ranges.append((max(b - a, 0), int(f), order[a:b], bounds))
        ranges.sort(key=lambda r: r[:2])
        found = ranges[0][2]
        for _, f, _, (a, b) in ranges[1:]:
            found = found[(self.unit[found, f] >= a) & (self.unit[found, f] <= b)]
        return found


def length_buckets(ids: np.ndarray, labels: np.ndarray, whole: np.ndarray) -> list[Bucket]:
    """The vectors by falling length, cut where they get shorter than ``SHORTER`` times the longest of the bucket."""
    lengths = np.sqrt((whole.astype(np.float64) ** 2).sum(1))
    order = np.argsort(-lengths, kind="stable")
    out, start = [], 0
    while start < len(order):
        stop = int(np.searchsorted(-lengths[order], -SHORTER * lengths[order[start]], "right"))
        take = order[start : max(stop, start + 1)]
        out.append(Bucket(ids[take], labels[take], whole[take], lengths[take]))
        start += len(take)
    return out


def best(ids: np.ndarray, scores: np.ndarray, k: int) -> np.ndarray:
    """Places of the ``k`` highest scores, ties by smaller id."""
    if len(scores) > k:
        worst = np.partition(scores, len(scores) - k)[len(scores) - k]
        close = np.flatnonzero(scores >= worst)
    else:
        close = np.arange(len(scores))
    return close[np.lexsort((ids[close], -scores[close]))[:k]]


def _found(same: bool, k: int):
    """(anchor_id, place, vec_id, score): for each window of each anchor of a group, the best ``k`` of the group's rows."""

    def run(key: tuple, frame: pd.DataFrame) -> pd.DataFrame:
        here, there = frame[frame["side"] == 0], frame[frame["side"] == 1]
        out = []
        if len(here) and len(there):
            codes = pd.factorize(frame["label"])[0][:, None]
            side = frame["side"].to_numpy()
            whole = np.frombuffer(b"".join(there["vec"]), np.int32).reshape(len(there), -1).astype(np.int64)
            buckets = length_buckets(there["id"].to_numpy(), codes[side == 1, 0], whole)
            for anchor_id, code, vec, lows, highs in zip(here["id"], codes[side == 0, 0], here["vec"], here["lows"], here["highs"], strict=True):
                anchor = np.frombuffer(vec, np.int32).astype(np.int64)
                length = float(np.sqrt((anchor.astype(np.float64) ** 2).sum()))
                windows = [(w, low, high) for w, (low, high) in enumerate(zip(lows, highs, strict=True)) if low <= high]
                if not windows:
                    continue
                low, high = min(w[1] for w in windows), max(w[2] for w in windows)
                ids, scores = [], []
                for bucket in buckets:
                    at = bucket.candidates(anchor, length, low, high)
                    at = at[(bucket.labels[at] == code) == same]
                    ids.append(bucket.ids[at])
                    scores.append(bucket.whole[at] @ anchor)
                ids, scores = np.concatenate(ids), np.concatenate(scores)
                for w, low, high in windows:
                    fit = np.flatnonzero((scores >= low) & (scores <= high) & ((ids != anchor_id) | (not same)))
                    fit = fit[best(ids[fit], scores[fit], k)]
                    out.append(pd.DataFrame({"anchor_id": anchor_id, "place": w, "vec_id": ids[fit], "score": scores[fit]}))
        found = pd.concat(out) if out else pd.DataFrame({"anchor_id": [], "place": [], "vec_id": [], "score": []})
        return found.astype({"anchor_id": "int64", "place": "int32", "vec_id": "int64", "score": "int64"})

    return run


def _meet(anchors: DataFrame, rows: DataFrame, pairs: DataFrame, same: bool, k: int) -> DataFrame:
    """What every anchor finds in the blocks it is paired with, each pair of blocks a bounded task; stored."""
    pair = ["ablock", "dim", "dblock"]
    none = F.lit(None).cast("array<long>")
    left = anchors.join(pairs, ["ablock", "dim"]).select(*pair, F.lit(0).alias("side"), F.col("vec_id").alias("id"), "label", "vec", "lows", "highs")
    right = rows.join(pairs, ["dblock", "dim"]).select(
        *pair, F.lit(1).alias("side"), F.col("vec_id").alias("id"), "label", "vec", none.alias("lows"), none.alias("highs")
    )
    # pairs cost time rather than bytes, so their number and not their size decides on the number of tasks
    tasks = min(max(pairs.count(), 1), MOST_TASKS)
    dealt = left.unionByName(right).repartition(tasks, *pair)
    found = dealt.groupBy(*pair).applyInPandas(_found(same, k), "anchor_id long, place int, vec_id long, score long")
    return stored(found, "negatives")


def _top(found: DataFrame, k: int) -> DataFrame:
    order = Window.partitionBy("anchor_id", "place").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)


def _pairs(heads: DataFrame, ranges: DataFrame, on: list[str]) -> DataFrame:
    """(ablock, dim, dblock, first, last, …) for the blocks in the range each head is to look at."""
    return heads.join(ranges, on).withColumn("dblock", F.explode(F.sequence("first", "last")))


def _in_reach(pairs: DataFrame, blocks: DataFrame) -> DataFrame:
    """Pairs of blocks in which lengths allow the least score wanted; ``low`` and ``reach2`` are of the block of anchors."""
    low = F.col("low").cast("double")
    reach = F.col("reach2").cast("double") * F.col("longest2").cast("double") * (1 + 1e-9)
    return pairs.join(blocks, ["dblock", "dim"]).filter((low <= 0) | (low * low <= reach)).select("ablock", "dim", "dblock").distinct()


def _floor_percent(percent: int, score: Column) -> Column:
    product = score * F.lit(percent)
    return ((product - F.pmod(product, F.lit(100))) / F.lit(100)).cast("long")


def mine_negatives(
    vectors: DataFrame, vec_id: str = "vec_id", vector: str = "embedding", label: str = "label", every: int = EVERY, positives: int = POSITIVES,
    negatives: int = NEGATIVES, least_percent: int = LEAST_PERCENT, most_percent: int = MOST_PERCENT, scale: float = SCALE,
    block: int = BLOCK, anchor_block: int = ANCHORS,
) -> DataFrame:
    """For each anchor and positive the highest scoring rows of other labels whose score is within a band of the positive's.

    Returns anchor_id, positive_id, rank, negative_id, positive_score,
    negative_score. Entries count as floor(scale*x), a score is the exact inner
    product; ties go to the smaller id. Anchors are the rows whose id is
    divisible by ``every``, positives their best rows of the same label, the
    band is from ``least_percent`` to ``most_percent`` of the positive's score.

    1. Rows are put in order of label and falling length by ranges and cut into
       blocks of ``block`` entries, whatever the labels' sizes.
    2. Blocks of anchors meet blocks of rows, each pair one bounded task. In it
       rows stand in length buckets with a sorted list per coordinate. A score
       wanted bounds the cosine and so a range of each of the anchor's largest
       coordinates; rows in all these ranges are scored exactly.
    3. Positives: the longest rows of the label first; the least score they leave
       is the threshold with which the anchor goes on to the other blocks, of
       which those too short for it are not visited. Negatives: likewise, with
       the first and the last block, one of which has another label.

    Rows with a null id or label, a null or empty vector, null or non-finite
    entries, or entries of 2^24 or more after scaling take no part. Vectors of different length
    never meet. Anchors that share an id are one anchor, the one of smallest
    label and vector; other rows count each, and rows with the anchor's own id
    are not its positives. No rows give no rows.
    """
    spark = vectors.sparkSession
    rows = vectors.select(F.col(vec_id).cast("long").alias("vec_id"), F.col(label).alias("label"), F.col(vector).alias("vector"))
    rows = rows.filter("vec_id is not null and label is not null and vector is not null")
    kind = rows.schema["label"].dataType.simpleString()
    rows = rows.mapInArrow(_whole(scale), f"vec_id long, label {kind}, dim int, length2 long, vec binary")
    placed = stored(with_position(rows, ["dim", "label", F.desc("length2"), "vec_id"], out="_at"), "placed")
    widest = placed.agg(F.max("dim")).first()[0] or 1
    rows = placed.withColumn("dblock", F.floor((F.col("_at") - 1) / max(block // widest, 1))).drop("_at")

    one = F.min(F.struct("label", "dim", "length2", "vec")).alias("_one")
    anchors = rows.filter(F.pmod("vec_id", F.lit(every)) == 0).groupBy("vec_id").agg(one).select("vec_id", "_one.*")
    anchors = with_position(anchors, ["dim", "label", F.desc("length2"), "vec_id"], out="_at")
    anchors = stored(anchors.withColumn("ablock", F.floor((F.col("_at") - 1) / anchor_block)).drop("_at"), "anchors")
    ends = [F.min("dblock").alias("first"), F.max("dblock").alias("last")]
    labels = stored(rows.groupBy("dim", "label").agg(*ends), "labels")
    dims = labels.groupBy("dim").agg(F.min("first").alias("first"), F.max("last").alias("last"))
    blocks = stored(rows.groupBy("dblock", "dim").agg(F.max("length2").alias("longest2")), "blocks")

    def heads(of: DataFrame, *by: str) -> DataFrame:
        return of.groupBy("ablock", "dim", *by).agg(F.max("length2").alias("reach2"), F.min(F.array_min("lows")).alias("low"))

    def window(low: Column) -> dict[str, Column]:
        return {"lows": F.array(low), "highs": F.array(F.lit(ANY))}

    def two_visits(asking: DataFrame, pairs, at_first: Column, same: bool, k: int) -> DataFrame:
        """Results of some blocks, then of the others with the thresholds that the first ones leave."""
        visited = stored(pairs(asking).filter(at_first).select("ablock", "dim", "dblock").distinct(), "visited")
        found = _meet(asking, rows, visited, same, k)
        least = _top(found, k).groupBy("anchor_id", "place").agg(F.min("score").alias("least"), F.count(F.lit(1)).alias("n")).filter(F.col("n") == k)
        least = least.groupBy(F.col("anchor_id").alias("vec_id")).agg(F.map_from_entries(F.collect_list(F.struct("place", "least"))).alias("_least"))
        raised = F.transform("lows", lambda low, place: F.greatest(low, F.try_element_at("_least", place.cast("int"))))
        sharper = asking.join(least, "vec_id", "left").withColumn("lows", F.when(F.col("_least").isNull(), F.col("lows")).otherwise(raised))
        sharper = stored(sharper.drop("_least"), "asking")
        # a block that was visited for one label has been met by all anchors of the pair
        others = _in_reach(pairs(sharper).filter(~at_first), blocks).join(visited, ["ablock", "dim", "dblock"], "left_anti")
        others = stored(others, "others")
        rest = _meet(sharper, rows, others, same, k)
        return _top(found.unionByName(rest), k)

    asking = anchors.withColumns(window(F.lit(-ANY)))
    near = two_visits(asking, lambda a: _pairs(heads(a, "label"), labels, ["dim", "label"]), F.col("dblock") == F.col("first"), True, positives)
    score = F.col("score")
    low, high = -_floor_percent(-least_percent, score), _floor_percent(most_percent, score)
    near = stored(near.select("anchor_id", F.col("rank").alias("prank"), F.col("vec_id").alias("positive_id"), score.alias("positive_score"), low.alias("low"), high.alias("high")), "positives")

    bands = near.groupBy(F.col("anchor_id").alias("vec_id")).agg(F.sort_array(F.collect_list(F.struct("prank", "low", "high"))).alias("_bands"))
    asking = anchors.join(bands, "vec_id").select("*", F.col("_bands.low").alias("lows"), F.col("_bands.high").alias("highs")).drop("_bands")
    asking = stored(asking, "asking")
    ends = (F.col("dblock") == F.col("first")) | (F.col("dblock") == F.col("last"))
    hard = two_visits(asking, lambda a: _pairs(heads(a), dims, ["dim"]), ends, False, negatives)
    hard = hard.select("anchor_id", (F.col("place") + 1).alias("prank"), F.col("rank").cast("int").alias("rank"), F.col("vec_id").alias("negative_id"), score.alias("negative_score"))
    return hard.join(near.drop("low", "high"), ["anchor_id", "prank"]).select(
        "anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score"
    )
