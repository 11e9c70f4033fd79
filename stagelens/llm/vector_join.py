"""Near-duplicate vectors by an exact metric range join around pivots."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import components, star_roots, stored

PIVOTS = 8
BLOCK = 2048
#: Distances are compared with this much room; cosines decide.
SLACK = 1e-6


def _usable(vector: np.ndarray | None) -> np.ndarray | None:
    if vector is None:
        return None
    values = np.asarray(vector, np.float64)
    if not len(values) or not np.isfinite(values).all():
        return None
    scale = np.abs(values).max()
    if not scale:
        return None
    values = values / scale
    return values / math.sqrt(values @ values)


def _unit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        units = [_usable(v) for v in batch.column("vector").to_pylist()]
        kept = pa.array([u is not None for u in units])
        out = batch.select(["vec_id", "grp"]).filter(kept)
        units = [u for u in units if u is not None]
        yield pa.RecordBatch.from_arrays(
            [out.column(0), out.column(1), pa.array([len(u) for u in units], pa.int32()), pa.array([u.tobytes() for u in units], pa.binary())],
            names=["vec_id", "grp", "dim", "unit"],
        )


def _cells(radius: float):
    """Rows (grp, dim, cell, home, …) for each cell a vector lives in or lies within ``radius`` of."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for _, rows in frame.groupby(["grp", "dim"], sort=False):
                x = np.frombuffer(b"".join(rows["unit"]), np.float64).reshape(len(rows), -1)
                p = np.stack([np.frombuffer(v, np.float64) for v in rows["pivots"].iloc[0]])
                square = np.maximum(2 - 2 * (x @ p.T), 0)
                home = square.argmin(1)
                gap = np.sqrt(np.maximum(2 - 2 * (p @ p.T), 0))[home]
                # y in cell q is at least this far from x: both the triangle
                # inequality and the distance to the plane halfway to q bound it
                nearest = square[np.arange(len(x)), home][:, None]
                plane = (square - nearest) / np.maximum(2 * gap, SLACK)
                half = (np.sqrt(square) - np.sqrt(nearest)) / 2
                near = np.maximum(plane, half) <= radius + SLACK
                near[np.arange(len(x)), home] = True
                row, cell = np.nonzero(near)
                out = rows[["vec_id", "grp", "dim", "copies", "unit"]].iloc[row].copy()
                out["cell"], out["home"] = cell, home[row]
                yield out

    return run


def _block_links(cosine: float):
    """Links from a block at home in a cell to a block of the cell's members.

    Returns link counts (b = -1) of the vectors at home, and stars over what
    the links connect instead of the pairs (n = 0).
    """

    def run(key, frame: pd.DataFrame) -> pd.DataFrame:
        here, there = frame[frame["side"] == 0], frame[frame["side"] == 1]
        if not len(here) or not len(there):
            return pd.DataFrame({"a": [], "b": [], "n": []}).astype("int64")
        x, y = (np.frombuffer(b"".join(f["unit"]), np.float64).reshape(len(f), -1) for f in (here, there))
        ids, other = here["vec_id"].to_numpy(), there["vec_id"].to_numpy()
        linked = ((x @ y.T) >= cosine) & (ids[:, None] != other[None])
        counts = pd.DataFrame({"a": ids, "b": -1, "n": linked @ there["copies"].to_numpy()})
        nodes = np.unique(np.concatenate([ids, other]))
        left, right = (np.searchsorted(nodes, v[at]) for v, at in zip((ids, other), np.nonzero(linked), strict=True))
        root = star_roots(len(nodes), left, right)
        leaf = np.flatnonzero(root != np.arange(len(nodes)))
        stars = pd.DataFrame({"a": nodes[leaf], "b": nodes[root[leaf]], "n": 0})
        return pd.concat([counts[counts["n"] > 0], stars]).astype("int64")

    return run


def near_vectors(
    vectors: DataFrame, cosine: float = 0.93, vec_id: str = "vec_id", vector: str = "embedding", group: str = "label",
    pivots: int = PIVOTS, block: int = BLOCK,
) -> DataFrame:
    """Links between vectors of equal group at ``cosine`` or more, each one counted, none below.

    Returns vec_id, n_links, component_id, kept, one row per vector.

    1. Vectors are scaled to length one in double precision. Exact copies
       become one vector with a count.
    2. Pivots, ``pivots`` per group, are the copies with the smallest hashes: a
       bounded choice that affects cost only. A vector lives in the cell of its
       nearest pivot and is repeated in every cell whose members can, by the
       triangle inequality, lie within the range. Cells are then independent.
    3. Vectors at home in a cell meet all its members in blocks of about
       ``block``, each pair of blocks one bounded task: a matrix product. It
       returns counts and spanning stars, never the pairs themselves.

    With vectors that spread in all directions the range reaches most cells; the
    join stays exact and its cost then is that of all blocks. Vectors of
    different length or group never link. A vector that is null, empty, zero or
    holds null or non-finite parts, or has a null group, links with nothing. Rows
    that share an id are one vector of the components; repeated rows count each
    other as links. A null id links
    with nothing and is its own, null, component. No rows give no rows.
    """
    rows = vectors.select(F.col(vec_id).cast("long").alias("vec_id"), F.col(group).alias("grp"), F.col(vector).alias("vector"))
    kind = rows.schema["grp"].dataType.simpleString()
    units = stored(
        rows.filter("grp is not null and vector is not null and vec_id is not null").mapInArrow(
            _unit, f"vec_id long, grp {kind}, dim int, unit binary"
        ),
        "units",
    )
    same = ["grp", "dim", "unit"]
    classes = units.groupBy(*same).agg(F.min("vec_id").alias("rep"), F.count(F.lit(1)).alias("copies"))
    classes = stored(classes.select(F.col("rep").alias("vec_id"), "grp", "dim", "unit", "copies"), "classes")

    order = Window.partitionBy("grp", "dim").orderBy(F.xxhash64("unit"), "unit")
    chosen = classes.select(*same).withColumn("_n", F.row_number().over(order)).filter(F.col("_n") <= pivots)
    chosen = chosen.groupBy("grp", "dim").agg(F.collect_list("unit").alias("pivots"))
    radius = math.sqrt(2 - 2 * cosine)
    placed = stored(
        classes.join(chosen, ["grp", "dim"]).mapInPandas(
            _cells(radius), f"vec_id long, grp {kind}, dim int, copies long, unit binary, cell int, home int"
        ),
        "cells",
    )
    cell = ["grp", "dim", "cell"]
    at_home = F.col("cell") == F.col("home")
    blocks = lambda n: F.greatest(F.ceil(n / F.lit(block)).cast("int"), F.lit(1))
    sizes = placed.groupBy(*cell).agg(blocks(F.count_if(at_home)).alias("homes"), blocks(F.count(F.lit(1))).alias("members"))
    part = placed.join(sizes, cell)
    spread = lambda n: F.pmod(F.xxhash64("vec_id"), F.col(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    columns = [*cell, "left", "right", "side", "vec_id", "copies", "unit"]
    at_left = part.filter(at_home).withColumns({"left": spread("homes"), "side": F.lit(0)}).withColumn("right", every("members"))
    at_right = part.withColumns({"right": spread("members"), "side": F.lit(1)}).withColumn("left", every("homes"))
    tasks = at_left.select(*columns).unionByName(at_right.select(*columns))
    found = stored(
        tasks.groupBy("grp", "dim", "cell", "left", "right").applyInPandas(_block_links(cosine), "a long, b long, n long"), "found"
    )
    counts = found.filter("b < 0").groupBy(F.col("a").alias("rep")).agg(F.sum("n").alias("_n"))
    groups = components(found.filter("b >= 0").select("a", "b"))
    reps = (
        classes.select(*same, F.col("vec_id").alias("rep"), "copies")
        .join(counts, "rep", "left")
        .join(groups.withColumnRenamed("node", "rep"), "rep", "left")
        .select(*same, (F.coalesce("_n", F.lit(0)) + F.col("copies") - 1).alias("_links"), F.coalesce("component", "rep").alias("_component"))
    )
    linked = units.join(reps, same).groupBy("vec_id").agg(F.max("_links").alias("_links"), F.min("_component").alias("_component"))
    return (
        rows.select("vec_id")
        .join(linked, "vec_id", "left")
        .select(
            "vec_id", F.coalesce("_links", F.lit(0)).cast("long").alias("n_links"), F.coalesce("_component", "vec_id").alias("component_id")
        )
        .withColumn("kept", F.col("vec_id").eqNullSafe(F.col("component_id")))
    )
