"""Whitening of embeddings: exact covariance from bit-sliced cross-products, components by eigenvectors."""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import stored

SCALE, SHIFT = 1024, 100_000
COMPONENTS = 8
#: Entries whose bit planes are held at once.
BLOCK = 1 << 19
#: Cross-products travel as four numbers of so many bits, the last one with the sign.
LIMB = 40
#: Scaled entries from here on fit no long; they count as not finite.
BEYOND = float(1 << 62)


def whole_vectors(vectors: pa.Array, scale: float = SCALE, shift: int = SHIFT) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(rows, x) for each length of vector: places of the usable rows and their whole numbers floor(scale*c)+shift, one row a vector."""
    vectors = vectors.cast(pa.large_list(pa.float64()))
    lengths = pc.fill_null(pc.list_value_length(vectors), 0).to_numpy(zero_copy_only=False)
    for dim in np.unique(lengths[lengths > 0]):
        rows = np.flatnonzero(lengths == dim)
        flat = pc.list_flatten(vectors.take(pa.array(rows)))
        c = np.floor(pc.fill_null(flat, float("nan")).to_numpy(zero_copy_only=False).reshape(-1, dim) * scale)
        usable = (np.abs(c) < BEYOND).all(1)
        if usable.any():
            yield rows[usable], c[usable].astype(np.int64) + shift


def bit_planes(y: np.ndarray) -> np.ndarray:
    """Bits of the columns of ``y`` (rows, dims; none negative) as words over the rows: (dims, bits, words)."""
    bits = max(int(y.max()).bit_length(), 1)
    rows = -(-len(y) // 64) * 64
    columns = np.zeros((y.shape[1], rows), np.uint64)
    columns[:, : len(y)] = y.T
    planes = [np.packbits((columns >> np.uint64(b)) & np.uint64(1) == 1, axis=1).view(np.uint64) for b in range(bits)]
    return np.stack(planes, 1)


def plane_products(planes: np.ndarray) -> np.ndarray:
    """Sum over the rows of y_i * y_j for all i <= j: weighted popcounts of the planes' conjunctions, exact."""
    dims, bits, words = planes.shape
    wide = 2 * bits + (64 * words).bit_length() > 62
    out = np.zeros((dims, dims), object if wide else np.int64)
    weight = np.array([1 << b for b in range(bits)], object if wide else np.int64)
    for i in range(dims):
        rest = planes[i:]
        for a in range(bits):
            common = np.bitwise_count(rest & planes[i, a]).sum(2, dtype=np.int64)
            out[i, i:] += (common * weight).sum(1) * int(weight[a])
    return out


def _scatter(scale: float, shift: int):
    """Rows (dim, i, j, l0 .. l3) of a task: sums of x_i * x_j; of x_i at j = -1; the number of rows at i = j = -1."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[int, list] = {}
        for batch in batches:
            for _, x in whole_vectors(batch.column("vector"), scale, shift):
                dim = x.shape[1]
                n, s, c = sums.setdefault(dim, [0, np.zeros(dim, object), np.zeros((dim, dim), object)])
                height = max(BLOCK // dim // 64, 1) * 64
                for at in range(0, len(x), height):
                    block = x[at : at + height]
                    least = block.min(0)
                    # non-negative also where the difference passes the long range: it wraps into the unsigned one
                    y = block.astype(np.uint64) - least.astype(np.uint64)
                    low = least.astype(object)
                    total = (y >> np.uint64(32)).sum(0).astype(object) * (1 << 32) + (y & np.uint64((1 << 32) - 1)).sum(0).astype(object)
                    # sum (y+m)_i (y+m)_j = sum y_i y_j + m_i sum y_j + m_j sum y_i + rows m_i m_j
                    c += plane_products(bit_planes(y)).astype(object)
                    c += np.outer(low, total) + np.outer(total, low) + len(block) * np.outer(low, low)
                    s += total + len(block) * low
                    n += len(block)
                sums[dim] = [n, s, c]
        for dim, (n, s, c) in sums.items():
            i, j = np.triu_indices(dim)
            i, j = np.concatenate([[-1], np.arange(dim), i]), np.concatenate([[-1], np.full(dim, -1), j])
            values = np.concatenate([np.array([n], object), s, c[np.triu_indices(dim)]])
            limbs = []
            for _ in range(3):
                limbs.append((values & ((1 << LIMB) - 1)).astype(np.int64))
                values = values >> LIMB
            limbs.append(values.astype(np.int64))
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.full(len(i), dim, np.int32)), pa.array(i.astype(np.int32)), pa.array(j.astype(np.int32)), *map(pa.array, limbs)],
                names=["dim", "i", "j", "l0", "l1", "l2", "l3"],
            )

    return run


@dataclass(frozen=True)
class Whitener:
    """What whitening needs to know of the fit list; bounded by the square of the vectors' length."""

    n: int
    sums: np.ndarray
    trace: float
    values: np.ndarray
    vectors: np.ndarray

    @property
    def variable(self) -> np.ndarray:
        """Which components vary: those of an eigenvalue above rounding errors."""
        return self.values > max(self.values.max(initial=0.0), 0.0) * len(self.sums) * 1e-14


def whitener(n: int, sums: np.ndarray, products: np.ndarray, components: int = COMPONENTS) -> Whitener:
    """Eigenvectors of the covariance, by falling eigenvalue. All centring is on whole numbers: (n*sum xx - sum x sum x) / n^2."""
    centred = n * products - np.outer(sums, sums)
    covariance = np.array([[v / (n * n) for v in row] for row in centred], np.float64)
    values, vectors = np.linalg.eigh(covariance)
    order = np.argsort(-values, kind="stable")[:components]
    vectors = vectors[:, order]
    vectors = vectors * np.where(vectors[np.abs(vectors).argmax(0), np.arange(len(order))] < 0, -1.0, 1.0)
    return Whitener(n, sums, math.fsum(np.diag(covariance)), values[order], vectors)


def fit_whiteners(vectors: DataFrame, vector: str = "embedding", components: int = COMPONENTS, scale: float = SCALE, shift: int = SHIFT) -> dict[int, Whitener]:
    """A whitener for each length of vector; one pass, one row for each pair of dimensions and task."""
    parts = vectors.select(F.col(vector).alias("vector")).mapInArrow(_scatter(scale, shift), "dim int, i int, j int, l0 long, l1 long, l2 long, l3 long")
    found = parts.groupBy("dim", "i", "j").agg(*[F.sum(f"l{k}").alias(f"l{k}") for k in range(4)]).toPandas()
    out = {}
    for dim, rows in found.groupby("dim"):
        i, j = rows["i"].to_numpy(), rows["j"].to_numpy()
        value = sum(rows[f"l{k}"].astype(object).to_numpy() * (1 << (LIMB * k)) for k in range(4))
        sums, products = np.zeros(dim, object), np.zeros((dim, dim), object)
        sums[i[(j < 0) & (i >= 0)]] = value[(j < 0) & (i >= 0)]
        products[i[j >= 0], j[j >= 0]] = products[j[j >= 0], i[j >= 0]] = value[j >= 0]
        out[int(dim)] = whitener(int(value[i < 0][0]), sums, products, components)
    return out


def _projected(whiteners: dict[int, Whitener], scale: float, shift: int):
    """Rows (vec_id, dim, deviation as decimal text, whitened) of the usable vectors."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for rows, x in whole_vectors(batch.column("vector"), scale, shift):
                dim = x.shape[1]
                w = whiteners[dim]
                top = max(int(np.abs(x).max()) * w.n + max(abs(int(s)) for s in w.sums), 1)
                narrow = top < 1 << 62
                far = x * w.n - w.sums.astype(np.int64) if narrow else x.astype(object) * w.n - w.sums
                square = far if narrow and int(np.abs(far).max()) ** 2 * dim < 1 << 62 else far.astype(object)
                centred = far.astype(np.float64) / w.n
                with np.errstate(divide="ignore", invalid="ignore"):
                    white = centred @ w.vectors / np.sqrt(np.where(w.variable, w.values, np.nan))
                parts = white.shape[1]
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column("vec_id").take(pa.array(rows)), pa.array(np.full(len(x), dim, np.int32)),
                        pa.array([str(v) for v in (square * square).sum(1)]),
                        pa.ListArray.from_arrays(np.arange(len(x) + 1, dtype=np.int32) * parts, pa.array(white.ravel(), from_pandas=True)),
                    ],
                    names=["vec_id", "dim", "deviation", "whitened"],
                )

    return run


def identity_errors(white: DataFrame, whiteners: dict[int, Whitener]) -> dict[int, float | None]:
    """For each length, the largest entry by which the whitened rows' covariance differs from the identity; measured, centred first."""
    out: dict[int, float | None] = {}
    for dim, w in whiteners.items():
        parts = [k for k, varies in enumerate(w.variable) if varies]
        rows = white.filter(F.col("dim") == dim)
        if not parts:
            out[dim] = None
            continue
        means = rows.agg(*[F.avg(F.get("whitened", F.lit(k))) for k in parts]).first()
        centred = rows.select(*[(F.get("whitened", F.lit(k)) - F.lit(m)).alias(f"c{k}") for k, m in zip(parts, means, strict=True)])
        pairs = [(a, b) for a in parts for b in parts if a <= b]
        found = centred.agg(*[F.avg(F.col(f"c{a}") * F.col(f"c{b}")) for a, b in pairs]).first()
        out[dim] = max(abs(v - (a == b)) for (a, b), v in zip(pairs, found, strict=True))
    return out


def whiten(
    vectors: DataFrame, vec_id: str = "vec_id", vector: str = "embedding", components: int = COMPONENTS, scale: float = SCALE, shift: int = SHIFT
) -> DataFrame:
    """Whitened components of all usable vectors.

    Returns vec_id, component (from 1), n, deviation (sum over dimensions of
    (n*x - sum x)^2, exact, decimal(38,0); null beyond that), whitened,
    explained, identity_error: one row per vector and component.

    1. An entry c counts as the whole number x = floor(scale*c) + shift. Each
       task takes its rows in blocks, subtracts the block's least x in each
       dimension and packs every bit of every dimension, across the rows, into
       words. Popcounts of two planes' conjunctions, weighted by their bits, are
       the cross-products of two dimensions; with the shift put back they are
       exact, whatever the block, so partial results add up in any order.
    2. The driver gets one row per pair of dimensions, centres the products as
       whole numbers, divides once and finds the eigenvectors; the sign makes an
       eigenvector's largest entry positive.
    3. A second pass projects all rows; the covariance of the result is measured
       on all of it.

    A vector that is null or empty, or holds null or non-finite entries or
    entries whose x fits no long, is left out. Vectors of different length are
    fitted apart. A component without variance (one row, constant dimensions) has whitened null,
    and no part in identity_error, which is null if no component varies;
    explained is null if nothing varies at all. Repeated rows and ids count each.
    No rows give no rows. ``vectors`` is read twice, so hand a table.
    """
    rows = vectors.select(F.col(vec_id).alias("vec_id"), F.col(vector).alias("vector"))
    fitted = fit_whiteners(rows, "vector", components, scale, shift)
    kind = rows.schema["vec_id"].dataType.simpleString()
    white = rows.mapInArrow(_projected(fitted, scale, shift), f"vec_id {kind}, dim int, deviation string, whitened array<double>")
    white = stored(white.withColumn("deviation", F.expr("try_cast(deviation as decimal(38,0))")), "whitened")
    errors = identity_errors(white, fitted)
    schema = "dim int, n long, explained array<double>, identity_error double"
    facts = [(d, w.n, [float(v) / w.trace if w.trace else None for v in w.values], errors[d]) for d, w in fitted.items()]
    facts = vectors.sparkSession.createDataFrame(facts, schema)
    # one row for each length of vector
    joined = white.join(F.broadcast(facts), "dim").select("*", F.posexplode("whitened").alias("place", "value"))
    return joined.select(
        "vec_id", (F.col("place") + 1).alias("component"), "n", "deviation", F.col("value").alias("whitened"),
        F.get("explained", "place").alias("explained"), "identity_error",
    )
