"""Whitening of embeddings by a tiled covariance.

1. Vectors become integers (fixed point), so that their sums are exact. Each task adds up its own.
2. Tasks cut their rows into row blocks and each of these into column blocks, centred. The column blocks are shuffled
   by row block, so that those of one row block meet. A task multiplies each pair of them, which is a tile of the
   covariance, and adds the products up by tile key; what it holds beyond TILE_BYTES it sends on.
3. Partial tiles are added up by tile, in two levels. Tiles, d * d numbers for d dimensions however many rows there
   are, are assembled and decomposed on the driver.
4. Rows are projected where they are read.
"""

from __future__ import annotations

from dataclasses import dataclass
from decimal import Decimal

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sparkwarden.llm.session import durable, parts

#: Dimensions of a column block, bytes of a row block, and bytes of tiles that a task holds.
TILE, BLOCK_BYTES, TILE_BYTES = 32, 1 << 22, 1 << 26
#: Partial sums of one tile are added up in so many places first.
LANES = 16
#: Eigenvalues up to this share of the largest are no component: there is nothing to scale.
NOTHING = 1e-12
ENTRIES = "id long, x array<long>"


def fixed_point(vectors: DataFrame, scale: int = 1024, offset: int = 100_000, id_column: str = "vec_id", vector_column: str = "embedding") -> DataFrame:
    """(id, x) of the usable rows: x = floor(scale * entry) + offset, in double precision.

    Vectors that are null or empty, or hold null or non-finite entries, are left out, and so are those of another width than
    most have (of equally many the larger one). Rows that repeat and null ids stay. Entries beyond 2**53 / scale lose digits as doubles do.
    """
    v = F.col(vector_column).cast("array<double>")
    good = F.forall(v, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) != float("inf")))
    rows = vectors.select(F.col(id_column).cast("long").alias("id"), v.alias("v")).where(F.col("v").isNotNull() & (F.size("v") > 0)).where(good)
    width = rows.groupBy(F.size("v").alias("d")).count().orderBy(F.desc("count"), F.desc("d")).first()
    x = F.transform("v", lambda c: (F.floor(c * float(scale)) + F.lit(offset)).cast("long"))
    return rows.where(F.size("v") == (width.d if width else 0)).select("id", x.alias("x"))


def _matrix(batch: pa.RecordBatch) -> np.ndarray:
    return batch.column("x").flatten().to_numpy(zero_copy_only=False).reshape(batch.num_rows, -1)


@dataclass
class Sums:
    """n vectors and their exact sums by dimension."""

    n: int
    sums: np.ndarray

    def centred(self, x: np.ndarray) -> np.ndarray:
        """n times the distance from the mean, exact: of longs where these hold it, else of Python's integers."""
        most = max(int(np.abs(x).max(initial=0)), max((abs(int(s)) for s in self.sums), default=0) // max(1, self.n) + 1)
        if 2 * most * self.n < 1 << 62:
            return x * np.int64(self.n) - self.sums.astype(np.int64)
        return x.astype(object) * self.n - self.sums


def column_sums(x: DataFrame) -> Sums:
    """A row for each task and dimension is shuffled."""

    def run(batches):
        total, n = None, 0
        for batch in batches:
            if batch.num_rows:
                m = _matrix(batch)
                exact = int(np.abs(m).max()) * len(m) < 1 << 62
                part = m.sum(0) if exact else m.astype(object).sum(0)
                total, n = part.astype(object) + (0 if total is None else total), n + len(m)
        if n:
            yield pa.RecordBatch.from_arrays([pa.array(range(len(total)), pa.int32()), pa.array([n] * len(total), pa.int64()), pa.array([Decimal(int(s)) for s in total], pa.decimal128(38, 0))], ["dim", "n", "s"])

    rows = x.mapInArrow(run, "dim int, n long, s decimal(38,0)").groupBy("dim").agg(F.sum("n").alias("n"), F.sum("s").alias("s")).collect()  # a row for each dimension
    rows.sort()
    return Sums(rows[0].n if rows else 0, np.array([int(r.s) for r in rows], object))


_PART = "i int, j int, lane int, product binary"


def _rows_of(tiles: dict, lane: int) -> pa.RecordBatch:
    keys = list(tiles)
    return pa.RecordBatch.from_arrays(
        [pa.array([k[0] for k in keys], pa.int32()), pa.array([k[1] for k in keys], pa.int32()), pa.array([lane] * len(keys), pa.int32()), pa.array([tiles[k].tobytes() for k in keys], pa.binary())], ["i", "j", "lane", "product"]
    )


def _added(batches):
    """Rows come sorted by tile and lane: one sum is held at a time."""
    at, total = None, None
    for batch in batches:
        for i, j, lane, product in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            if (i, j, lane) != at:
                if at is not None:
                    yield _rows_of({at[:2]: total}, at[2])
                at, total = (i, j, lane), 0.0
            total = total + np.frombuffer(product)
    if at is not None:
        yield _rows_of({at[:2]: total}, at[2])


def covariance(x: DataFrame, sums: Sums, tile: int = TILE, block_bytes: int = BLOCK_BYTES) -> np.ndarray:
    """The covariance of the vectors (divisor n), centred before they are multiplied.

    What is shuffled is the table itself once, and of tiles one of each for each task. A task holds one row block and TILE_BYTES of tiles.
    """
    d = len(sums.sums)
    cuts = list(range(0, d, tile))

    def cut(batches):
        at, k = TaskContext.get().partitionId(), 0
        for batch in batches:
            for part in parts([batch], max(1, block_bytes // (8 * d))):
                y = sums.centred(_matrix(part)).astype(np.float64) / sums.n
                names = [(at << 32) | k] * len(cuts)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(names, pa.int64()), pa.array(range(len(cuts)), pa.int32()), pa.array([np.ascontiguousarray(y[:, c : c + tile]).tobytes() for c in cuts], pa.binary()), pa.array([len(y)] * len(cuts), pa.int32())],
                    ["row_block", "column_block", "y", "n"],
                )
                k += 1

    def multiply(batches):
        lane, held, tiles, size, at = TaskContext.get().partitionId() % LANES, [], {}, 0, None
        for batch in batches:
            for row_block, j, y, n in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                held = held if row_block == at else []
                at = row_block
                held.append(np.frombuffer(y).reshape(n, -1))
                for i, left in enumerate(held):  # column blocks come in order
                    product = left.T @ held[-1]
                    size += 0 if (i, j) in tiles else product.nbytes
                    tiles[i, j] = tiles[i, j] + product if (i, j) in tiles else product
                    if size > TILE_BYTES:
                        yield _rows_of(tiles, lane)
                        tiles, size = {}, 0
        yield _rows_of(tiles, lane)

    blocks = x.mapInArrow(cut, "row_block long, column_block int, y binary, n int")
    met = blocks.repartition("row_block").sortWithinPartitions("row_block", "column_block")
    products = met.mapInArrow(multiply, _PART)
    level = products.repartition("i", "j", "lane").sortWithinPartitions("i", "j", "lane").mapInArrow(_added, _PART).withColumn("lane", F.lit(0))
    total = level.repartition("i", "j").sortWithinPartitions("i", "j").mapInArrow(_added, _PART)
    v = np.zeros((d, d))
    for r in total.toArrow().to_pylist():  # d * d numbers
        a, b = cuts[r["i"]], cuts[r["j"]]
        block = np.frombuffer(r["product"]).reshape(min(tile, d - a), min(tile, d - b)) / sums.n
        v[a : a + tile, b : b + tile] = block
        v[b : b + tile, a : a + tile] = block.T
    return v


@dataclass
class Whitener:
    """What whitens a vector. axes: a column for each component, scaled; values: their eigenvalues; trace: that of the covariance."""

    sums: Sums
    axes: np.ndarray
    values: np.ndarray
    trace: float

    @property
    def explained(self) -> list[float]:
        return [float(e / self.trace) for e in self.values]


def fit(x: DataFrame, components: int = 8, tile: int = TILE) -> Whitener:
    """x: (id, x) of one width. Components come by falling eigenvalue, their largest entry positive; directions without spread are none."""
    sums = column_sums(x)
    if not sums.n:
        return Whitener(sums, np.zeros((0, 0)), np.zeros(0), 0.0)
    v = covariance(x, sums, tile)
    values, vectors = np.linalg.eigh(v)
    order = np.argsort(-values, kind="stable")[:components]
    order = order[values[order] > max(NOTHING * values[order[0]], 0.0)]
    axes = vectors[:, order]
    axes = axes * np.sign(axes[np.abs(axes).argmax(0), np.arange(len(order))])
    return Whitener(sums, axes / np.sqrt(values[order]), values[order], float(np.trace(v)))


def transform(x: DataFrame, model: Whitener) -> DataFrame:
    """(id, deviation, whitened) for each row of x: deviation is the sum of squares of n * x - sums, exact."""
    shared = x.sparkSession.sparkContext.broadcast(model)  # dimensions times components

    def run(batches):
        m = shared.value
        for batch in parts(batches, 4096):
            d = m.sums.centred(_matrix(batch))
            if d.dtype != object and (not d.size or float(np.abs(d).max()) ** 2 * d.shape[1] < 2.0**62):
                deviation = pa.array((d * d).sum(1), pa.int64()).cast(pa.decimal128(38, 0))
            else:
                deviation = pa.array([Decimal(int(s)) for s in (d.astype(object) ** 2).sum(1)], pa.decimal128(38, 0))
            w = d.astype(np.float64) / m.sums.n @ m.axes
            bounds = np.arange(len(w) + 1, dtype=np.int32) * w.shape[1]
            yield pa.RecordBatch.from_arrays([batch.column("id"), deviation, pa.ListArray.from_arrays(pa.array(bounds), pa.array(w.ravel()))], ["id", "deviation", "whitened"])

    return x.mapInArrow(run, "id long, deviation decimal(38,0), whitened array<double>")


def identity_error(whitened: DataFrame, k: int) -> float:
    """The largest absolute entry of the whitened rows' covariance minus the identity, by mergeable centred sums. No rows have none."""
    pairs = [(i, j) for i in range(k) for j in range(i, k)]
    w = F.col("whitened")
    found = whitened.agg(*(F.covar_pop(w[i], w[j]).alias(f"c{i}_{j}") for i, j in pairs)).first() if pairs else []
    return max((abs(c - (i == j)) for (i, j), c in zip(pairs, found, strict=True) if c is not None), default=0.0)


def whitening_report(vectors: DataFrame, components: int = 8, scale: int = 1024, offset: int = 100_000) -> DataFrame:
    """(vec_id, component, n, deviation, whitened, explained, identity_error) for each usable row of vectors (vec_id, embedding) and component.

    Rows that ``fixed_point`` leaves out have no result; rows that repeat each have theirs, and count each. A deviation beyond a long is
    null. If all vectors are equal, or there are none, there are no components and so no rows; other columns are passed over.
    """
    spark: SparkSession = vectors.sparkSession
    x = durable(fixed_point(vectors, scale, offset))
    model = fit(x, components)
    rows = durable(transform(x, model))
    k = len(model.values)
    error = identity_error(rows, k)
    if not k:
        return spark.createDataFrame([], "vec_id long, component int, n long, deviation long, whitened double, explained double, identity_error double")
    explained = F.array(*(F.lit(e) for e in model.explained))
    out = rows.select(F.col("id").alias("vec_id"), F.col("deviation").try_cast("long").alias("deviation"), F.posexplode("whitened").alias("at", "whitened"))
    return out.select(
        "vec_id", (F.col("at") + 1).cast("int").alias("component"), F.lit(model.sums.n).cast("long").alias("n"), "deviation", "whitened", explained[F.col("at")].alias("explained"), F.lit(error).cast("double").alias("identity_error")
    )
