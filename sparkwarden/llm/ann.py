"""Nearest neighbours by inner product with an inverted multi-index.

The two halves of the vectors are quantised apart, so K centroids for each make K * K cells. A query goes through
pairs of centroids by the sum of their nearness to its halves, highest first, with a heap. How far it goes is
estimated: the sample tells about which score its k-th neighbour has, and how far true scores lie from those of
the cells, hence how many neighbours each cell should hold; it stops once the cells seen hold SURE of them. Where vectors
form clusters that is a few cells, where they are noise it is a large part. Entries in these cells are ranked by the true measure.

Shards are runs of cells of about equal size; a cell that is larger than a shard goes over several, by hash. A query goes
only to the shards of its cells. An entry goes to its shard once, or, where many queries want the shard, once for
each BLOCK of them. Neither an index nor a set of queries is ever whole in one place: only centroids, the sample and
the cells' counts are.
"""

from __future__ import annotations

import heapq
import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from sparkwarden.llm.session import FEW, durable

#: Vectors that centroids and residuals are fitted on (as expected; drawn by a hash of id and vector), centroids for a half at least and at most
#: (a quarter of the root of the entries' number in between), and the part of its neighbours that a query's cells should hold.
SAMPLE, LEAST, MOST, SURE = 20_000, 8, 1024, 0.95
#: Entries in a shard at most and shards at least; queries of a shard that one task answers.
SHARD, SHARDS, BLOCK = 100_000, 12, 100_000
#: Products that are worked on at a time.
_STEP = 1 << 22


def kmeans(x: np.ndarray, k: int, rounds: int = 12, seed: int = 5) -> np.ndarray:
    """Centroids of x; fewer if it has fewer distinct rows."""
    start = np.unique(x, axis=0)
    start = start[np.random.default_rng(seed).permutation(len(start))[:k]]
    for _ in range(rounds):
        near = _nearest(x, start)
        for j in range(len(start)):
            if len(own := x[near == j]):
                start[j] = own.mean(0)
    return start


def _nearest(x: np.ndarray, c: np.ndarray) -> np.ndarray:
    return (x @ c.T - 0.5 * (c * c).sum(1)).argmax(1)


def traverse(a: np.ndarray, b: np.ndarray, weight: np.ndarray, want: float) -> list[tuple[int, int]]:
    """Pairs (i, j) by a[i] + b[j], highest first, until their weights reach want; those without weight are passed."""
    ia, ib = np.argsort(-a, kind="stable"), np.argsort(-b, kind="stable")
    heap, seen, out, got = [(-(a[ia[0]] + b[ib[0]]), 0, 0)], {(0, 0)}, [], 0.0
    while heap and got < want:
        _, p, q = heapq.heappop(heap)
        i, j = int(ia[p]), int(ib[q])
        if weight[i, j] > 0:
            out.append((i, j))
            got += float(weight[i, j])
        for n in ((p + 1, q), (p, q + 1)):
            if n[0] < len(ia) and n[1] < len(ib) and n not in seen:
                seen.add(n)
                heapq.heappush(heap, (-(a[ia[n[0]]] + b[ib[n[1]]]), *n))
    return out


def _above(z: np.ndarray) -> np.ndarray:
    """The share of a normal distribution above z, to five digits."""
    t = 1 / (1 + 0.2316419 * np.abs(z))
    tail = np.exp(-0.5 * z * z) / math.sqrt(2 * math.pi) * t * (0.319381530 + t * (-0.356563782 + t * (1.781477937 + t * (-1.821255978 + t * 1.330274429))))
    return np.where(z >= 0, tail, 1 - tail)


class Index:
    """What is fitted: centroids of both halves, cells' counts, the sample and how its residuals spread."""

    def __init__(self, sample: np.ndarray, centroids: int):
        self.width, self.half = sample.shape[1], sample.shape[1] // 2
        self.a, self.b = kmeans(sample[:, : self.half], centroids), kmeans(sample[:, self.half :], centroids)
        self.sample = sample.astype(np.float32)
        rest = sample - np.concatenate([self.a[_nearest(sample[:, : self.half], self.a)], self.b[_nearest(sample[:, self.half :], self.b)]], 1)
        self.spread = rest.T @ rest / len(rest)
        self.counts = np.zeros((len(self.a), len(self.b)), np.int64)

    def cell(self, x: np.ndarray) -> np.ndarray:
        return _nearest(x[:, : self.half], self.a) * len(self.b) + _nearest(x[:, self.half :], self.b)

    def threshold(self, q: np.ndarray, k: int) -> float:
        """About the k-th best score of q among all entries, from the sample's; beyond its best by its tail."""
        s, n = -np.sort(-(self.sample @ q.astype(np.float32))), max(1, int(self.counts.sum()))
        rank = k * len(s) / n
        if rank >= 1:
            return float(s[min(len(s), math.ceil(rank)) - 1])
        m = min(10, len(s))
        return float(s[0] + (s[0] - s[m - 1]) / max(math.log(m), 1) * math.log(1 / rank))

    def cells(self, q: np.ndarray, k: int, sure: float) -> list[tuple[int, int]]:
        """The cells that q should see, best first."""
        a, b = self.a @ q[: self.half], self.b @ q[self.half :]
        sigma = math.sqrt(max(1e-18, float(q @ self.spread @ q)))
        weight = self.counts * _above((self.threshold(q, k) - (a[:, None] + b[None])) / sigma)
        weight[self.counts > 0] += 1e-12
        return traverse(a, b, weight, sure * float(weight.sum()) if sure < 1 else math.inf)


def _matrix(column: pa.ChunkedArray | pa.Array, width: int) -> np.ndarray:
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, width)


def exact_products(q: np.ndarray, e: np.ndarray) -> np.ndarray:
    """Inner products of rows, added up from the first component on, so equal vectors give equal numbers."""
    out = np.zeros(len(e))
    for d in range(e.shape[1]):
        out += q[..., d] * e[:, d]
    return out


def _assign(shared):
    def run(batches):
        index = shared.value
        for b in batches:
            cell = index.cell(_matrix(b.column("vector"), index.width))
            yield pa.RecordBatch.from_arrays([b.column("vec_id"), b.column("vector"), pa.array(cell.astype(np.int32))], ["vec_id", "vector", "cell"])

    return run


class Shards:
    """Cells' places end to end; a shard is a run of ``size`` places. An entry's place in its cell is drawn by hash."""

    def __init__(self, counts: np.ndarray, size: int):
        self.size, self.ends = size, np.cumsum(counts.ravel())
        self.begins = self.ends - counts.ravel()

    def of(self, cell: int) -> range:
        return range(int(self.begins[cell]) // self.size, (int(self.ends[cell]) - 1) // self.size + 1)


def _plan(shared, size: int, k: int, sure: float):
    """Queries with the cells to see, by shard: lists of cells as bytes."""

    def run(batches):
        index = shared.value
        shards = Shards(index.counts, size)
        for b in batches:
            visits = []
            for row in _matrix(b.column("vector"), index.width):
                by: dict[int, list[int]] = {}
                for i, j in index.cells(row, k, sure):
                    cell = i * len(index.b) + j
                    for s in shards.of(cell):
                        by.setdefault(s, []).append(cell)
                visits.append([{"shard": s, "cells": np.array(sorted(c), np.int32).tobytes()} for s, c in by.items()])
            kind = pa.list_(pa.struct([("shard", pa.int32()), ("cells", pa.binary())]))
            yield pa.RecordBatch.from_arrays([b.column("vec_id"), b.column("vector"), pa.array(visits, kind)], ["vec_id", "vector", "visits"])

    return run


class _Entries:
    """A shard's entries by cell."""

    def __init__(self, held: list[pa.RecordBatch], width: int, cells: int):
        t = pa.Table.from_batches(held)
        cell = t.column("cell").to_numpy()
        order = np.argsort(cell, kind="stable")
        self.ids, self.cell, self.x = t.column("vec_id").to_numpy()[order], cell[order], _matrix(t.column("vector"), width)[order]
        self.first = np.searchsorted(self.cell, np.arange(cells + 1))
        self.cells = cells

    def best(self, ids: list[int], q: np.ndarray, cells: list[bytes], k: int):
        """(query_id, vec_id, score) of the k best of each query's cells. Where cells are few only they are gone through."""
        step = max(1, _STEP // max(1, len(self.ids)))
        for at in range(0, len(ids), step):
            seen = [np.frombuffer(c, np.int32) for c in cells[at : at + step]]
            sizes = [int((self.first[c + 1] - self.first[c]).sum()) for c in seen]
            many = sum(sizes) * 4 > len(self.ids) * len(seen)
            rough = self.x @ q[at : at + step].T if many else None
            for n, own in enumerate(seen):
                if many:
                    mask = np.zeros(self.cells, bool)
                    mask[own] = True
                    rows = np.flatnonzero(mask[self.cell] & (self.ids != ids[at + n]))
                    score = rough[rows, n]
                else:
                    rows = np.concatenate([np.arange(self.first[c], self.first[c + 1]) for c in own] or [np.zeros(0, int)])
                    rows = rows[self.ids[rows] != ids[at + n]]
                    score = self.x[rows] @ q[at + n]
                if len(rows) > k:
                    floor = np.partition(score, len(rows) - k)[len(rows) - k]
                    rows = rows[score >= floor - 1e-9 * (1 + abs(floor))]
                score = exact_products(q[at + n], self.x[rows])
                top = np.lexsort((self.ids[rows], -score))[:k]
                yield ids[at + n], self.ids[rows[top]], score[top]


def _search(k: int, width: int, cells: int):
    """Rows come sorted by shard and block, entries before queries; queries pass by, a batch at a time."""

    def run(batches):
        at, held, entries = None, [], None
        for batch in batches:
            out = [[], [], []]
            where = batch.column("shard").to_numpy().astype(np.int64) * (1 << 32) + batch.column("block").to_numpy()
            asks = batch.column("asks").to_numpy(zero_copy_only=False)
            change = np.flatnonzero((where[1:] != where[:-1]) | (asks[1:] != asks[:-1])) + 1
            cuts = [0, *change.tolist(), batch.num_rows]
            for s, e in zip(cuts[:-1], cuts[1:], strict=True):
                if s == e:
                    continue
                if where[s] != at:
                    at, held, entries = where[s], [], None
                part = batch.slice(s, e - s)
                if not asks[s]:
                    held.append(part.select(["vec_id", "vector", "cell"]))
                    continue
                if not held:
                    continue
                entries = entries or _Entries(held, width, cells)
                for q, ids, score in entries.best(part.column("vec_id").to_pylist(), _matrix(part.column("vector"), width), part.column("cells").to_pylist(), k):
                    out[0].append(np.full(len(ids), q))
                    out[1].append(ids)
                    out[2].append(score)
            kinds = (pa.int64(), pa.int64(), pa.float64())
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(c) if c else [], t) for c, t in zip(out, kinds, strict=True)], ["query_id", "vec_id", "score"])

    return run


def usable(vectors: DataFrame, id_column: str = "vec_id", vector_column: str = "embedding") -> DataFrame:
    """(vec_id, vector) of the rows that take part: an id, and a vector without null or non-finite components that isn't zero."""
    v = F.col(vector_column).cast("array<double>")
    good = F.forall(v, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) != float("inf"))) & F.exists(v, lambda c: c != 0)
    return vectors.select(F.col(id_column).cast("long").alias("vec_id"), v.alias("vector")).where(F.col("vec_id").isNotNull() & F.col("vector").isNotNull()).where(good)


def search(vectors: DataFrame, every: int = 20, k: int = 20, sure: float = SURE, centroids: int | None = None, shard: int = SHARD, block: int = BLOCK) -> DataFrame:
    """(query_id, rank, vec_id, score): for each row of vectors (vec_id, embedding) whose id ``every`` divides, its k nearest among all other ids.

    Nearness is the inner product in double precision; ties go to the smaller id. Rows that ``usable`` leaves out take
    no part; of vectors of several widths the shorter ones count as filled up with zeros. Rows that repeat an id and its vector are
    one candidate; those that repeat an id with other vectors each are one, and as queries share their ranks. No usable rows give none.
    """
    rows = usable(vectors)
    width = rows.agg(F.max(F.size("vector"))).first()[0]
    if not width:
        return vectors.sparkSession.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    filled = F.concat("vector", F.array_repeat(F.lit(0.0), F.lit(width) - F.size("vector")))
    rows = durable(rows.select("vec_id", filled.alias("vector")).dropDuplicates(["vec_id", "vector"]))
    n = rows.count()
    draw = F.pmod(F.xxhash64("vec_id", "vector"), F.lit(1 << 40))
    drawn = rows if n <= SAMPLE else rows.where(draw < F.lit(int((1 << 40) * SAMPLE / n)))
    sample = _matrix(drawn.orderBy("vec_id", "vector").select("vector").toArrow().column("vector"), width)
    if not len(sample):
        sample = _matrix(rows.limit(1).toArrow().column("vector"), width)
    index = Index(sample, centroids or min(MOST, max(LEAST, math.isqrt(n // 16))))
    spark = vectors.sparkSession
    entries = durable(rows.mapInArrow(_assign(spark.sparkContext.broadcast(index)), "vec_id long, vector array<double>, cell int"))
    for cell, c in entries.groupBy("cell").count().collect():  # a row for each cell at most
        index.counts[divmod(cell, len(index.b))] = c
    size = max(1, min(shard, -(-n // SHARDS)))
    places = Shards(index.counts, size)
    shared = spark.sparkContext.broadcast(index)
    asked = rows.where(F.col("vec_id") % every == 0)
    planned = durable(asked.mapInArrow(_plan(shared, size, k, sure), "vec_id long, vector array<double>, visits array<struct<shard:int,cells:binary>>"))
    visits = planned.select("vec_id", "vector", F.inline("visits"))
    wanted = durable(visits.groupBy("shard").agg(F.ceil(F.count("*") / block).cast("int").alias("blocks")))
    if wanted.count() <= FEW:
        wanted = F.broadcast(wanted)

    def located(batches):
        begins, ends = places.begins, places.ends
        for b in batches:
            cell, u = b.column("cell").to_numpy(), b.column("u").to_numpy()
            place = begins[cell] + np.minimum((u * (ends[cell] - begins[cell])).astype(np.int64), ends[cell] - begins[cell] - 1)
            yield pa.RecordBatch.from_arrays([b.column("vec_id"), b.column("vector"), b.column("cell"), pa.array((place // size).astype(np.int32))], ["vec_id", "vector", "cell", "shard"])

    u = F.pmod(F.xxhash64("vec_id", "vector", F.lit(3)), F.lit(1 << 40)) / float(1 << 40)
    sent = entries.withColumn("u", u).mapInArrow(located, "vec_id long, vector array<double>, cell int, shard int").join(wanted, "shard")
    sent = sent.select("shard", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("block"), F.lit(False).alias("asks"), "vec_id", "vector", "cell", F.lit(None).cast("binary").alias("cells"))
    asks = visits.join(wanted, "shard").withColumn("block", F.pmod(F.xxhash64("vec_id", "vector"), F.col("blocks")).cast("int"))
    asks = asks.select("shard", "block", F.lit(True).alias("asks"), "vec_id", "vector", F.lit(None).cast("int").alias("cell"), "cells")
    dealt = sent.unionByName(asks).repartition("shard", "block").sortWithinPartitions("shard", "block", "asks")
    found = dealt.mapInArrow(_search(k, width, index.counts.size), "query_id long, vec_id long, score double")
    by_query = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    ranked = found.withColumn("rank", F.row_number().over(by_query)).where(F.col("rank") <= k)
    return ranked.select("query_id", "rank", "vec_id", "score")
