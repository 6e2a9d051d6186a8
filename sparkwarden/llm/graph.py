"""Connected components of a set of links, as a DataFrame loop."""

from __future__ import annotations

import math

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sparkwarden.llm.session import durable

#: Links that one task holds at a time.
LOCAL = 100_000


def _forest(batches):
    """(node, root): each node of a part's links with the smallest node that it reaches by them, but for those roots themselves."""
    t = pa.Table.from_batches(list(batches))
    u, v = t.column("u").to_pylist(), t.column("v").to_pylist()
    names = sorted({*u, *v})
    at = {name: i for i, name in enumerate(names)}
    root = list(range(len(names)))

    def find(i: int) -> int:
        while root[i] != i:
            root[i] = root[root[i]]
            i = root[i]
        return i

    for a, b in zip(u, v, strict=True):
        a, b = find(at[a]), find(at[b])
        root[max(a, b)] = min(a, b)
    pairs = [(i, find(i)) for i in range(len(names))]
    pairs = [p for p in pairs if p[0] != p[1]]
    kind = t.schema.field("u").type
    for s in range(0, len(pairs), 10_000):
        part = pairs[s : s + 10_000]
        yield pa.RecordBatch.from_arrays([pa.array([names[p[k]] for p in part], kind) for k in (0, 1)], ["u", "v"])


def components(links: DataFrame, a: str = "a", b: str = "b", local: int = LOCAL) -> DataFrame:
    """(node, comp): each node of a link with the smallest node that it reaches.

    Links are dealt to parts of about ``local``, and each becomes a forest of as few links, as long as that makes them
    fewer; they are read twice, so they should be rows that are there already. Few links need one part, and its forest is the answer. Beyond it labels spread: each round takes the
    least label among a node's neighbours, then the label of that label, so chains shorten by half a round. Labels only
    go down, so rounds end by themselves, whatever the shape. Nothing is collected. Null ends are left out. No links give no rows.
    """
    ends = links.select(F.col(a).alias("u"), F.col(b).alias("v")).where("u is not null and v is not null and u != v")
    edges = ends.distinct()
    n, schema = edges.count(), ", ".join(f"{name} {kind}" for name, kind in ends.dtypes)
    while n:
        parts = math.ceil(n / local)
        forest = durable((edges.coalesce(1) if parts == 1 else edges.repartition(parts)).mapInArrow(_forest, schema))
        if parts == 1:
            roots = forest.select(F.col("v").alias("u"), "v").distinct().coalesce(1)
            return forest.union(roots).select(F.col("u").alias("node"), F.col("v").alias("comp"))
        m, edges = forest.count(), forest
        if m > 0.75 * n:
            break
        n = m
    return _spread(edges)


def _spread(edges: DataFrame) -> DataFrame:
    both = durable(edges.union(edges.select("v", "u")).distinct())
    labels = durable(both.groupBy("u").agg(F.min("v").alias("v")).select(F.col("u").alias("node"), F.least("u", "v").alias("comp")))
    while True:
        near = both.join(labels.select(F.col("node").alias("v"), "comp"), "v").groupBy(F.col("u").alias("node")).agg(F.min("comp").alias("other"))
        lower = labels.join(near, "node").select("node", F.col("comp").alias("was"), F.least("comp", "other").alias("comp"))
        heads = labels.select(F.col("node").alias("comp"), F.col("comp").alias("head"))
        step = lower.join(heads, "comp").select("node", F.least("comp", "head").alias("comp"), (F.least("comp", "head") != F.col("was")).alias("moved"))
        step = durable(step)
        labels = step.select("node", "comp")
        if step.where("moved").isEmpty():
            return labels
