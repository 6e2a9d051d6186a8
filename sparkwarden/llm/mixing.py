"""Mixing sources to target weights by pivotal dependent rounding.

A source's target is its share of the mix, capped; each of its documents should be taken target / size
times, which is a whole number of copies and a fractional one. Fractions are rounded in pairs: mass (copies
times words) moves from one document to the other, by a draw that keeps each document's expectation, until
one of the two is whole. The words of a pair stay as they were, so those of a source end within one
document of its target.

The rounding is a reduction tree: rows are dealt to groups of about GROUP by hash within their source, each
group leaves one fractional document at most, and those of FAN groups make a group of the next level.
"""

from __future__ import annotations

import hashlib
import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from sparkwarden.llm.session import durable, many_to_one

#: Rows of a group of the first level, and groups that make one of the next.
GROUP, FAN = 5_000, 1_000
_WHOLE = 1e-9


def _running(rows: DataFrame, order: list[F.Column], sums: dict[str, F.Column]) -> DataFrame:
    """rows with each of sums over the rows before in the order. Rows go to ranges; only the ranges' sums, a row for each partition, are ordered in one place."""
    rows = durable(rows.repartitionByRange(*order).withColumn("_part", F.spark_partition_id()))
    before = Window.partitionBy("_part").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    totals = rows.groupBy("_part").agg(*[F.sum(c).alias(f"_{name}") for name, c in sums.items()])
    parts = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    totals = totals.select("_part", *[F.coalesce(F.sum(f"_{name}").over(parts), F.lit(0)).alias(f"_{name}") for name in sums])
    out = rows.withColumns({name: F.coalesce(F.sum(c).over(before), F.lit(0)) for name, c in sums.items()}).join(F.broadcast(totals), "_part")
    return out.withColumns({name: F.col(name) + F.col(f"_{name}") for name in sums}).drop("_part", *[f"_{name}" for name in sums])


def source_targets(sizes: DataFrame, weights: tuple[float, ...], share: float, most: float) -> DataFrame:
    """(source, source_size, n_rows, target) out of (source, source_size, n_rows), a row for each source, however many there are.

    Sources by code point, null last, take the weights in turn. Each gets its weight's part of share times
    all words, at most ``most`` times its own; what is above goes to the others by weight. So a target is
    min(most * size, level * weight), and the level follows from sums over sources by size / weight.
    """
    order = [F.col("source").isNull(), F.encode("source", "UTF-8")]
    placed = _running(sizes, order, {"place": F.lit(1)})
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (F.pmod(F.col("place"), F.lit(len(weights))) + 1).cast("int"))
    weighed = placed.withColumn("weight", weight).drop("place").withColumn("cap", F.col("source_size") * F.lit(float(most))).withColumn("room", F.col("cap") / F.col("weight"))
    ordered = durable(_running(weighed, [F.col("room"), *order], {"caps": F.col("cap"), "weights": F.col("weight")}))
    words, weights_sum = ordered.agg(F.sum("source_size"), F.sum("weight")).first()
    level = (F.lit(float(words or 0) * share) - F.col("caps")) / (F.lit(float(weights_sum or 0)) - F.col("weights"))
    first = ordered.withColumn("level", level).where(F.col("level") <= F.col("room")).agg(F.min(F.struct("room", "level")).alias("f")).first()["f"]
    target = F.col("cap") if first is None else F.least("cap", F.lit(float(first["level"])) * F.col("weight"))
    return ordered.select("source", "source_size", "n_rows", target.alias("target"))


def _draw(seed: int, *names) -> float:
    return int.from_bytes(hashlib.blake2b(repr((seed, *names)).encode(), digest_size=7).digest(), "big") / 2.0**56


def pivot(names: list, sizes: list[int], parts: list[float], seed: int) -> tuple[list[int], tuple | None]:
    """Rounds parts; returns them, and (place, part) of one that is left fractional.

    The one that is carried on is always the smaller document, so what is left at last is small.
    """
    out = [0] * len(names)
    held, p = None, 0.0
    for i, q in enumerate(parts):
        if q <= _WHOLE or q >= 1 - _WHOLE:
            out[i] = int(q > 0.5)
            continue
        if held is None:
            held, p = i, q
            continue
        a, b = sizes[held], sizes[i]
        up = min((1 - p) * a, q * b)  # words that may move to held
        down = min(p * a, (1 - q) * b)
        move = up if _draw(seed, names[held], names[i]) * (up + down) < down else -down
        p, q = p + move / a, q - move / b
        left = []
        for j, x in ((held, p), (i, q)):
            if x <= _WHOLE or x >= 1 - _WHOLE:
                out[j] = int(x > 0.5)
            else:
                left.append((j, x))
        held, p = left[0] if left else (None, 0.0)
    return out, None if held is None else (held, p)


def _round_groups(seed: int, last: bool):
    """Rows come sorted by group and then largest first; a group may go over batches. Gives each row's extra copies, or null and its part."""

    def run(batches):
        held, at = [], None

        def done():
            t = pa.Table.from_batches(held).combine_chunks()
            names, sizes, parts = (t.column(c).to_pylist() for c in ("name", "size", "part"))
            extra, left = pivot(names, sizes, parts, seed)
            kept = list(parts)
            if left is not None:
                i, p = left
                kept[i] = p
                extra[i] = int(_draw(seed, names[i], "last") < p) if last else None
            return pa.RecordBatch.from_arrays(
                [t.column("name").combine_chunks(), t.column("group").combine_chunks(), t.column("size").combine_chunks(), pa.array(kept, pa.float64()), pa.array(extra, pa.int64())],
                ["name", "group", "size", "part", "extra"],
            )

        for batch in batches:
            if not batch.num_rows:
                continue
            g = batch.column("group").to_numpy(zero_copy_only=False)
            cuts = [0, *(np.flatnonzero(g[1:] != g[:-1]) + 1), len(g)]
            for s, e in zip(cuts[:-1], cuts[1:], strict=True):
                if held and g[s] != at:
                    yield done()
                    held = []
                at = g[s]
                held.append(batch.slice(s, e - s))
        if held:
            yield done()

    return run


def mix(docs: DataFrame, weights: tuple[float, ...] = (3, 1, 2), share: float = 1.5, most: float = 2.0, seed: int = 17, group: int = GROUP, fan: int = FAN) -> DataFrame:
    """(doc_id, row, size, source_size, target, copies, taken) for each row of docs (doc_id, text, source).

    size: words ``[^\\x20\\x09-\\x0D]+`` of the whole text, null: 0. copies are how often the mix takes the row,
    taken the words. Rows without words are never taken. row names a row's id and text; rows alike
    in id, text and source are told apart by a running number, so reruns give the same rows. Null ids and sources are
    values like others; texts of any length are counted whole; an empty table, or one without words, gives
    targets of 0; other columns, whatever their names, are passed over.
    """
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    # Words are counted by the runs of white space that they would leave: no list of words is made.
    squeezed = F.regexp_replace(F.translate(text, "\t\n\x0b\x0c\r", "     "), "[^ ]+", "x")
    size = F.length(F.replace(squeezed, F.lit(" "), F.lit(""))).cast("long")
    base = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("source").cast("string").alias("source"), size.alias("size"), F.xxhash64(text).alias("version"))
    rows = durable(base.groupBy("doc_id", "source", "size", "version").agg(F.count("*").alias("times")))
    sizes = rows.groupBy("source").agg(F.sum(F.col("size") * F.col("times")).alias("source_size"), F.sum("times").alias("n_rows"))
    targets = durable(source_targets(sizes, weights, share, most).withColumn("tree", F.coalesce(F.concat(F.lit("s"), "source"), F.lit("none"))))
    ratio = F.when(F.col("source_size") > 0, F.least(F.lit(float(most)), F.col("target") / F.col("source_size"))).otherwise(F.lit(0.0))
    placed = rows.withColumn("tree", F.coalesce(F.concat(F.lit("s"), "source"), F.lit("none")))
    placed = many_to_one(placed, targets.drop("source"), ["tree"], targets.select("tree", F.col("n_rows").alias("rows")))
    # Rows that repeat are told apart in two steps, so that none makes a long list at once.
    many = placed.withColumn("thousand", F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("times") - 1) / 1000))))
    each = many.withColumn("nth", F.explode(F.sequence(F.col("thousand") * 1000 + 1, F.least("times", F.col("thousand") * 1000 + 1000))))
    each = each.withColumn("ratio", ratio).withColumn("name", F.concat_ws(":", F.coalesce(F.col("doc_id").cast("string"), F.lit("null")), "version", "nth", F.xxhash64("source")))
    each = each.withColumn("whole", F.floor("ratio")).withColumn("part", F.when(F.col("size") > 0, F.col("ratio") - F.col("whole")).otherwise(F.lit(0.0)))
    each = durable(each.select("doc_id", "version", "nth", "source", "name", "size", "source_size", "n_rows", "target", "whole", "part"))

    deal = F.pmod(F.xxhash64("name", F.lit(seed)), F.ceil(F.col("n_rows") / group)).cast("long")
    level = each.select("name", F.xxhash64("source").alias("tree"), deal.alias("slot"), "size", "part", "n_rows").where(f"part > {_WHOLE} and part < 1 - {_WHOLE}")
    most_groups = math.ceil((targets.agg(F.max("n_rows")).first()[0] or 0) / group)
    settled, schema = None, "name string, group long, size long, part double, extra long"
    while True:
        last = most_groups <= 1
        keyed = level.select("name", F.xxhash64("tree", "slot").alias("group"), "tree", "slot", "size", "part")
        sent = keyed.select("name", "group", "size", "part").repartition("group").sortWithinPartitions("group", F.desc("size"), "name")
        done = durable(sent.mapInArrow(_round_groups(seed, last), schema))
        some = done.where("extra is not null").select("name", "extra")
        settled = some if settled is None else settled.union(some)
        if last:
            break
        slots = keyed.select("name", "tree", "slot")
        level = done.where("extra is null").select("name", "size", "part").join(slots, "name").withColumn("slot", F.floor(F.col("slot") / fan))
        most_groups = math.ceil(most_groups / fan)
    copies = F.col("whole") + F.coalesce("extra", (F.col("part") >= 1 - _WHOLE).cast("long"))
    out = each.join(settled, "name", "left").withColumn("copies", F.when(F.col("size") > 0, copies).otherwise(F.lit(0)).cast("long"))
    return out.select("doc_id", "version", "nth", "source", "size", "source_size", "target", "copies", (F.col("copies") * F.col("size")).alias("taken"))
