"""Alignment of two tokenizers' tokens by byte-owner arrays.

A text is taken with a space before it, as sentencepiece does by itself. The token that owns each byte is written down for
both tokenizers, by repeating token numbers as often as they have bytes. Where either owner changes an overlap begins: consecutive
distinct pairs of owners are the overlaps. Where both change at once, no token reaches over: there the text is cut into groups, and
the tokens that end there are linked.

How often two ids are linked is counted over all texts: tasks add up their own pairs, and Spark adds up the tasks'. A text's links
are kept as its distinct pairs and how often each occurs, so texts are encoded once. They are looked up in the table of all
pairs where that is small (FEW pairs), else joined with it.
"""

from __future__ import annotations

import hashlib
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sparkwarden.llm.packed import pack, small, unpack
from sparkwarden.llm.session import durable, many_to_one, parts
from sparkwarden.llm.tokens import Vocabulary, pieces

#: Bytes of texts that are encoded and aligned at a time; a longer text is by itself.
BATCH_BYTES = 1 << 18
#: Distinct pairs, of 17 bytes each, up to which their table goes to every task; pairs that a task holds before it sends them on.
FEW, HELD = 4_000_000, 500_000


@lru_cache(maxsize=4)
def _vocabulary(path: str) -> Vocabulary:
    return Vocabulary(path)


class Aligned:
    """Some texts' tokens. ids of both sides end to end, first[side]: tokens before each text, and in all. Texts without tokens have none on either side."""

    def __init__(self, texts: list[str], sides: tuple[Vocabulary, Vocabulary]):
        whole = [" " + t for t in texts]
        split = all(s.splits for s in sides)
        cut = [pieces(t) if split else [t] for t in whole]
        flat, of = [p for c in cut for p in c], np.repeat(np.arange(len(texts)), [len(c) for c in cut])
        data = "".join(whole).encode()
        bounds = np.concatenate(([0], np.cumsum([len(t.encode()) for t in whole])))
        good, ids, count = np.array([t != "" for t in texts], bool), [], []
        for side in sides:
            found = side.encode(flat)
            n = np.array([len(x) for x in found], np.int64)
            each = np.fromiter((i for x in found for i in x), np.int64, int(n.sum()))
            text = np.repeat(of, n)
            good &= np.bincount(text, side.size[each], len(texts)).astype(np.int64) == np.diff(bounds)
            ids.append((each, text))
        for (each, text), side in zip(ids, sides, strict=True):  # sizes agree: do bytes?
            kept = good[text]
            here = np.concatenate([np.frombuffer(data, np.uint8)[bounds[i] : bounds[i + 1]] for i in np.flatnonzero(good)]) if good.any() else np.zeros(0, np.uint8)
            wrong = np.flatnonzero(side.spread(each[kept]) != here)
            starts = np.concatenate(([0], np.cumsum(np.diff(bounds)[good])))[:-1]
            if len(wrong):
                good[np.unique(np.flatnonzero(good)[np.searchsorted(starts, wrong, "right") - 1])] = False
        for each, text in ids:
            kept = good[text]
            count.append(np.bincount(text[kept], minlength=len(texts)))
        self.a, self.b = (each[good[text]] for each, text in ids)
        self.count = count
        self.first = [np.concatenate(([0], np.cumsum(c))) for c in count]
        self._own(sides)

    def _own(self, sides: tuple[Vocabulary, Vocabulary]) -> None:
        owner = [np.repeat(np.arange(len(x)), side.size[x]) for x, side in zip((self.a, self.b), sides, strict=True)]
        n = len(owner[0])
        new = [np.diff(o, append=-1) != 0 for o in owner]  # the byte is its owner's last
        last = np.flatnonzero(new[0] | new[1])
        self.overlap_a, self.overlap_b = owner[0][last], owner[1][last]
        self.overlap_bytes = np.diff(last, prepend=-1)
        self.cut = np.flatnonzero(new[0] & new[1]) if n else np.zeros(0, np.int64)
        self.end_a, self.end_b = owner[0][self.cut], owner[1][self.cut]  # the tokens that end a group
        #: groups and overlaps before each text, and in all
        self.groups_before = np.searchsorted(self.end_a, self.first[0])
        self.overlaps_before = np.searchsorted(self.overlap_a, self.first[0])

    def digests(self) -> list[str]:
        """sha256 of a1,a2|b1;a3|b2,b3 for each text; of texts without tokens ''."""
        ends = [np.zeros(len(x), bool) for x in (self.a, self.b)]
        ends[0][self.end_a], ends[1][self.end_b] = True, True
        group = [np.cumsum(e) - e for e in ends]
        order = np.argsort(np.concatenate((2 * group[0], 2 * group[1] + 1)), kind="stable")
        last = np.zeros(len(self.b), bool)
        last[self.first[1][1:][self.count[1] > 0] - 1] = True
        mark = np.concatenate((np.where(ends[0], 1, 0), np.where(last, 3, np.where(ends[1], 2, 0))))
        data, offset, size = _numerals(int(max(self.a.max(initial=0), self.b.max(initial=0))) + 1)
        entry = (np.concatenate((self.a, self.b)) * 4 + mark)[order]
        each = size[entry]
        before = np.cumsum(each) - each
        flat = data[np.repeat(offset[entry] - before, each) + np.arange(int(each.sum()))].tobytes()
        bounds = np.concatenate(([0], np.cumsum(each)))[self.first[0] + self.first[1]]
        return [hashlib.sha256(flat[s:e]).hexdigest() if e > s else "" for s, e in zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True)]

    def pairs(self) -> np.ndarray:
        """Both ids of each link, as one number."""
        return (self.a[self.end_a] << 32) | self.b[self.end_b]


@lru_cache(maxsize=2)
def _numerals(n: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Ids as decimals, each before a comma, a bar, a semicolon and nothing."""
    each = [f"{i}{mark}".encode() for i in range(n) for mark in (",", "|", ";", "")]
    size = np.array([len(x) for x in each], np.int64)
    return np.frombuffer(b"".join(each), np.uint8), np.concatenate(([0], np.cumsum(size)))[:-1], size


def _aligned(batches, a: str, b: str):
    """(place in the batch, the batch, Aligned) of about BATCH_BYTES at a time."""
    sides = _vocabulary(a), _vocabulary(b)
    for batch in parts(batches):
        texts = batch.column("text").fill_null("").to_pylist()
        start, size = 0, 0
        for i, t in enumerate(texts):
            if i > start and size + len(t) > BATCH_BYTES:
                yield batch.slice(start, i - start), Aligned(texts[start:i], sides)
                start, size = i, 0
            size += len(t)
        if texts:
            yield batch.slice(start), Aligned(texts[start:], sides)


def _lists(values: np.ndarray, bounds: np.ndarray) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(bounds.astype(np.int32)), pa.array(values.astype(np.int32), pa.int32()))


def alignments(docs: DataFrame, a: str, b: str) -> DataFrame:
    """The alignment of each row of docs (doc_id, text) in full: (doc_id, a_ids, b_ids, overlap_a, overlap_b, overlap_bytes, end_a, end_b).

    Overlap k is of token overlap_a[k] and token overlap_b[k], by place in the text, and has overlap_bytes[k] bytes. Group k ends with the tokens
    end_a[k] and end_b[k]. a, b: files that every worker has. Texts that are null or empty, or that a tokenizer changes (so that its tokens' bytes
    are not a space and the text) have empty lists. Rows are taken one by one, also where they repeat; long texts whole; other columns are passed over.
    """

    def run(batches):
        for batch, x in _aligned(batches, a, b):
            of_a, of_b = x.first
            less = lambda v, before, bounds: v - np.repeat(before[:-1], np.diff(bounds))
            cols = [_lists(x.a, of_a), _lists(x.b, of_b)]
            o, g = x.overlaps_before, x.groups_before
            cols += [_lists(less(x.overlap_a, of_a, o), o), _lists(less(x.overlap_b, of_b, o), o), _lists(x.overlap_bytes, o)]
            cols += [_lists(less(x.end_a, of_a, g), g), _lists(less(x.end_b, of_b, g), g)]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *cols], ["doc_id", "a_ids", "b_ids", "overlap_a", "overlap_b", "overlap_bytes", "end_a", "end_b"])

    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    lists = ", ".join(f"{n} array<int>" for n in ("a_ids", "b_ids", "overlap_a", "overlap_b", "overlap_bytes", "end_a", "end_b"))
    return texts.mapInArrow(run, f"doc_id long, {lists}")


_READ = "doc_id long, n_a long, n_b long, n_groups long, groups_sha256 string, pairs binary, times binary"


def _read(a: str, b: str):
    """A row for each text with its distinct pairs; rows without a digest have pairs of many texts, to be added up."""

    def run(batches):
        held = np.zeros((2, 0), np.int64)
        names = [c.split()[0] for c in _READ.split(", ")]
        kinds = [pa.int64()] * 4 + [pa.string()] + [pa.binary()] * 2

        def sums() -> pa.RecordBatch:
            row = [None, None, None, None, None, pack(held[0]), pack(held[1])]
            return pa.RecordBatch.from_arrays([pa.array([v], k) for v, k in zip(row, kinds, strict=True)], names)

        def added(x: np.ndarray, n: np.ndarray) -> np.ndarray:
            pair, at = np.unique(x, return_inverse=True)
            return np.stack((pair, np.bincount(at, n, len(pair)).astype(np.int64)))

        for batch, x in _aligned(batches, a, b):
            links, g = x.pairs(), x.groups_before
            packed, times = [], []
            for s, e in zip(g[:-1].tolist(), g[1:].tolist(), strict=True):
                pair, n = np.unique(links[s:e], return_counts=True)
                packed.append(pack(pair))
                times.append(pack(small(n)))
            held = added(np.concatenate((held[0], links)), np.concatenate((held[1], np.ones(len(links), np.int64))))
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array(x.count[0], pa.int64()), pa.array(x.count[1], pa.int64()), pa.array(np.diff(g), pa.int64()), pa.array(x.digests(), pa.string()), pa.array(packed, pa.binary()), pa.array(times, pa.binary())],
                names,
            )
            if held.shape[1] > HELD:
                yield sums()
                held = np.zeros((2, 0), np.int64)
        if held.shape[1]:
            yield sums()

    return run


def _unpacked(batches):
    for batch in batches:
        for row, pairs, times in zip(*(batch.column(c).to_pylist() for c in ("row", "pairs", "times")), strict=True):
            pair = unpack(pairs)
            for s in range(0, len(pair), 1 << 16):
                p = pair[s : s + (1 << 16)]
                yield pa.RecordBatch.from_arrays([pa.array([row] * len(p), pa.int64()), pa.array(p), pa.array(unpack(times, np.uint64)[s : s + (1 << 16)].astype(np.int64))], ["row", "pair", "times"])


def _looked_up(shared):
    def run(batches):
        pair, count, best = shared.value
        for batch in parts(batches):
            mine = [unpack(x) for x in batch.column("pairs").to_pylist()]
            times = np.concatenate([unpack(x, np.uint64).astype(np.int64) for x in batch.column("times").to_pylist()] or [np.zeros(0, np.int64)])
            at = np.searchsorted(pair, np.concatenate(mine) if mine else np.zeros(0, np.int64))
            bounds = np.concatenate(([0], np.cumsum([len(x) for x in mine]))).astype(np.int64)
            total = lambda v: np.diff(np.concatenate(([0], np.cumsum(v)))[bounds])
            found = [batch.column("doc_id"), batch.column("n_a"), batch.column("n_b"), batch.column("n_groups")]
            found += [pa.array(total(x).astype(np.int64)) for x in (times, times * best[at], times * count[at])]
            yield pa.RecordBatch.from_arrays([*found, batch.column("groups_sha256")], ["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"])

    return run


def pair_table(read: DataFrame) -> DataFrame:
    """(pair, count, best) over all texts: best says that no other pair of its id of the second tokenizer occurs more often."""
    sums = read.where("groups_sha256 is null").select(F.lit(0).cast("long").alias("row"), "pairs", "times")
    counts = durable(sums.mapInArrow(_unpacked, "row long, pair long, times long").groupBy("pair").agg(F.sum("times").alias("count")))
    of_b = F.col("pair").bitwiseAND(F.lit(0xFFFFFFFF))
    most = counts.groupBy(of_b.alias("b")).agg(F.max("count").alias("most"))
    return durable(counts.withColumn("b", of_b).join(most, "b").select("pair", "count", (F.col("count") == F.col("most")).alias("best")))


def partners(docs: DataFrame, a: str, b: str) -> DataFrame:
    """(a_id, b_id, count, best): how often tokens of both ids end together in the texts of docs (doc_id, text)."""
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    table = pair_table(durable(texts.mapInArrow(_read(a, b), _READ)))
    return table.select(F.shiftright("pair", 32).cast("int").alias("a_id"), F.col("pair").bitwiseAND(F.lit(0xFFFFFFFF)).cast("int").alias("b_id"), "count", "best")


def alignment_report(docs: DataFrame, a: str, b: str, few: int = FEW) -> DataFrame:
    """(doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256) for each row of docs (doc_id, text), as ``alignments`` takes them.

    n_best: links whose pair occurs as often as any of its id of b; count_sum: how often the links' pairs occur in all. groups_sha256 is of the
    groups' ids, ``a1,a2|b1;a3|b2,b3``; texts without tokens have zeros and ''. Rows that repeat each have a result and count each; an
    empty table gives no rows.
    """
    spark = docs.sparkSession
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    read = durable(texts.mapInArrow(_read(a, b), _READ))
    table = pair_table(read)
    rows = read.where("groups_sha256 is not null")
    schema = "doc_id long, n_a long, n_b long, n_groups long, n_links long, n_best long, count_sum long, groups_sha256 string"
    if (n := table.count()) <= few:
        known = table.toArrow()
        pair = known.column("pair").to_numpy()
        order = np.argsort(pair)
        best = known.column("best").to_numpy()[order].astype(np.int64) if n else np.zeros(0, np.int64)
        return rows.mapInArrow(_looked_up(spark.sparkContext.broadcast((pair[order], known.column("count").to_numpy()[order], best))), schema)
    numbered = durable(rows.withColumn("row", F.monotonically_increasing_id()))
    each = numbered.mapInArrow(_unpacked, "row long, pair long, times long")
    often = each.groupBy("pair").agg(F.count("*").alias("rows"))
    met = many_to_one(each, table, ["pair"], often)
    sums = met.groupBy("row").agg(F.sum("times").alias("n_links"), F.sum(F.col("times") * F.col("best").cast("long")).alias("n_best"), F.sum(F.col("times") * F.col("count")).alias("count_sum"))
    zero = lambda c: F.coalesce(c, F.lit(0)).cast("long").alias(c)
    return numbered.join(sums, "row", "left").select("doc_id", "n_a", "n_b", "n_groups", zero("n_links"), zero("n_best"), zero("count_sum"), "groups_sha256")
