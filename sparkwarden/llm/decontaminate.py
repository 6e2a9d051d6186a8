"""Benchmark decontamination by winnowing.

A window is SPAN consecutive words of a benchmark item; an item of fewer words is one window. For windows of n words, texts and items are
cut into k-grams of words (k = K, or n if that is less), and of each n - k + 1 consecutive grams the least hash is kept, the last of equal ones.
A gram that is least in several windows is kept once, so some 2 in n - k + 2 grams stay; these are the fingerprints. Equal windows
keep the same gram at the same place, so every shared window shares a fingerprint inside it.

1. Items and texts give their fingerprints, texts with the n - k words on both sides. A bitmap of fixed size of the items' fingerprints spares most
   others the join.
2. Fingerprints of texts meet those of items in a join on the hash alone. It only says whether an item has it, so a fingerprint that
   many texts and items share costs a row for each text.
3. A fingerprint that met is extended to both sides: to the n - k + 1 windows at most that hold it. Their words are compared with the items' windows, and
   windows that overlap are merged into hits.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from sparkwarden.llm import textkit as tk
from sparkwarden.llm.session import durable, many_to_one, parts

SPAN, K = 10, 5
FILTER_BITS = 1 << 22
#: Fingerprints of items (16 bytes each) and windows (some 300 bytes each) up to which they are broadcast to their joins.
FEW_PRINTS, FEW = 500_000, 50_000
_U = np.uint64


def _winnow(g: np.ndarray, w: int) -> np.ndarray:
    """For each w consecutive hashes the place of the least, the last of equal ones."""
    n = len(g) - w + 1
    if n <= 0:
        return np.zeros(0, np.int64)
    best, at = g[:n].copy(), np.zeros(n, np.int64)
    for j in range(1, w):
        new = g[j : j + n] <= best
        np.copyto(best, g[j : j + n], where=new)
        at[new] = j
    return at + np.arange(n)


class _Read:
    """The words of some texts, and their fingerprints for windows of a length."""

    def __init__(self, texts: tk.Texts):
        data = tk.LOWER[texts.data]
        self.words = tk.words(texts, tk.ALNUM, data)
        self.raw = data
        self.hashes = tk.word_hashes(data, self.words)
        self.of = np.repeat(np.arange(len(texts)), self.words.count)

    def prints(self, n: int, k: int) -> tuple[np.ndarray, np.ndarray]:
        """(place, hash) of each gram that is kept for some window of n words inside one text, k at most a gram's; places are over all texts."""
        k = min(n, k)
        g = tk.mix(tk.grams(self.hashes, k) + _U(n))
        at = _winnow(g, n - k + 1)
        inside = self.of[: len(at)] == self.of[n - 1 : n - 1 + len(at)]
        at = np.unique(at[inside])
        return at, g[at]

    def text(self, start: int, end: int) -> str:
        return b" ".join(self.raw[a:b].tobytes() for a, b in zip(self.words.start[start:end], self.words.end[start:end], strict=True)).decode("utf-8", "replace")


def _batch(columns: list, kinds: list, names: list[str]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds, strict=True)], names)


def _item_lengths(read: _Read, span: int) -> np.ndarray:
    return np.minimum(read.words.count, span)


def _item_prints(span: int, k: int):
    """(n, print) of items."""

    def run(batches):
        for batch in parts(batches):
            for texts in tk.slices(batch.column("text")):
                read = _Read(texts)
                own = _item_lengths(read, span)
                for n in sorted(set(own[own > 0].tolist())):
                    at, h = read.prints(n, k)
                    h = np.unique(h[own[read.of[at]] == n])
                    yield _batch([[n] * len(h), tk.as_long(h)], [pa.int64()] * 2, ["n", "print"])

    return run


def _item_windows(span: int):
    """(item, words) of each window of items."""

    def run(batches):
        for batch in parts(batches):
            ids, out = batch.column("item_id").to_pylist(), [[], []]
            for texts in tk.slices(batch.column("text")):
                read = _Read(texts)
                for i, n in enumerate(_item_lengths(read, span).tolist()):
                    if n:
                        for s in range(int(read.words.of[i]), int(read.words.of[i + 1]) - n + 1):
                            out[0].append(ids[texts.first + i])
                            out[1].append(read.text(s, s + n))
            yield _batch(out, [pa.int64(), pa.string()], ["item", "words"])

    return run


def _passes(bits: np.ndarray):
    def held(h: np.ndarray) -> np.ndarray:
        slot = (h & _U(FILTER_BITS - 1)).astype(np.int64)
        return (bits[slot >> 3] >> (slot & 7).astype(np.uint8)) & 1 == 1

    return held


def _text_prints(bits: np.ndarray, lengths: tuple[int, ...], k: int):
    """A row with n_words for each text, and one for each fingerprint that passes: the words around it, which begin at place, and how many of them come before it."""

    def run(batches):
        kinds = [pa.string()] + [pa.int64()] * 5 + [pa.string()]
        names = ["row", "n_words", "n", "print", "place", "before", "words"]
        passes = _passes(bits)
        for batch in parts(batches):
            ids = batch.column("row").to_pylist()
            out = [[] for _ in kinds]
            for texts in tk.slices(batch.column("text")):
                read = _Read(texts)
                for i, c in enumerate(read.words.count.tolist()):
                    for col, x in zip(out, (ids[texts.first + i], c, None, None, None, None, None), strict=True):
                        col.append(x)
                for n in lengths:
                    at, h = read.prints(n, k)
                    kept = passes(h)
                    of = read.of[at[kept]]
                    first, last, reach = read.words.of[of], read.words.of[of + 1], n - min(n, k)
                    start, end = np.maximum(first, at[kept] - reach), np.minimum(last, at[kept] + n)
                    for o, p, f, s, e, p_hash in zip(of.tolist(), at[kept].tolist(), first.tolist(), start.tolist(), end.tolist(), tk.as_long(h[kept]).tolist(), strict=True):
                        for col, x in zip(out, (ids[texts.first + o], None, n, p_hash, s - f, p - s, read.text(s, e)), strict=True):
                            col.append(x)
            yield _batch(out, kinds, names)

    return run


def _extended(k: int):
    """The windows (row, s, n, words) that hold a fingerprint."""

    def run(batches):
        for batch in parts(batches, 4096):
            out = [[] for _ in range(4)]
            for row, n, place, before, words in zip(*(batch.column(c).to_pylist() for c in ("row", "n", "place", "before", "words")), strict=True):
                w = words.split(" ")
                for s in range(max(0, before + min(n, k) - n), min(before, len(w) - n) + 1):
                    for col, x in zip(out, (row, place + s, n, " ".join(w[s : s + n])), strict=True):
                        col.append(x)
            yield _batch(out, [pa.string(), pa.int64(), pa.int64(), pa.string()], ["row", "s", "n", "words"])

    return run


def _bitmap(prints: DataFrame) -> np.ndarray:
    slot = f"(print & {FILTER_BITS - 1})"
    filled = prints.selectExpr(f"shiftright({slot}, 3) AS byte", f"shiftleft(1, CAST({slot} & 7 AS INT)) AS bit")
    bits = np.zeros(FILTER_BITS // 8, np.uint8)
    rows = filled.groupBy("byte").agg(F.bit_or("bit").alias("bit")).toArrow()  # at most FILTER_BITS / 8 rows
    bits[rows.column("byte").to_numpy()] = rows.column("bit").to_numpy()
    return bits


def contaminated_words(docs: DataFrame, items: DataFrame, span: int = SPAN, k: int = K, few: int | None = None) -> DataFrame:
    """(row, n_words, n_hit, n_items, item_ids) for each row of docs (row: string id, text); items: (item_id, text).

    Words are runs of ASCII letters and digits and characters beyond ASCII, with A-Z lower-cased; null
    has none. n_hit counts words within any occurrence of a window. item_ids are the items with
    one, null if none, sorted as strings; ids that repeat count once. Items without an id hit as others do: n_items
    counts them as one more, item_ids leave them out. Texts of any length are read whole; rows that repeat a row
    each get its result; without items nothing is hit, and without rows there are none. few: rows of items up to which they are broadcast.
    """
    spark = docs.sparkSession
    named = items.select(F.col("item_id").cast("string").alias("item_id"), F.col("text").cast("string").alias("text")).where("text is not null")
    same_text = named.select(F.xxhash64("text").alias("item"), "item_id").distinct()
    distinct = named.select(F.xxhash64("text").alias("item_id"), "text").dropDuplicates()
    prints = durable(distinct.mapInArrow(_item_prints(span, k), "n long, print long").distinct())
    lengths = tuple(sorted(r[0] for r in prints.select("n").distinct().collect()))  # at most span of them
    bits = spark.sparkContext.broadcast(_bitmap(prints))

    def read_texts(batches):
        yield from _text_prints(bits.value, lengths, k)(batches)

    texts = docs.select("row", F.col("text").cast("string").alias("text"))
    read = durable(texts.mapInArrow(read_texts, "row string, n_words long, n long, print long, place long, before long, words string"))
    mine = read.where("n is not null").select("row", "n", "print", "place", "before", "words").distinct()
    if prints.count() <= (FEW_PRINTS if few is None else few):
        met = mine.join(F.broadcast(prints), ["n", "print"], "left_semi")
    else:
        met = many_to_one(mine, prints.withColumn("known", F.lit(True)), ["n", "print"], mine.groupBy("n", "print").agg(F.count("*").alias("rows"))).where("known")
    windows = durable(met.select("row", "n", "place", "before", "words").mapInArrow(_extended(k), "row string, s long, n long, words string").distinct())
    theirs = durable(distinct.mapInArrow(_item_windows(span), "item long, words string").groupBy("words").agg(F.collect_set("item").alias("items")))
    if theirs.count() <= (FEW if few is None else few):
        hits = windows.join(F.broadcast(theirs), "words")
    else:
        hits = many_to_one(windows, theirs, ["words"], windows.groupBy("words").agg(F.count("*").alias("rows"))).where("items is not null")
    # Windows of all lengths are words joined by blanks: only whole items are shorter than a span.
    spans = durable(hits.select("row", "s", (F.col("s") + F.col("n")).alias("e"), "items"))
    before = Window.partitionBy("row").orderBy("s").rowsBetween(Window.unboundedPreceding, -1)
    merged = spans.groupBy("row", "s").agg(F.max("e").alias("e")).withColumn("reach", F.coalesce(F.max("e").over(before), F.lit(0)))
    hit = merged.groupBy("row").agg(F.sum(F.greatest(F.lit(0), F.col("e") - F.greatest("s", "reach"))).alias("n_hit"))
    found = spans.select("row", F.explode("items").alias("item")).distinct().join(same_text, "item")
    found = found.groupBy("row").agg(F.array_sort(F.collect_set("item_id")).alias("ids"), F.max(F.col("item_id").isNull().cast("long")).alias("unnamed"))
    found = found.select("row", (F.size("ids") + F.col("unnamed")).alias("n_items"), F.when(F.size("ids") > 0, F.col("ids")).alias("item_ids"))
    out = read.where("n is null").select("row", "n_words").join(hit.join(found, "row"), "row", "left")
    return out.select("row", "n_words", F.coalesce("n_hit", F.lit(0)).cast("long").alias("n_hit"), F.coalesce("n_items", F.lit(0)).cast("long").alias("n_items"), "item_ids")


def row_key(doc_id: str = "doc_id", text: str = "text") -> F.Column:
    """One name for the rows of an id and a text; null parts have names too."""
    return F.concat_ws(":", F.coalesce(F.col(doc_id).cast("string"), F.lit("null")), F.xxhash64(F.col(text).cast("string")))


def decontamination_report(docs: DataFrame, items: DataFrame, span: int = SPAN, k: int = K) -> DataFrame:
    """(doc_id, n_words, n_hit, n_items, items_sha256, contaminated) for each row of docs (doc_id, text).

    Rows that repeat an id and a text each get that text's result. The digest is of the item ids, sorted
    as strings and joined by commas; that of the empty string if there are none.
    """
    found = contaminated_words(docs.select(row_key().alias("row"), "text"), items, span, k)
    ids = F.coalesce("item_ids", F.array().cast("array<string>"))
    doc_id = F.when(~F.col("row").startswith("null:"), F.substring_index("row", ":", 1)).cast("long")
    return found.select(
        doc_id.alias("doc_id"), "n_words", "n_hit", "n_items", F.sha2(F.array_join(ids, ","), 256).alias("items_sha256"), (F.col("n_hit") > 0).alias("contaminated")
    )


_AZ = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
ORACLE = rf"""
WITH d AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), '{_AZ}', '{_AZ.lower()}'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
i AS (
  SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), '{_AZ}', '{_AZ.lower()}'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
ip AS (SELECT item_id, w, least(len(w), 10) AS n, unnest(generate_series(1, greatest(1, len(w) - 9))) AS p FROM i WHERE len(w) > 0),
iw AS (SELECT DISTINCT item_id, n, array_to_string(w[p : p + n - 1], ' ') AS s FROM ip),
ns AS (SELECT DISTINCT n FROM iw),
dp AS (SELECT doc_id, w, n, unnest(generate_series(1, len(w) - n + 1)) AS p FROM d, ns),
m AS (SELECT doc_id, p, dp.n, item_id FROM dp JOIN iw ON dp.n = iw.n AND array_to_string(w[p : p + dp.n - 1], ' ') = s),
hit AS (SELECT doc_id, count(DISTINCT q) AS n_hit FROM (SELECT doc_id, unnest(generate_series(p, p + n - 1)) AS q FROM m) GROUP BY doc_id),
its AS (
  SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items
  FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS item FROM m) GROUP BY doc_id)
SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit, CAST(coalesce(n_items, 0) AS BIGINT) AS n_items,
       sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN hit USING (doc_id) LEFT JOIN its USING (doc_id)
"""
