"""Near-duplicate documents by an inverted join over MinHash signature coordinates.

1. Each whole text becomes its set of word shingles (64-bit hashes), a key of that set (128 bits) and
   a signature of COORDINATES minima. Texts of equal sets are one class from here on.
2. Classes are posted under each (coordinate, minimum). Pairs whose similarity reaches the threshold
   agree in at least ``least`` coordinates (but for odds of ODDS), so they meet within the
   COORDINATES - least + 1 rarest postings of each: only this prefix of a class is kept. A phrase
   that many texts share fills long lists, yet falls out of the prefixes of all but truly similar texts.
3. Lists with the same least member are merged into one, so lists of about the same members become one list, and a class is
   in few. Lists of up to BLOCK shingles and ROWS members are dealt to units of work.
4. Longer lists are dealt to blocks, each member to one. A block is a unit, and some members of its largest tree are held against those of
   the list's other blocks. What then hangs together with most of the list is settled; the few others meet every block. Lists where
   many are left are taken apart: they are posted once more under the rarest shingles of each set (the exact prefix of a similarity join, less those
   members that come too late in a list to link with any of its sizes), so a phrase that many texts share joins nothing.
5. A unit counts collisions, skips pairs that hang together already, and confirms the others on the full sets. It returns a
   spanning forest of the confirmed links, so rows grow with members, never with pairs.
6. Components of the forest give the result.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from sparkwarden.llm import textkit as tk
from sparkwarden.llm.graph import components
from sparkwarden.llm.session import FEW, durable, durable_alone, many_to_one, parts

COORDINATES = 24
#: Shingles and rows in a block of a list; two blocks are in memory at a time.
BLOCK, ROWS = 400_000, 1_000
#: Members of a block's largest tree that meet those of the other blocks of its list.
ENVOYS = 8
#: Blocks of a list by rarest shingles that are held against each other without further ado.
FEW_BLOCKS = 4
#: Members of lists that go to one unit, as expected.
UNIT = 500
#: Odds that a pair exactly at the threshold has fewer coordinates in common than are asked for.
ODDS = 2e-9
_SEEDS = tk.mix(np.arange(1, 2 * COORDINATES + 1, dtype=np.uint64))


def least_matches(threshold: float, coordinates: int = COORDINATES) -> int:
    """The most matches m such that a pair at the threshold has fewer with odds under ODDS."""
    odds, total, m = 0.0, 0.0, 0
    while m < coordinates:
        odds = math.comb(coordinates, m) * threshold**m * (1 - threshold) ** (coordinates - m)
        if (total := total + odds) > ODDS:
            break
        m += 1
    return max(1, m)


def _sets(texts: tk.Texts, k: int) -> list[np.ndarray]:
    """Each text's sorted distinct shingles; fewer than k words are one shingle, none is none."""
    data = tk.LOWER[texts.data]
    w = tk.words(texts, tk.SPACED, data)
    h = tk.word_hashes(data, w)
    g = tk.grams(h, k)
    out = []
    for i in range(len(texts)):
        a, b = int(w.of[i]), int(w.of[i + 1])
        if b - a >= k:
            x = np.sort(g[a : b - k + 1])
            out.append(x[np.concatenate(([True], x[1:] != x[:-1]))])
        elif b > a:
            out.append(tk.grams(h[a:b], b - a) ^ np.uint64(b - a))
        else:
            out.append(h[:0])
    return out


def _key(x: np.ndarray) -> bytes:
    """128 bits of a set, whatever the order."""
    return (tk.mix(x).sum(dtype=np.uint64) + np.uint64(len(x))).tobytes() + tk.mix(x ^ np.uint64(0xA5A5A5A55A5A5A5A)).sum(dtype=np.uint64).tobytes()


def _signature(x: np.ndarray) -> np.ndarray:
    y = x ^ (x >> np.uint64(32))
    return np.array([(y * (_SEEDS[2 * j] | np.uint64(1)) + _SEEDS[2 * j + 1]).min() for j in range(COORDINATES)], np.uint64)


def _first_pass(k: int):
    def run(batches):
        for batch in parts(batches):
            sizes, keys, sigs = [], [], []
            for texts in tk.slices(batch.column("text")):
                for x in _sets(texts, k):
                    sizes.append(len(x))
                    keys.append(_key(x) if len(x) else None)
                    sigs.append(tk.as_long(_signature(x)) if len(x) else None)
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), batch.column("version"), pa.array(sizes, pa.int64()), pa.array(keys, pa.binary()), pa.array(sigs, pa.list_(pa.int64()))],
                ["doc_id", "version", "n_shingles", "set_key", "sig"],
            )

    return run


def _second_pass(k: int):
    """The sets again, of those few texts that have a candidate, with the units that they go to; rows that only share the id go."""

    def run(batches):
        for batch in parts(batches):
            found = [x for texts in tk.slices(batch.column("text")) for x in _sets(texts, k)]
            keys = batch.column("set_key").to_pylist()
            here = [i for i, x in enumerate(found) if _key(x) == keys[i]]
            flat = np.concatenate([found[i] for i in here]) if here else np.zeros(0, np.uint64)
            sigs = pa.array([tk.as_long(_signature(found[i])) for i in here], pa.list_(pa.int64()))
            units, long = (batch.column(name).take(pa.array(here, pa.int64())) for name in ("units", "long"))
            yield pa.RecordBatch.from_arrays(
                [pa.array([keys[i] for i in here], pa.binary()), units, long, sigs, tk.lists(tk.as_long(flat), [len(found[i]) for i in here], pa.int64())],
                ["set_key", "units", "long", "sig", "shingles"],
            )

    return run


class Trees:
    """Which rows hang together. Of two trees the smaller one is renamed, so all unions take n log n steps."""

    def __init__(self, label: np.ndarray):
        self.of = np.unique(label, return_inverse=True)[1]
        by = np.argsort(self.of, kind="stable")
        self.rows = dict(enumerate(np.split(by, np.cumsum(np.bincount(self.of))[:-1]))) if len(label) else {}

    def union(self, i: int, j: int) -> None:
        a, b = self.of[i], self.of[j]
        if len(self.rows[a]) < len(self.rows[b]):
            a, b = b, a
        moved = self.rows.pop(b)
        self.of[moved] = a
        self.rows[a] = np.concatenate([self.rows[a], moved])


class _Unit:
    """The sets of a unit end to end, and lists of rows by the rarest shingles of each."""

    def __init__(self, sets: list[np.ndarray], threshold: int):
        self.threshold = threshold
        self.sizes = np.array([len(x) for x in sets], np.int64)
        self.bounds = np.concatenate(([0], np.cumsum(self.sizes)))
        values, self.code = np.unique(np.concatenate(sets), return_inverse=True)
        self.mark = np.zeros(len(values), np.int32)
        self.lists = None

    def _post(self) -> None:
        """Each set's shingles, the rarest of the unit first, but for as many as a partner must share: a pair meets in what is left."""
        n, row = len(self.sizes), np.repeat(np.arange(len(self.sizes)), self.sizes)
        order = np.lexsort((self.code, np.bincount(self.code)[self.code], row))
        place = np.arange(len(row)) - self.bounds[row]
        kept = order[place < (self.sizes + (-self.threshold * self.sizes) // 100 + 1)[row]]
        self.prefix = self.code[kept]
        self.prefix_of = np.concatenate(([0], np.cumsum(np.bincount(row[kept], minlength=n))))
        by = np.argsort(self.prefix, kind="stable")
        self.lists = row[kept][by], np.concatenate(([0], np.cumsum(np.bincount(self.prefix, minlength=len(self.mark)))))

    def near(self, i: int) -> np.ndarray:
        """Rows that share a posting of the prefix with row i."""
        if self.lists is None:
            self._post()
        rows, first = self.lists
        found = [rows[first[c] : first[c + 1]] for c in self.prefix[self.prefix_of[i] : self.prefix_of[i + 1]] if first[c + 1] - first[c] > 1]
        return np.unique(np.concatenate(found)) if found else np.zeros(0, np.int64)

    def linked(self, i: int, others: np.ndarray) -> np.ndarray:
        """Those of others that reach the threshold with row i."""
        mine = self.code[self.bounds[i] : self.bounds[i + 1]]
        self.mark[mine] = 1
        if len(others) * 4 > len(self.sizes):
            common = np.add.reduceat(self.mark[self.code], self.bounds[:-1])[others]
        else:
            common = np.array([self.mark[self.code[self.bounds[j] : self.bounds[j + 1]]].sum() for j in others])
        self.mark[mine] = 0
        return others[100 * common >= self.threshold * (self.sizes[i] + self.sizes[others] - common)]


def _collisions(sigs: np.ndarray) -> np.ndarray:
    """How many coordinates each row shares with others, in all."""
    score = np.zeros(len(sigs), np.int64)
    for k in range(sigs.shape[1]):
        _, inverse, count = np.unique(sigs[:, k], return_inverse=True, return_counts=True)
        score += count[inverse]
    return score


def _join_unit(sets: list[np.ndarray], sigs: np.ndarray, threshold: int, least: int, label: np.ndarray | None = None, asks: np.ndarray | None = None) -> list[tuple[int, int]]:
    """A spanning forest of the links among the sets of one unit. threshold: per cent.

    label: rows that hang together already have one. asks: rows that must be settled (all by default), that is held
    against each other row that they don't hang together with. The most central row meets all others; from
    then on only rows outside the largest tree need settling, as each pair has an end there. They meet the
    rows in the lists of their rarest shingles, those with most collisions first, until they hang together.
    """
    n = len(sets)
    trees, links, settled = Trees(np.arange(n) if label is None else label), [], np.zeros(n, bool)
    asks = np.ones(n, bool) if asks is None else asks
    unit = _Unit(sets, threshold)
    sizes = unit.sizes

    def open_to(i: int, others: np.ndarray) -> np.ndarray:
        others = others[(trees.of[others] != trees.of[i]) & ~settled[others] & (sizes[others] * 100 >= threshold * sizes[i]) & (sizes[i] * 100 >= threshold * sizes[others])]
        collisions = (sigs[others] == sigs[i]).sum(1)
        others, collisions = others[collisions >= least], collisions[collisions >= least]
        return others[np.argsort(-collisions, kind="stable")]

    def join(i: int, others: np.ndarray) -> None:
        for j in unit.linked(i, others):
            if trees.of[i] != trees.of[j]:
                trees.union(i, int(j))
                links.append((i, int(j)))

    if n > 2:
        center = int(_collisions(sigs).argmax())
        if len(others := open_to(center, np.arange(n))):
            join(center, others)
        settled[center] = True
    outside = trees.of != np.bincount(trees.of).argmax()
    for i in np.flatnonzero(outside & asks & ~settled).tolist():
        others, size = open_to(i, unit.near(i)), 4
        while len(others):
            join(i, others[:size])
            others = others[size:]
            others, size = others[trees.of[others] != trees.of[i]], 4 * size
        settled[i] = True
    return links


def _envoys(links: list[tuple[bytes, bytes]], keys: list[bytes], sigs: np.ndarray) -> list[bytes]:
    """Members of the largest tree of a unit, those with most collisions first."""
    at = {k: i for i, k in enumerate(keys)}
    trees = Trees(np.arange(len(keys)))
    for a, b in links:
        if trees.of[at[a]] != trees.of[at[b]]:
            trees.union(at[a], at[b])
    most = max(trees.rows.values(), key=len)
    return [keys[i] for i in most[np.argsort(-_collisions(sigs[most]), kind="stable")[:ENVOYS]]]


def _join_lists(threshold: int, least: int, envoys: bool = False):
    """(unit, a, b) for each link of a unit's forest; if envoys are asked for, with a = b for each. Rows come sorted by unit; a unit may go over batches."""

    def unit(tables):
        t = pa.Table.from_batches(tables).combine_chunks()
        keys = t.column("set_key").to_pylist()
        col = t.column("shingles").combine_chunks()
        flat, off = col.values.to_numpy(zero_copy_only=False).view(np.uint64), col.offsets.to_numpy()
        # A row that asks may come as one of all rows as well.
        first, asks = {}, {}
        for i, (key, ask) in enumerate(zip(keys, t.column("asks").to_pylist(), strict=True)):
            first.setdefault(key, i)
            asks[key] = asks.get(key, False) or ask
        at = np.array(list(first.values()))
        names = t.column("label").combine_chunks().take(pa.array(at)).dictionary_encode().indices.to_numpy(zero_copy_only=False)
        sigs = np.array(t.column("sig").combine_chunks().flatten().to_numpy(zero_copy_only=False)).reshape(len(keys), -1)[at]
        found = []
        if any(asks.values()) and (names != names[0]).any():
            found = [(keys[at[i]], keys[at[j]]) for i, j in _join_unit([flat[off[i] : off[i + 1]] for i in at], sigs, threshold, least, names, np.array([asks[k] for k in first]))]
        return found + ([(k, k) for k in _envoys(found, list(first), sigs)] if envoys else [])

    def run(batches):
        held, at = [], None

        def done():
            found = unit(held) if envoys or sum(x.num_rows for x in held) > 1 else []
            return pa.RecordBatch.from_arrays([pa.array([at] * len(found), pa.int64()), *(pa.array([x[k] for x in found], pa.binary()) for k in (0, 1))], ["unit", "a", "b"])

        for batch in batches:
            if not batch.num_rows:
                continue
            u = batch.column("unit").to_numpy(zero_copy_only=False)
            cuts = [0, *(np.flatnonzero(u[1:] != u[:-1]) + 1), len(u)]
            for s, e in zip(cuts[:-1], cuts[1:], strict=True):
                if held and u[s] != at:
                    yield done()
                    held = []
                at = u[s]
                held.append(batch.slice(s, e - s))
        if held:
            yield done()

    return run


def _blocks(total, members, block: int) -> F.Column:
    return F.greatest(F.lit(1), F.ceil(total / block), F.ceil(members / ROWS)).cast("int")


def _with_sets(units: DataFrame, sets: DataFrame) -> DataFrame:
    """units (unit, set_key, label, asks) with sig and shingles."""
    return units.join(sets, "set_key").select("unit", "set_key", "label", "asks", "sig", "shingles")


def _forests(rows: DataFrame, per_cent: int, least: int, envoys: bool = False) -> DataFrame:
    """Links (unit, a, b) inside the units (unit, set_key, label, asks, sig, shingles)."""
    dealt = rows.repartition("unit").sortWithinPartitions("unit", "set_key", F.desc("asks"))
    return dealt.mapInArrow(_join_lists(per_cent, least, envoys), "unit long, a binary, b binary")


def _place(blocks, seed: int) -> F.Column:
    return F.pmod(F.xxhash64("set_key", F.lit(seed)), blocks).cast("int")


def _of_list(rows: DataFrame, table: DataFrame, counts: DataFrame, few: bool | None = None) -> DataFrame:
    """rows of lists that table (posting, ...) has, with what it says; counts (posting, rows): how many rows a list has. Long lists are the hot ones. few: whether there are FEW lists, if that is known."""
    if table.count() <= FEW if few is None else few:
        return rows.join(F.broadcast(table), "posting")
    return many_to_one(rows, table.withColumn("_of", F.lit(True)), ["posting"], counts).where("_of").drop("_of")


def _rarest(rows: DataFrame, sets: DataFrame, per_cent: int) -> DataFrame:
    """Members (posting, set_key, n, label, asks) of lists by shingle for rows (set_key, n, label, asks), such that each pair that can link, may and has to be asked for meets.

    Shingles have one order, the rarest first, and a set is in the lists of as many as leave it too few for a link. A pair needs a share of both
    sizes in common and has at most what follows their first common shingle, so a set stays in a list only if the least size there leaves it enough.
    """
    held = rows.join(sets, "set_key").select("set_key", "n", "label", "asks", F.explode("shingles").alias("posting"))
    often = durable_alone(held.groupBy("posting").agg(F.count("*").alias("rows"), F.max("asks").alias("asked"), F.min("label").alias("low"), F.max("label").alias("high")))
    own = Window.partitionBy("set_key")
    # Shingles that only one set has come first in the order and meet nothing: their number is all that counts.
    ranked = many_to_one(held, often, ["posting"], often.select("posting", "rows")).withColumn("before", F.row_number().over(own.orderBy("rows", "posting")) - 1)
    most = F.col("n") - F.ceil(F.col("n") * per_cent / 100) + 1
    posted = ranked.where((F.col("before") < most) & F.expr("rows > 1 AND asked AND low != high")).select("posting", "set_key", "n", "label", "asks", "before")
    posted = durable_alone(posted)
    sizes = posted.groupBy("posting").agg(F.min("n").alias("least_n"), F.count("*").alias("rows"))
    able = (F.col("n") - F.col("before")) * (100 + per_cent) - F.col("n") * per_cent >= F.col("least_n") * per_cent
    left = _of_list(posted, sizes.select("posting", "least_n"), sizes).where(able).select("posting", "set_key", "n", "label", "asks")
    low = F.xxhash64("set_key", F.lit(1)).bitwiseAND(F.lit((1 << 40) - 1))
    lists = left.groupBy("posting").agg(
        F.count("*").alias("rows"), F.max("asks").alias("asked"), F.min("label").alias("low"), F.max("label").alias("high"), F.bit_xor(F.xxhash64("set_key")).alias("x1"), F.sum(low).alias("x2")
    ).where("rows > 1 AND asked AND low != high")
    once = lists.groupBy("rows", "x1", "x2").agg(F.min("posting").alias("posting"))  # lists of the same members
    return _of_list(left, once.select("posting"), once.select("posting", "rows"))


def _long_lists(members: DataFrame, sets: DataFrame, per_cent: int, least: int, block: int, known: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """Links (a, b) of long lists, and units (unit, set_key, label, asks) for what these leave open.

    members: (posting, set_key, n, blocks). sets: theirs. known: links found before, of lists that have been taken apart already. A member is written
    once for its block and once for the units, and those that are left as often as their list has blocks, as long as they fill no block themselves.
    """
    lists = members.groupBy("posting").agg(F.count("*").alias("rows"), F.sum("n").alias("total"), F.max("blocks").alias("blocks"))
    few = lists.count() <= FEW
    placed = members.select(F.xxhash64("posting", _place(F.col("blocks"), 7)).alias("unit"), "posting", "set_key")
    alone = [F.col("set_key").alias("label"), F.lit(True).alias("asks")]
    inside = durable_alone(_forests(_with_sets(placed.select("unit", "set_key", *alone), sets), per_cent, least, envoys=True))
    sent = inside.where("a = b").select("unit", F.col("a").alias("set_key")).join(placed.select("unit", "posting").distinct(), "unit")
    halls = F.greatest(F.lit(1), F.ceil(F.col("blocks") * ENVOYS / ROWS)).cast("int")
    met = _of_list(sent, lists.select("posting", "blocks"), lists, few).where("blocks > 1").select(F.xxhash64("posting", _place(halls, 13)).alias("unit"), "set_key").distinct()
    between = _forests(_with_sets(met.select("unit", "set_key", *alone), sets), per_cent, least)
    links = inside.where("a != b").select("a", "b").unionByName(between.select("a", "b"))
    links = durable_alone(links if known is None else links.unionByName(known))

    label = components(links).select(F.col("node").alias("set_key"), F.col("comp").alias("label"))
    named = members.select("posting", "set_key", "n").join(label, "set_key", "left").withColumn("label", F.coalesce("label", "set_key"))
    top = named.groupBy("posting", "label").count().groupBy("posting").agg(F.max_by("label", F.struct("count", "label")).alias("top"), F.count("*").alias("labels"))
    opened = durable_alone(_of_list(named, top.where("labels > 1").select("posting", "top"), lists, few).withColumn("asks", F.col("label") != F.col("top")).drop("top"))
    asked = opened.where("asks").groupBy("posting").agg(F.count("*").alias("ask_rows"), F.sum("n").alias("ask_total"))
    ways = asked.join(lists, "posting").select("posting", "rows", _blocks(F.col("total"), F.col("rows"), block).alias("blocks"), _blocks(F.col("ask_total"), F.col("ask_rows"), block).alias("ask_blocks"))
    # Lists that have been taken apart have no other way left than all their blocks against each other.
    direct = F.col("ask_blocks") == 1 if known is None else F.lit(True)
    dealt = _of_list(opened, ways.where(direct).select("posting", "blocks", "ask_blocks"), lists, few)
    whole = dealt.withColumn("block", _place(F.col("blocks"), 7)).withColumn("ask_block", F.explode(F.sequence(F.lit(0), F.col("ask_blocks") - 1))).withColumn("asks", F.lit(False))
    those = dealt.where("asks").withColumn("ask_block", _place(F.col("ask_blocks"), 9)).withColumn("block", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    columns = [F.xxhash64("posting", "block", "ask_block").alias("unit"), "set_key", "label", "asks"]
    units = whole.select(*columns).unionByName(those.select(*columns))
    if known is not None or (many := ways.where(~direct)).isEmpty():
        return links, units

    apart = _of_list(opened, many.select("posting"), lists, few).groupBy("set_key").agg(F.first("n").alias("n"), F.first("label").alias("label"), F.max("asks").alias("asks"))
    again = durable_alone(_rarest(apart, sets, per_cent))
    sizes = again.groupBy("posting").agg(F.count("*").alias("rows"), _blocks(F.sum("n"), F.count("*"), block).alias("blocks"))
    again = _of_list(again, sizes.drop("rows"), sizes)
    # A list of few blocks goes to a unit for each two of them: some FEW_BLOCKS units a row at most.
    pair = F.explode(F.expr("transform(sequence(0, blocks - 1), other -> struct(least(own, other) AS i, greatest(own, other) AS j))"))
    paired = again.where(F.col("blocks") <= FEW_BLOCKS).withColumn("own", _place(F.col("blocks"), 7)).withColumn("pair", pair)
    units = units.unionByName(paired.select(F.xxhash64("posting", "pair").alias("unit"), "set_key", "label", "asks").distinct())
    if (long := again.where(F.col("blocks") > FEW_BLOCKS)).isEmpty():
        return links, units
    links, more = _long_lists(long.select("posting", "set_key", "n", "blocks"), sets, per_cent, least, block, links)
    return links, units.unionByName(more)


def near_duplicates(docs: DataFrame, k: int = 5, threshold: float = 0.8, block: int = BLOCK) -> DataFrame:
    """(doc_id, n_shingles, component_id, kept) for each row of docs (doc_id, text; more columns are ignored).

    Words are runs of ``[^\\x20\\x09-\\x0D]`` with A-Z lower-cased. Null and empty texts have no shingles and
    link with nothing; a text of fewer than k words is one shingle. Rows of equal sets are linked, however
    often they repeat. component_id is the least doc_id reachable; null ids are passed over unless
    all are null, and a row is kept if its doc_id is its component's (rows that repeat one id are all kept).
    """
    return marked_rows(docs, k, threshold, block).select("doc_id", "n_shingles", "component_id", "kept")


def marked_rows(docs: DataFrame, k: int = 5, threshold: float = 0.8, block: int = BLOCK) -> DataFrame:
    """near_duplicates with version, the hash of the row's text, and tree: one name for all sets that are linked, null
    without shingles. Components of one component_id are apart by it, where their rows repeat an id or have none."""
    per_cent = round(threshold * 100)
    least = least_matches(threshold)
    prefix = COORDINATES - least + 1
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    versioned = texts.withColumn("version", F.xxhash64("text"))
    rows = durable(versioned.mapInArrow(_first_pass(k), "doc_id long, version long, n_shingles long, set_key binary, sig array<long>"))
    classes = durable_alone(
        rows.where("set_key is not null").groupBy("set_key").agg(F.min("doc_id").alias("least_id"), F.max("n_shingles").alias("n"), F.count("*").alias("rows"), F.first("sig").alias("sig"))
    )

    posted = classes.select("set_key", F.posexplode("sig")).select("set_key", "pos", F.xxhash64("pos", "col").alias("posting"))
    shared = durable_alone(posted.groupBy("posting").count().where("count > 1"))
    meet = many_to_one(posted, shared, ["posting"], shared.select("posting", F.col("count").alias("rows"))).where("count is not null")
    own = Window.partitionBy("set_key")
    ranked = meet.withColumn("rank", F.row_number().over(own.orderBy("count", "pos"))).withColumn("met", F.count("*").over(own))
    kept = durable_alone(ranked.where(F.col("met") >= least).where(F.col("rank") <= prefix - (COORDINATES - F.col("met"))).select("posting", "set_key"))
    heads = kept.groupBy("posting").agg(F.min("set_key").alias("head"), F.count("*").alias("rows")).where("rows > 1")
    met = many_to_one(kept, heads.drop("rows"), ["posting"], heads.select("posting", "rows")).where("head is not null")
    pairs = durable_alone(met.select("head", "set_key").distinct().join(classes.select("set_key", "n", "least_id"), "set_key"))
    lists = pairs.groupBy("head").agg(F.count("*").alias("rows"), _blocks(F.sum("n"), F.count("*"), block).alias("blocks"))
    lists = durable(lists)
    member = many_to_one(pairs, lists.drop("rows"), ["head"], lists.select("head", "rows")).select(F.col("head").alias("posting"), "set_key", "least_id", "n", "blocks")
    member = durable(member)

    # A set takes its units along, so only those of long lists are looked up again.
    unit = F.pmod(F.xxhash64("posting"), F.lit(max(1, member.count() // UNIT)))
    named = durable(member.groupBy("set_key", "least_id").agg(F.collect_set(F.when(F.col("blocks") == 1, unit)).alias("units"), F.max(F.col("blocks") > 1).alias("long")))
    if named.count() <= FEW:
        named = F.broadcast(named)
    again = texts.join(named, texts["doc_id"].eqNullSafe(named["least_id"])).select("set_key", "text", "units", "long")
    sets = again.mapInArrow(_second_pass(k), "set_key binary, units array<long>, long boolean, sig array<long>, shingles array<long>")
    if not rows.groupBy("doc_id").count().where("count > 1").isEmpty():
        sets = sets.dropDuplicates(["set_key"])  # rows of one id and one set
    sets = durable_alone(sets)

    rows_of = sets.select(F.explode("units").alias("unit"), "set_key", F.col("set_key").alias("label"), F.lit(True).alias("asks"), "sig", "shingles")
    links = None
    if not (long := member.where("blocks > 1")).isEmpty():
        of_long = sets.where("long").select("set_key", "sig", "shingles")
        links, more = _long_lists(long.select("posting", "set_key", "n", "blocks"), of_long, per_cent, least, block)
        rows_of = rows_of.unionByName(_with_sets(more, of_long))
    found = _forests(rows_of, per_cent, least).select("a", "b")
    links = durable_alone(found if links is None else found.unionByName(links))

    comp = components(links)
    tied = comp.join(classes.select(F.col("set_key").alias("node"), "least_id"), "node")
    heads = tied.groupBy("comp").agg(F.min("least_id").alias("component_id"))
    named = comp.join(heads, "comp").select(F.col("node").alias("set_key"), "comp", "component_id")
    of_class = classes.join(named, "set_key", "left").select("set_key", F.coalesce("comp", "set_key").alias("tree"), F.coalesce("component_id", "least_id").alias("component_id"))
    some = rows.select("doc_id", "version", "n_shingles", "set_key")
    found = many_to_one(some.where("set_key is not null"), of_class, ["set_key"], classes)
    nothing = some.where("set_key is null").withColumns({"tree": F.lit(None).cast("binary"), "component_id": F.lit(None).cast("long")})
    out = found.unionByName(nothing)
    component = F.coalesce("component_id", "doc_id")
    return out.select("doc_id", "version", "n_shingles", component.alias("component_id"), F.coalesce(F.col("doc_id") == component, F.lit(True)).alias("kept"), "tree")


_AZ = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
ORACLE = rf"""
WITH RECURSIVE d AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), '{_AZ}', '{_AZ.lower()}'), '[^\x20\x09-\x0D]+') AS w FROM documents),
s AS (
  SELECT doc_id, CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 3 THEN [array_to_string(w, ' ')]
    ELSE list_distinct(list_transform(range(1, len(w) - 1), lambda i: array_to_string(w[i : i + 2], ' '))) END AS g FROM d),
x AS (SELECT doc_id, unnest(g) AS g, len(g) AS n FROM s),
p AS (SELECT a.doc_id AS u, b.doc_id AS v, count(*) AS c, any_value(a.n + b.n) AS n FROM x a JOIN x b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY 1, 2),
l AS (SELECT u, v FROM p WHERE 100 * c >= 85 * (n - c)),
e AS (SELECT u, v FROM l UNION ALL SELECT v, u FROM l),
r(u, v) AS (SELECT u, v FROM e UNION SELECT r.u, e.v FROM r JOIN e ON r.v = e.u),
m AS (SELECT u, min(v) AS v FROM r GROUP BY u)
SELECT doc_id, CAST(len(g) AS BIGINT) AS n_shingles, least(doc_id, coalesce(v, doc_id)) AS component_id, doc_id <= coalesce(v, doc_id) AS kept
FROM s LEFT JOIN m ON doc_id = u
"""
