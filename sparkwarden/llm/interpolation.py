"""Language-model scores of whole texts by deleted interpolation.

The model mixes maximum-likelihood estimates of all orders, from n-grams down to words and one for unseen words:

    P_o(w | h) = l * count(h w) / count(h) + (1 - l) * P_(o-1)(w | shorter h),    P_0 = 1 / (V + 1)

where l hangs on the order and on the bucket of count(h): 0, 1, 2-3, 4-7, ... The weights are learned by expectation-maximisation on
texts that are kept back (deleted): the counts of the other training texts say what the estimates are, the kept-back ones which mixture
they need. The final counts are of all training texts.

1. Texts are gathered to blocks of BLOCK_TOKENS. A block's words are numbered, the frequent ones first, and written as packed numbers. Kept-back
   texts have blocks of their own.
2. Each block asks for the counts of its distinct n-grams, one order after the other: a row for each slot, a range of hashes. However often an n-gram occurs, it is one
   entry of a block, so no key is hot. A slot adds up what all blocks have, and answers each in the order asked, without the hashes.
3. Blocks meet their answers. Kept-back blocks give the distinct tuples of counts that expectation-maximisation runs over, one job a round; then
   all blocks give their texts' scores.

Nothing of the corpus goes to the driver but sums: N, V, and those of each round by order and bucket.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sparkwarden.llm import textkit as tk
from sparkwarden.llm.packed import pack, pack_rising, small, unpack, unpack_rising
from sparkwarden.llm.session import durable, durable_alone, parts

#: Tokens of a block (a longer text is one by itself), and tokens for each slot, of which at least LEAST_SLOTS are used.
BLOCK_TOKENS, SLOT_TOKENS, LEAST_SLOTS = 1 << 20, 1 << 20, 64
#: Buckets of context counts: 0, 1, 2-3, ... the last has all from 2**(BUCKETS-2) on.
BUCKETS = 24
#: Rounds end when the mean log-likelihood of a kept-back token gains less than GAIN, or after ROUNDS.
ROUNDS, GAIN = 30, 1e-5
#: Weights keep so far from 0 and 1. START is a bucket's weight without kept-back texts.
EDGE, UNKNOWN_WEIGHT = 1e-4, 0.5
#: A text's part: it is learned from, kept back, or only scored.
LEARNED, KEPT_BACK, OTHER = 0, 1, 2
_U = np.uint64
_END, _BEGIN = _U(0x7E57E4D), _U(0xBE61)


def bucket(count: np.ndarray) -> np.ndarray:
    """0 for 0, else one more than the binary logarithm."""
    return np.minimum(np.where(count > 0, np.frexp(np.maximum(count, 1).astype(np.float64))[1], 0), BUCKETS - 1)


class _Grams:
    """Hashes of the n-grams that end at each token of some texts, by order. bounds: tokens before each text, and in all."""

    def __init__(self, tokens: np.ndarray, bounds: np.ndarray, order: int):
        n = len(tokens)
        self.place = np.arange(n) - np.repeat(bounds[:-1], np.diff(bounds))
        self.docs = len(bounds) - 1
        self.of = [tk.mix(tokens + _U(1))]
        self.begin = [tk.mix(np.array([_BEGIN]))]  # the context before a text's first token, for each length
        for o in range(2, order + 1):
            before = np.full(n, _BEGIN, _U)
            far = self.place >= o - 1
            before[far] = tokens[np.flatnonzero(far) - (o - 1)]
            self.of.append(tk.mix(self.of[-1] * _U(0xD1342543DE82EF95) + tk.mix(before + _U(o))))
            self.begin.append(tk.mix(self.begin[-1] * _U(0xD1342543DE82EF95) + _U(o)))

    def asked(self, order: int) -> np.ndarray:
        """The hashes of one order, and after them that of an empty context for each text, where it is context of the order above."""
        return self.of[order - 1] if order == len(self.of) else np.concatenate((self.of[order - 1], np.repeat(self.begin[order - 1], self.docs)))

    def context(self, order: int, counts: np.ndarray) -> np.ndarray:
        """The count of the context of each token's n-gram of an order above 1, from ``asked(order - 1)``'s counts."""
        n = len(self.place)
        before = counts[np.maximum(np.arange(n) - 1, 0)]
        return np.where(self.place == 0, counts[n] if len(counts) > n else 0, before)


_BLOCK = "block long, kept_back boolean, tokens long, ids array<long>, part binary, bounds binary, words binary, text binary"


def _blocks(size: int):
    """Blocks of texts: words are hashes by falling frequency, text numbers into them."""

    class Open:
        def __init__(self):
            self.ids, self.part, self.count, self.tokens, self.n = [], [], [], [], 0

        def row(self, block: int) -> list:
            flat = np.concatenate(self.tokens)
            words, text, often = np.unique(flat, return_inverse=True, return_counts=True)
            order = np.argsort(-often, kind="stable")
            rank = np.empty(len(order), np.int64)
            rank[order] = np.arange(len(order))
            return [block, bool(self.part[0] == KEPT_BACK), self.n, self.ids, pack(np.array(self.part, np.uint8)), pack(small(np.array(self.count, np.int64))), pack(words[order]), pack(small(rank[text]))]

    def run(batches):
        at, k = TaskContext.get().partitionId(), 0
        opened = {True: Open(), False: Open()}
        kinds = [pa.int64(), pa.bool_(), pa.int64(), pa.list_(pa.int64()), *[pa.binary()] * 4]
        names = [c.split()[0] for c in _BLOCK.split(", ")]

        def closed(which: bool):
            nonlocal k
            row = opened[which].row((at << 32) | k)
            k, opened[which] = k + 1, Open()
            return pa.RecordBatch.from_arrays([pa.array([v], t) for v, t in zip(row, kinds, strict=True)], names)

        for batch in parts(batches):
            ids, part = batch.column("doc_id").to_pylist(), batch.column("part").to_pylist()
            for texts in tk.slices(batch.column("text")):
                data = tk.LOWER[texts.data]
                w = tk.words(texts, tk.SPACED, data)
                h = tk.word_hashes(data, w)
                for i in range(len(texts)):
                    x, which = opened[part[texts.first + i] == KEPT_BACK], part[texts.first + i] == KEPT_BACK
                    tokens = np.append(h[w.of[i] : w.of[i + 1]], _END)
                    x.ids.append(ids[texts.first + i])
                    x.part.append(part[texts.first + i])
                    x.count.append(len(tokens))
                    x.tokens.append(tokens)
                    x.n += len(tokens)
                    if x.n >= size:
                        yield closed(which)
        for which in (True, False):
            if opened[which].n:
                yield closed(which)

    return run


def _grams(row: dict, order: int) -> tuple[_Grams, np.ndarray, np.ndarray]:
    """The n-grams of a block, its texts' parts and the tokens before each."""
    bounds = np.concatenate(([0], np.cumsum(unpack(row["bounds"], np.uint64).astype(np.int64))))
    tokens = unpack(row["words"], np.uint64)[unpack(row["text"], np.uint64).astype(np.int64)]
    return _Grams(tokens, bounds, order), unpack(row["part"], np.uint64), bounds


def _rows(batches, *names: str):
    for batch in batches:
        for values in zip(*(batch.column(c).to_pylist() for c in names), strict=True):
            yield dict(zip(names, values, strict=True))


def _requests(order: int, bits: int, o: int):
    """What each block asks for of order o: its distinct hashes by slot with its own counts in learned and in kept-back texts."""

    def run(batches):
        for row in _rows(batches, "block", "part", "bounds", "words", "text"):
            grams, part, bounds = _grams(row, order)
            of_token = np.repeat(part, np.diff(bounds))
            asked = grams.asked(o)
            mine = of_token if len(asked) == len(of_token) else np.concatenate((of_token, part))
            h, at = np.unique(asked, return_inverse=True)
            counts = [small(np.bincount(at, mine == p, len(h)).astype(np.int64)) for p in (LEARNED, KEPT_BACK)]
            cuts = np.searchsorted(h, np.arange(1 << bits, dtype=np.uint64) << _U(64 - bits)).tolist() + [len(h)]
            full = [s for s in range(1 << bits) if cuts[s + 1] > cuts[s]]
            cols = [[f(x[cuts[s] : cuts[s + 1]]) for s in full] for f, x in ((pack_rising, h), (pack, counts[0]), (pack, counts[1]))]
            yield pa.RecordBatch.from_arrays(
                [pa.array([row["block"]] * len(full), pa.int64()), pa.array([(o << bits) | s for s in full], pa.int32()), *(pa.array(c, pa.binary()) for c in cols)], ["block", "slot", "hashes", "learned", "kept"]
            )

    return run


_ANSWER = "block long, slot int, learned binary, kept binary, types long, learned_tokens long, tokens long"


def _answers(bits: int):
    """Counts over all blocks, in the order in which each asked. A slot's first row also tells its types and tokens, if it is of words."""
    begin = tk.mix(np.array([_BEGIN]))[0]

    def answered(slot: int, rows: list[dict]) -> pa.RecordBatch:
        asked = [unpack_rising(r["hashes"]) for r in rows]
        h, at = np.unique(np.concatenate(asked), return_inverse=True)
        sums = [np.bincount(at, np.concatenate([unpack(r[c], np.uint64) for r in rows]), len(h)).astype(np.int64) for c in ("learned", "kept")]
        told = [None] * 3
        if slot >> bits == 1:
            word = h != begin
            told = [int(((sums[0] + sums[1] > 0) & word).sum()), int(sums[0][word].sum()), int((sums[0] + sums[1])[word].sum())]
        cuts = np.cumsum([len(x) for x in asked])[:-1]
        cols = [[pack(small(x)) for x in np.split(s[at], cuts)] for s in sums]
        rest = len(rows) - 1
        return pa.RecordBatch.from_arrays(
            [pa.array([r["block"] for r in rows], pa.int64()), pa.array([slot] * len(rows), pa.int32()), *(pa.array(c, pa.binary()) for c in cols), *(pa.array([t] + [None] * rest, pa.int64()) for t in told)],
            [c.split()[0] for c in _ANSWER.split(", ")],
        )

    def run(batches):
        held = []
        for row in _rows(batches, "block", "slot", "hashes", "learned", "kept"):
            if held and row["slot"] != held[0]["slot"]:
                yield answered(held[0]["slot"], held)
                held = []
            held.append(row)
        if held:
            yield answered(held[0]["slot"], held)

    return run


def _met(order: int, bits: int, then):
    """Calls then(row of the block, n-grams, bounds, counts) for each block: counts has two arrays for each order, of learned and kept-back texts, in ``asked`` order.

    Rows come sorted: a block's own row, then its answers by slot.
    """

    def opened(row: dict, answers: list[dict]):
        grams, _, bounds = _grams(row, order)
        counts = []
        for o in range(1, order + 1):
            mine = [a for a in answers if a["slot"] >> bits == o]
            at = np.unique(grams.asked(o), return_inverse=True)[1]
            counts.append([np.concatenate([unpack(a[c], np.uint64).astype(np.int64) for a in mine])[at] for c in ("learned", "kept")])
        return then(row, grams, bounds, counts)

    def run(batches):
        row, answers = None, []
        for x in _rows(batches, "block", "slot", "ids", "part", "bounds", "words", "text", "learned", "kept"):
            if x["slot"] < 0:
                if row is not None:
                    yield opened(row, answers)
                row, answers = x, []
            else:
                answers.append(x)
        if row is not None:
            yield opened(row, answers)

    return run


def _mix(weights: np.ndarray, counts: list, contexts: list, types: int) -> list[np.ndarray]:
    """P_0, P_1, ... for tokens by their n-grams' counts and those of their contexts, the lowest order first."""
    p = [np.full(len(counts[0]), 1.0 / (types + 1))]
    for o, (c, h) in enumerate(zip(counts, contexts, strict=True)):
        w = np.where(h > 0, weights[o][bucket(h)], 0.0)
        p.append(w * c / np.maximum(h, 1) + (1 - w) * p[-1])
    return p


@dataclass
class Model:
    """tokens, types: N and V of all training texts. weights: a row for each order, a column for each bucket. steps: mean log-likelihood of a kept-back token before each round."""

    order: int
    tokens: int
    types: int
    weights: np.ndarray
    steps: list[float]
    blocks: DataFrame
    answers: DataFrame
    bits: int

    def _dealt(self, blocks: DataFrame, answers: DataFrame) -> DataFrame:
        nothing = lambda *names: [F.lit(None).cast(k).alias(n) for n, k in names]
        own = blocks.select("block", F.lit(-1).alias("slot"), "ids", "part", "bounds", "words", "text", *nothing(("learned", "binary"), ("kept", "binary")))
        told = answers.select("block", "slot", *nothing(("ids", "array<long>"), *((c, "binary") for c in ("part", "bounds", "words", "text"))), "learned", "kept")
        return own.unionByName(told).repartition("block").sortWithinPartitions("block", "slot")

    def scores(self) -> DataFrame:
        """(doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score) for each row that was given."""
        order, tokens, types, weights = self.order, self.tokens, self.types, self.weights

        def scored(row, grams, bounds, counts):
            n = int(bounds[-1])
            both = [a + b for a, b in counts]
            mine = [c[:n] for c in both]
            contexts = [np.full(n, tokens)] + [grams.context(o, both[o - 2]) for o in range(2, order + 1)]
            p = _mix(weights, mine, contexts, types)[-1]
            total = lambda x: np.add.reduceat(x, bounds[:-1])
            base = total(np.log10((mine[0] + 1) / (tokens + types + 1)))
            part = unpack(row["part"], np.uint64)
            cols = [pa.array(row["ids"], pa.int64()), pa.array(part == OTHER), pa.array(np.diff(bounds)), pa.array(total((mine[0] > 0).astype(np.int64)))]
            cols += [pa.array([tokens] * len(part), pa.int64()), pa.array(base), pa.array(total(np.log10(p)))]
            return pa.RecordBatch.from_arrays(cols, ["doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"])

        schema = "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double"
        return self._dealt(self.blocks, self.answers).mapInArrow(_met(order, self.bits, scored), schema)


def _tuples(order: int, tokens: int):
    """The distinct tuples of learned counts and context counts of a kept-back block's tokens, and how often each occurs."""

    def found(row, grams, bounds, counts):
        n = int(bounds[-1])
        learned = [c[0] for c in counts]
        cols = [c[:n] for c in learned] + [np.full(n, tokens)] + [grams.context(o, learned[o - 2]) for o in range(2, order + 1)]
        each, times = np.unique(np.stack(cols, 1), axis=0, return_counts=True)
        return pa.RecordBatch.from_arrays([pa.array([pack(small(each.ravel()))], pa.binary()), pa.array([pack(small(times))], pa.binary())], ["counts", "times"])

    return found


def _expected(order: int, types: int, weights: np.ndarray):
    """One round's sums by order and bucket: how often a token got there, and how often it was drawn there."""

    def run(batches):
        sums, total = np.zeros((order, BUCKETS, 2)), np.zeros(2)
        for row in _rows(batches, "counts", "times"):
            each = unpack(row["counts"], np.uint64).astype(np.int64).reshape(-1, 2 * order)
            reach = unpack(row["times"], np.uint64).astype(np.float64)
            counts, contexts = each[:, :order].T, each[:, order:].T
            p = _mix(weights, list(counts), list(contexts), types)
            total += [float((reach * np.log(p[-1])).sum()), reach.sum()]
            for o in range(order - 1, -1, -1):
                b = bucket(contexts[o])
                w = np.where(contexts[o] > 0, weights[o][b], 0.0)
                drawn = reach * w * counts[o] / np.maximum(contexts[o], 1) / p[o + 1]
                sums[o, :, 0] += np.bincount(b, reach, BUCKETS)
                sums[o, :, 1] += np.bincount(b, drawn, BUCKETS)
                reach = reach - drawn
        o, b = np.divmod(np.arange(order * BUCKETS), BUCKETS)
        flat = sums.reshape(-1, 2)
        yield pa.RecordBatch.from_arrays(
            [pa.array(np.append(o, -1), pa.int32()), pa.array(np.append(b, 0), pa.int32()), pa.array(np.append(flat[:, 0], total[1])), pa.array(np.append(flat[:, 1], total[0]))], ["o", "b", "reached", "drawn"]
        )

    return run


def _learn(tuples: DataFrame, order: int, types: int) -> tuple[np.ndarray, list[float]]:
    weights, steps = np.full((order, BUCKETS), UNKNOWN_WEIGHT), []
    for _ in range(ROUNDS):
        rows = tuples.mapInArrow(_expected(order, types, weights), "o int, b int, reached double, drawn double").groupBy("o", "b").agg(F.sum("reached").alias("reached"), F.sum("drawn").alias("drawn")).collect()
        sums = {(r.o, r.b): (r.reached, r.drawn) for r in rows}  # a row for each order and bucket
        n, likely = sums.get((-1, 0), (0.0, 0.0))
        if not n:
            break
        steps.append(likely / n)
        for o in range(order):
            known = None
            for b in range(1, BUCKETS):
                reached, drawn = sums.get((o, b), (0.0, 0.0))
                if reached > 0:
                    known = min(1 - EDGE, max(EDGE, drawn / reached))
                weights[o, b] = UNKNOWN_WEIGHT if known is None else known  # buckets without kept-back tokens follow the one below
        if len(steps) > 1 and steps[-1] - steps[-2] < GAIN:
            break
    return weights, steps


def deleted_interpolation(docs: DataFrame, learn: Column, keep_back: Column, order: int = 3, block_tokens: int = BLOCK_TOKENS) -> Model:
    """The model of docs (doc_id, text) and all that is needed to score them.

    learn: whether a row is training text; keep_back: whether it is kept back for the weights, if it is. Null means no. Words are runs of
    ``[^\\x20\\x09-\\x0D]`` with A-Z lower-cased, and each text ends with one more token; null and empty texts are that end alone. Long texts
    are read whole. Rows that repeat, or have no id, each count and get a score. Without training texts all weight is on unseen words.
    """
    yes = lambda c: F.coalesce(c, F.lit(False))
    part = F.when(~yes(learn), OTHER).when(yes(keep_back), KEPT_BACK).otherwise(LEARNED).cast("int")
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), part.alias("part"))
    blocks = durable(texts.mapInArrow(_blocks(block_tokens), _BLOCK))
    size = blocks.agg(F.sum("tokens")).first()[0] or 0
    bits = max(LEAST_SLOTS, size // SLOT_TOKENS).bit_length() - 1
    answers = None
    for o in range(1, order + 1):  # one order's questions are on disk at a time
        asked = blocks.mapInArrow(_requests(order, bits, o), "block long, slot int, hashes binary, learned binary, kept binary")
        told = durable_alone(asked.repartition("slot").sortWithinPartitions("slot").mapInArrow(_answers(bits), _ANSWER))
        answers = told if answers is None else answers.unionByName(told)
    types, learned, tokens = (x or 0 for x in answers.agg(F.sum("types"), F.sum("learned_tokens"), F.sum("tokens")).first())
    model = Model(order, tokens, types, np.zeros((order, BUCKETS)), [], blocks, answers.drop("types", "learned_tokens", "tokens"), bits)
    kept = blocks.where("kept_back")
    theirs = model.answers.join(kept.select("block"), "block", "left_semi")
    tuples = durable(model._dealt(kept, theirs).mapInArrow(_met(order, bits, _tuples(order, learned)), "counts binary, times binary"))
    model.weights, model.steps = _learn(tuples, order, types)
    return model


def score_texts(docs: DataFrame, order: int = 3) -> DataFrame:
    """(doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score) for each row of docs (doc_id, text).

    Learned from rows whose crc32(doc_id) mod 7 is not 2 (a tenth of them, by the same number, kept back for the weights); held_out
    says that it is 2. Rows without an id are not learned from, nor held out. base_score is the add-one word model's, score the mixture's log10 probability.
    """
    crc = F.crc32(F.col("doc_id").cast("long").cast("string").cast("binary"))
    held = crc % 7 == 2
    model = deleted_interpolation(docs, ~held, F.floor(crc / 7) % 10 == 0, order)
    return model.scores().withColumn("held_out", F.col("held_out") & F.col("doc_id").isNotNull())
