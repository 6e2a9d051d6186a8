"""Quality by a sparse ensemble of rules.

Statistics of each whole text are measured once. Small boosted trees are grown on them; every path from a root is a
conjunction of comparisons. A logistic model with an L1 penalty over these rules keeps few, and
those become one Spark column expression over the statistics.
"""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sparkwarden.llm import textkit as tk
from sparkwarden.llm.session import durable, parts

#: Labelled rows that are fitted on (as expected; drawn by a hash of the id), rules kept at most, and the score from which on a text is good.
SAMPLE, RULES, GOOD = 20_000, 60, 0.3

STATS = [
    "bytes", "words", "word_length", "longest_word", "lines", "line_length", "upper", "digit", "mark", "beyond", "pipe", "symbol", "bang", "stop", "comma",
    "distinct", "distinct_pairs", "stutter", "lone_marks", "marked_words", "upper_words", "lines_ended", "lines_again", "short_words",
]


def _mask(chars: str) -> np.ndarray:
    m = np.zeros(256, bool)
    m[[ord(c) for c in chars]] = True
    return m


_UPPER, _DIGIT = _mask("ABCDEFGHIJKLMNOPQRSTUVWXYZ"), _mask("0123456789")
_LETTER = _UPPER | _mask("abcdefghijklmnopqrstuvwxyz") | (np.arange(256) >= 128)
_MARK = ~_LETTER & ~_DIGIT & tk.SPACED
_LINE = np.ones(256, bool)
_LINE[[10, 13]] = False
_END = _mask(".!?:;\"')")


def measure(texts: tk.Texts) -> np.ndarray:
    """A row of STATS for each text; shares of nothing are 0."""
    raw, n = texts.data, len(texts)
    low = tk.LOWER[raw]

    def per_text(mask):
        return np.diff(np.concatenate(([0], np.cumsum(mask)))[texts.bounds]).astype(float)

    def share(a, b):
        return np.divide(a, b, out=np.zeros(n), where=b > 0)

    def distinct(h, of):
        key = np.unique(tk.mix(h ^ tk.mix(of.astype(np.uint64))) & ~np.uint64(0xFFFF) | (of & 0xFFFF).astype(np.uint64)) & np.uint64(0xFFFF)
        return np.bincount(key.astype(np.int64), minlength=n)[:n].astype(float)

    def total(values, of):
        return np.bincount(of, values, minlength=n)[:n]

    size = np.diff(texts.bounds).astype(float)
    w = tk.words(texts, tk.SPACED, low)
    of, count, length = np.repeat(np.arange(n), w.count), w.count.astype(float), (w.end - w.start).astype(float)
    h = tk.word_hashes(low, w)
    same_text = of[1:] == of[:-1]
    pairs = tk.grams(h, 2)[same_text] if len(h) > 1 else h[:0]
    lines = tk.words(texts, _LINE, low)
    line_of, line_length = np.repeat(np.arange(n), lines.count), (lines.end - lines.start).astype(float)
    line_h = tk.word_hashes(low, lines)
    letters, visible = per_text(_LETTER[raw]), per_text(tk.SPACED[raw])
    longest = np.zeros(n)
    np.maximum.at(longest, of, length)
    marks_in = np.concatenate(([0], np.cumsum(_MARK[raw])))
    marks = marks_in[w.end] - marks_in[w.start]
    upper_in = np.concatenate(([0], np.cumsum(_UPPER[raw])))
    upper_words = (upper_in[w.end] - upper_in[w.start]) >= 2
    again = share(lines.count - distinct(line_h, line_of), lines.count.astype(float))
    columns = [
        size, count, share(total(length, of), count), longest, lines.count.astype(float), share(total(line_length, line_of), lines.count.astype(float)),
        share(per_text(_UPPER[raw]), letters), share(per_text(_DIGIT[raw]), visible), share(per_text(_MARK[raw]), visible), share(per_text(raw >= 128), visible),
        share(per_text(raw == ord("|")), count), share(per_text(_mask("#$%&*@^~<>{}[]=+_\\")[raw]), count), share(per_text(raw == ord("!")), count), share(per_text(raw == ord(".")), count), share(per_text(raw == ord(",")), count),
        share(distinct(h, of), count), share(distinct(pairs, of[1:][same_text]), count), share(total((h[1:] == h[:-1])[same_text].astype(float), of[1:][same_text]), count),
        share(total((marks == length).astype(float), of), count), share(total((marks >= 2).astype(float), of), count), share(total(upper_words.astype(float), of), count),
        share(total(_END[raw[lines.end - 1]].astype(float) if len(raw) else np.zeros(0), line_of), lines.count.astype(float)), again, share(total((length <= 2).astype(float), of), count),
    ]
    return np.stack(columns, 1)


def statistics(docs: DataFrame) -> DataFrame:
    """(doc_id, version, STATS...) for each row of docs (doc_id, text); null text as empty. version: a hash of the text."""

    def run(batches):
        for batch in parts(batches):
            found = [measure(cut) for texts in tk.slices(batch.column("text")) for cut in _cuts(texts)]
            x = np.concatenate(found) if found else np.zeros((0, len(STATS)))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("version"), *(pa.array(x[:, k]) for k in range(len(STATS)))], ["doc_id", "version", *STATS])

    text = F.col("text").cast("string")
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64(text).alias("version"), text.alias("text"))
    return rows.mapInArrow(run, "doc_id long, version long, " + ", ".join(f"{s} double" for s in STATS))


def _cuts(texts: tk.Texts):
    """At most 2**16 texts at a time, which ``distinct`` can tell apart."""
    for i in range(0, len(texts), 1 << 16):
        b = texts.bounds[i : i + (1 << 16) + 1]
        yield tk.Texts(texts.data[b[0] : b[-1]], b - b[0], 0)


@dataclass
class Ensemble:
    """score = 1 / (1 + exp(-(bias + sum of weight * rule))). A rule: tuple of (statistic, above, value)."""

    bias: float
    rules: list[tuple[tuple, float]] = field(default_factory=list)

    def score(self) -> Column:
        logit = F.lit(float(self.bias))
        for rule, weight in self.rules:
            test = F.lit(True)
            for name, above, value in rule:
                test = test & ((F.col(name) > float(value)) if above else (F.col(name) <= float(value)))
            logit = logit + F.when(test, F.lit(float(weight))).otherwise(F.lit(0.0))
        return 1.0 / (1.0 + F.exp(-logit))


def grow(x: np.ndarray, y: np.ndarray, trees: int = 40, depth: int = 3, bins: int = 24, least: int = 8) -> list[tuple]:
    """Paths of boosted trees over binned statistics, all nodes but the roots, without repeats."""
    edges = [np.unique(np.quantile(x[:, k], np.linspace(0.02, 0.98, bins))) for k in range(x.shape[1])]
    codes = np.stack([np.searchsorted(e, x[:, k], "left") for k, e in enumerate(edges)], 1)
    # A comparison is made half way to the next value above the edge, so that what lies near what was seen falls with it.
    middles = [np.array([(v + min(x[x[:, k] > v, k], default=v)) / 2 for v in e]) for k, e in enumerate(edges)]
    rules, margin = {}, np.full(len(y), np.log((y.mean() + 1e-3) / (1 - y.mean() + 1e-3)))
    for _ in range(trees):
        p = 1 / (1 + np.exp(-margin))
        g, v = y - p, p * (1 - p) + 1e-6

        def split(rows, path, level, g=g, v=v):
            gain, best = 1e-3, None
            total_g, total_v = g[rows].sum(), v[rows].sum()
            if level < depth:
                for k, e in enumerate(edges):
                    c = codes[rows, k]
                    lg = np.cumsum(np.bincount(c, g[rows], minlength=len(e) + 1))[:-1]
                    lv = np.cumsum(np.bincount(c, v[rows], minlength=len(e) + 1))[:-1]
                    ln = np.cumsum(np.bincount(c, minlength=len(e) + 1))[:-1]
                    s = lg**2 / (lv + 1) + (total_g - lg) ** 2 / (total_v - lv + 1) - total_g**2 / (total_v + 1)
                    s[(ln < least) | (len(rows) - ln < least)] = -1
                    if len(s) and s.max() > gain:
                        gain, best = s.max(), (k, int(s.argmax()))
            if best is None:
                margin[rows] += 0.3 * total_g / (total_v + 1)
                return
            k, j = best
            low = codes[rows, k] <= j
            for part, above in ((rows[low], False), (rows[~low], True)):
                own = (*path, (STATS[k], above, float(middles[k][j])))
                rules[tuple(sorted(own))] = None
                split(part, own, level + 1)

        split(np.arange(len(y)), (), 0)
    return list(rules)


def fires(x: np.ndarray, rules: list[tuple]) -> np.ndarray:
    at = {s: k for k, s in enumerate(STATS)}
    return np.stack([np.logical_and.reduce([x[:, at[s]] > v if above else x[:, at[s]] <= v for s, above, v in rule]) for rule in rules], 1).astype(np.float32)


def lasso(r: np.ndarray, y: np.ndarray, penalty: float, rounds: int = 300) -> tuple[np.ndarray, float]:
    """Logistic weights of the columns of r under an L1 penalty, and the bias, by accelerated proximal gradients."""
    r1 = np.concatenate([r, np.ones((len(r), 1), r.dtype)], 1)
    v = np.random.default_rng(0).normal(size=r1.shape[1])
    for _ in range(20):
        v = r1.T @ (r1 @ v)
        v /= np.linalg.norm(v) + 1e-12
    step = 4 * len(r) / (np.linalg.norm(r1 @ v) ** 2 + 1e-9)
    w = np.zeros(r1.shape[1])
    z, t = w.copy(), 1.0
    for _ in range(rounds):
        g = r1.T @ (1 / (1 + np.exp(-np.clip(r1 @ z, -30, 30))) - y) / len(r)
        new = z - step * g
        new[:-1] = np.sign(new[:-1]) * np.maximum(np.abs(new[:-1]) - step * penalty, 0)
        t, before = (1 + np.sqrt(1 + 4 * t * t)) / 2, t
        z = new + (before - 1) / t * (new - w)
        w = new
    return w[:-1], float(w[-1])


def fit_rules(x: np.ndarray, y: np.ndarray, most: int = RULES) -> Ensemble:
    """An ensemble out of statistics and 0/1 labels; with one label or none, only a bias."""
    if len(y) == 0:
        return Ensemble(0.0)
    if len(set(y.tolist())) < 2 or not (rules := grow(x, y)):
        rate = (y.sum() + 1) / (len(y) + 2)
        return Ensemble(float(np.log(rate / (1 - rate))))
    r, penalty = fires(x, rules), 1e-3
    while True:
        w, bias = lasso(r, y, penalty)
        kept = np.flatnonzero(np.abs(w) > 1e-4)
        if len(kept) <= most:
            return Ensemble(bias, [(rules[k], float(w[k])) for k in kept])
        penalty *= 1.5


def fit(stats: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> Ensemble:
    """Fits on labels (doc_id, quality) joined to stats; labels that are null, or disagree for an id, are left out. Of rows that repeat a labelled id one counts."""
    known = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("quality").cast("int").alias("quality")).where("doc_id is not null and quality is not null")
    known = known.groupBy("doc_id").agg(F.min("quality").alias("quality"), F.max("quality").alias("top")).where("quality = top").drop("top")
    known = durable(known)
    n = known.count()
    if n > sample:
        known = known.where(F.pmod(F.xxhash64("doc_id"), F.lit(1_000_000)) < F.lit(int(1_000_000 * sample / n)))
    one = stats.join(F.broadcast(known), "doc_id").groupBy("doc_id", "quality").agg(F.min(F.struct("version", *STATS)).alias("s"))
    rows = one.orderBy("doc_id").select("quality", *[f"s.{c}" for c in STATS]).toPandas()
    return fit_rules(rows[STATS].to_numpy(float), (rows["quality"].to_numpy() == 1).astype(float))


def score_quality(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """(doc_id, version, held_out, score, predicted) for each row of docs (doc_id, text).

    Fitted on labels whose crc32(doc_id) mod 5 is not 0; held_out says that it is. Only the text's statistics are
    inputs, and the empty text has such too. A null id is not held out and has no label. A text of any length is
    measured whole; equal texts get equal scores; without rows or without labels all is as docs has it, by the bias alone.
    """
    stats = durable(statistics(docs))

    def held(c):
        return F.coalesce(F.crc32(c.cast("long").cast("string").cast("binary")) % 5 == 0, F.lit(False))

    model = fit(stats, labels.where(~held(F.col("doc_id"))))
    scored = stats.withColumn("score", model.score())
    return scored.select("doc_id", "version", held(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= GOOD).cast("int").alias("predicted"))
