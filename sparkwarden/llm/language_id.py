"""Language identification by error-correcting output codes.

Each language has a codeword of +1 and -1. For each bit a binary logistic classifier over byte n-gram
profiles says on which side a text is; decoding adds up each language's logistic losses, so a bit counts by the
certainty of its classifier, and the language of least loss is chosen. Where the two nearest codewords are
about as near, the row is flagged.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sparkwarden.llm import textkit as tk
from sparkwarden.llm.grams import WIDTH, profiles
from sparkwarden.llm.session import parts

#: Labelled rows that classifiers are fitted on, as expected (drawn by a hash of id and text): of each language, in all, and of each at least.
PER_LANGUAGE, SAMPLE, LEAST = 500, 8_000, 20
#: Certainty under which a row is flagged.
CLEAR = 0.75


def codewords(n: int, seed: int = 11) -> np.ndarray:
    """A row of +-1 for each of n classes: all distinct splits for up to 5 classes, else the best of some random codes."""
    if n == 1:
        return np.ones((1, 1), np.float32)
    if n <= 5:
        bits = np.array([[(k >> (n - 1 - c)) & 1 if c else 0 for k in range(1, 2 ** (n - 1))] for c in range(n)])
        return (1 - 2 * bits).astype(np.float32)
    rng, best, far = np.random.default_rng(seed), None, -1
    width = int(np.ceil(10 * np.log2(n)))
    for _ in range(max(5, 2_000 // n)):
        code = rng.choice([-1.0, 1.0], (n, width))
        d = (width - code @ code.T) / 2 + width * np.eye(n)
        if (np.abs(code.sum(0)) < n).all() and d.min() > far:
            best, far = code, d.min()
    return best.astype(np.float32)


def fit_bits(x: np.ndarray, y: np.ndarray, weight: np.ndarray, decay: float = 1e-4, rounds: int = 150) -> tuple[np.ndarray, np.ndarray]:
    """Logistic weights (width, bits) and biases of y (rows, bits; +-1), by accelerated gradients.

    Weights stay sums of rows, so where rows are few their products take the place of x and the steps are those of the rows' factors.
    """
    few = 2 * len(x) <= x.shape[1]
    products = x @ x.T if few else None
    w, b = np.zeros((len(x) if few else x.shape[1], y.shape[1]), np.float32), np.zeros(y.shape[1], np.float32)
    v, c, t = w, b, 1.0
    weight = (weight / weight.sum())[:, None].astype(np.float32)
    for _ in range(rounds):
        margin = (products if few else x) @ v + c
        g = -weight * y / (1 + np.exp(np.clip(y * margin, -30, 30)))
        new_v, new_c = v - 2.0 * ((g if few else x.T @ g) + decay * v), c - 2.0 * g.sum(0)
        t, before = (1 + np.sqrt(1 + 4 * t * t)) / 2, t
        step = np.float32((before - 1) / t)
        v, c = new_v + step * (new_v - w), new_c + step * (new_c - b)
        w, b = new_v, new_c
    return x.T @ w if few else w, b


def decode(margins: np.ndarray, code: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The class of least loss for each row of margins, and its certainty."""
    loss = np.logaddexp(0, -margins[:, None, :] * code[None]).sum(2)
    p = np.exp(loss.min(1, keepdims=True) - loss)
    return loss.argmin(1), p.max(1) / p.sum(1)


def _has_letter(text: str) -> bool:
    return any(c.isalpha() for c in text)


def _features(batches):
    for batch in parts(batches):
        rows = [row for texts in tk.slices(batch.column("text")) for row in profiles(texts).astype(np.float16)]
        yield pa.RecordBatch.from_arrays([batch.column("lang"), pa.array([x.tobytes() for x in rows], pa.binary())], ["lang", "x"])


class Model:
    def __init__(self, languages: list[str], x: np.ndarray, lang: list[str]):
        self.languages = sorted(languages)
        self.code = codewords(len(self.languages)) if self.languages else np.zeros((0, 1), np.float32)
        if len(self.languages) > 1:
            c = np.array([self.languages.index(s) for s in lang])
            counts = np.bincount(c, minlength=len(self.languages))
            self.w, self.b = fit_bits(x, self.code[c], 1.0 / counts[c])
        else:
            self.w, self.b = np.zeros((WIDTH, 1), np.float32), np.full(1, 9.0, np.float32)

    def predict(self, x: np.ndarray) -> tuple[list[str], np.ndarray]:
        if not self.languages:
            return ["und"] * len(x), np.zeros(len(x))
        best, sure = decode(x @ self.w + self.b, self.code)
        return [self.languages[i] for i in best], sure


def fit(labelled: DataFrame, per_language: int = PER_LANGUAGE, sample: int = SAMPLE) -> Model:
    """A model out of labelled (doc_id, text, lang); rows without a language or text are left out, those that repeat an id and a text count once.

    Each language brings its share of the sample, but LEAST rows as expected (all, if it has fewer), so none is lost.
    """
    known = labelled.select(F.col("doc_id").cast("string").alias("doc_id"), F.col("text").cast("string").alias("text"), F.col("lang").cast("string").alias("lang")).where("lang is not null and text is not null")
    counts = dict(known.groupBy("lang").count().collect())  # a row for each language
    if not counts:
        return Model([], np.zeros((0, WIDTH), np.float32), [])
    most = max(LEAST, min(per_language, sample // len(counts)))
    shares = labelled.sparkSession.createDataFrame([(k, min(1.0, most / n)) for k, n in counts.items()], "lang string, share double")
    draw = F.pmod(F.xxhash64("doc_id", "text"), F.lit(1 << 40)) / float(1 << 40)
    drawn = known.join(F.broadcast(shares), "lang").where(draw < F.col("share"))  # a row for each language
    drawn = drawn.dropDuplicates(["doc_id", "text"]).select("text", "lang")
    rows = drawn.mapInArrow(_features, "lang string, x binary").collect()
    if not rows:
        return Model([], np.zeros((0, WIDTH), np.float32), [])
    rows.sort(key=lambda r: (r.lang, bytes(r.x)))
    x = np.frombuffer(b"".join(bytes(r.x) for r in rows), np.float16).reshape(len(rows), WIDTH).astype(np.float32)
    return Model(sorted({r.lang for r in rows}), x, [r.lang for r in rows])


def predict(docs: DataFrame, model: Model) -> DataFrame:
    """(doc_id, lang_pred, score, ambiguous) for each row of docs (doc_id, text), from its whole text only.

    ``und`` with score 0 if the text is null or has no letter (or no language was learned).
    """
    spark = docs.sparkSession
    shared = spark.sparkContext.broadcast(model)  # WIDTH numbers for each bit

    def run(batches):
        m = shared.value
        for batch in parts(batches):
            best, sure = [], []
            for texts in tk.slices(batch.column("text")):
                b, s = m.predict(profiles(texts))
                best += b
                sure += s.tolist()
            for i, text in enumerate(batch.column("text")):
                if (text := text.as_py()) is None or not _has_letter(text):
                    best[i], sure[i] = "und", 0.0
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array(best, pa.string()), pa.array(sure, pa.float64()), pa.array([s < CLEAR for s in sure], pa.bool_())], ["doc_id", "lang_pred", "score", "ambiguous"]
            )

    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return texts.mapInArrow(run, "doc_id long, lang_pred string, score double, ambiguous boolean")


def identify(docs: DataFrame) -> DataFrame:
    """(doc_id, held_out, lang_pred, score, ambiguous): fitted on rows whose crc32(doc_id) mod 3 is not 1; held_out says that it is. A null id is neither."""
    held = F.coalesce(F.crc32(F.col("doc_id").cast("long").cast("string").cast("binary")) % 3 == 1, F.lit(False))
    model = fit(docs.where(~held & F.col("doc_id").isNotNull()))
    return predict(docs, model).select("doc_id", held.alias("held_out"), "lang_pred", "score", "ambiguous")
