"""Models as columns: ONNX sessions in Arrow functions, and stand-ins that need no files.

A model is loaded once for each Python worker, and anew when its file changes. A row whose inference fails gets null, which the
scoring plan (``cascade``) marks as degraded; other rows keep their scores.
"""

from __future__ import annotations

import json
import os
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sparkwarden.functions import constants as C

_loaded: dict = {}


def loaded(key, load: Callable):
    """What load() gives, once for each worker and key. A key that holds a file's time makes a changed file load anew."""
    name, version = key
    if _loaded.get(name, (None, None))[0] != version:
        _loaded[name] = version, load()
    return _loaded[name][1]


def version_of(path: str) -> int:
    return os.stat(path).st_mtime_ns if os.path.exists(path) else 0


def safely(run: Callable[[list], list], items: list) -> list:
    """run over all items at once; if that fails, one by one, and None for those that fail. So a bad row costs no other its answer."""
    if not items:
        return []
    try:
        out = list(run(items))
        if len(out) != len(items):
            raise ValueError("a model must answer each row")
        return out
    except Exception:
        if len(items) == 1:
            return [None]
        return [safely(run, [x])[0] for x in items]


def model_column(load: Callable[[], Callable[[list], list]], kind: str, name: str, path: str | None = None):
    """A column function over a model. load: gives, in the worker, a function of a list of inputs to a list of answers of the Spark type ``kind``.

    Null inputs and rows whose inference fails are null. path: a file whose change loads the model anew with the next batch (hot reload).
    """

    @F.pandas_udf(kind)
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for s in batches:
            model = loaded((name, version_of(path) if path else 0), load)
            out = pd.Series([None] * len(s), dtype=object)
            some = [i for i, x in enumerate(s) if x is not None]
            for i, y in zip(some, safely(model, [s.iloc[i] for i in some]), strict=True):
                out.iloc[i] = y
            yield pd.to_numeric(out) if kind in ("double", "float") else out

    return run


def embedder(load: Callable, name: str = "embedder", path: str | None = None):
    """Texts to vectors of length 1; null where the model fails or gives a zero or non-finite vector."""

    def units():
        model = load()

        def run(texts: list) -> list:
            out = []
            for v in model(texts):
                v = np.asarray(v, np.float64)
                n = np.linalg.norm(v)
                out.append((v / n).tolist() if np.isfinite(n) and n > 0 else None)
            return out

        return run

    return model_column(units, "array<double>", name, path)


def pair_scorer(load: Callable, name: str = "cross", path: str | None = None):
    """An array of structs (text, other) to an array of scores in [0, 1]: a cross-encoder's sigmoid over all pairs of a batch at once."""

    def flat():
        model = load()

        def run(rows: list) -> list:
            pairs = [(p["text"], p["other"]) for row in rows for p in row]
            scores = iter(1 / (1 + np.exp(-np.asarray(model(pairs), np.float64)))) if pairs else iter(())
            return [[float(next(scores)) for _ in row] for row in rows]

        return run

    return model_column(flat, "array<double>", name, path)


def tagger(load: Callable, name: str = "tagger", path: str | None = None):
    """Texts to entities (type, text, score); the model gives lists of such triples."""
    return model_column(load, "array<struct<type:string,text:string,score:double>>", name, path)


def preload(spark: SparkSession, probes: dict[str, Column], strict: bool = False, tasks: int | None = None) -> DataFrame:
    """(model, tasks, answered, status) of models that each answer a probe in so many tasks (by default one for each core), so that workers have them loaded before rows come.

    probes: a model's column over a literal, such as ``{"ner": tagger(load)(F.lit("warm-up"))}``; null is no answer. status is
    loaded or failed. strict: a model that fails in any task raises.
    """
    n = tasks or spark.sparkContext.defaultParallelism
    asked = spark.range(0, n, 1, n).select(*[probe.isNotNull().alias(f"_{k}") for k, probe in enumerate(probes.values())])
    counts = asked.agg(*[F.count_if(f"_{k}").alias(f"_{k}") for k in range(len(probes))]).first() if probes else ()
    found = [(name, n, answered, "loaded" if answered == n else "failed") for name, answered in zip(probes, counts, strict=True)]
    if strict and (bad := [name for name, _, _, status in found if status != "loaded"]):
        raise RuntimeError(f"models that don't answer: {', '.join(bad)}")
    return spark.createDataFrame(found, "model string, tasks int, answered long, status string")


def onnx_session(path: str):
    import onnxruntime

    options = onnxruntime.SessionOptions()
    options.intra_op_num_threads = 1
    return onnxruntime.InferenceSession(path, options)


def load_scale(text: str, width: int) -> list[float]:
    """A fitted scaler's scales from JSON; wrong width, non-finite or zero scales raise."""
    scale = json.loads(text)["scale"]
    if len(scale) != width or not np.isfinite(scale).all() or not np.all(scale):
        raise ValueError("scaler doesn't fit the features")
    return [float(x) for x in scale]


def onnx_classifier(path: str, neutral: float | None = 0.5):
    """A function of a feature array column to the probability of class 1; null for a row whose inference fails, neutral where there is no model file.

    neutral: score of a row without features as well, None to ask the model.
    """

    def load():
        if not os.path.exists(path):
            return lambda rows: [0.5 if neutral is None else neutral] * len(rows)
        session = onnx_session(path)

        def run(rows: list) -> list:
            x = np.stack([np.asarray(r, np.float32) for r in rows])
            p = session.run(None, {session.get_inputs()[0].name: x})[-1]
            p = np.asarray(p).reshape(len(x), -1)[:, -1] if isinstance(p, np.ndarray) else np.array([r[1] for r in p])
            return (np.where(np.any(x, 1), p, neutral) if neutral is not None else p).tolist()

        return run

    return model_column(load, "double", path, path)


def linear_classifier(features: Column, weights: list[float], bias: float, neutral: float | None = None) -> Column:
    """A logistic model inside Catalyst."""
    w = F.array(*[F.lit(float(x)) for x in weights])
    z = F.aggregate(F.zip_with(features.cast("array<double>"), w, lambda a, b: a * b), F.lit(float(bias)), lambda s, x: s + x)
    p = 1.0 / (1.0 + F.exp(-z))
    return p if neutral is None else F.when(F.exists(features, lambda x: x != 0), p).otherwise(F.lit(neutral))


def zero_probe(df: DataFrame, model, width: int) -> DataFrame:
    """One row: what the model says of a row without features."""
    zero = df.sparkSession.range(1).select(F.array_repeat(F.lit(0.0), width).alias("features"))
    return zero.select(model(F.col("features")).alias("score"))


def disabled_stages(df: DataFrame) -> DataFrame:
    """Columns of stages that are off: no duplicates, candidates, entities or novelty."""
    off = {"is_duplicate": "false", "dedup_similarity": "0.0D", "novelty_score": "0.0D", "cross_encoder_max": "0.0D", "entity_boost": "0.0D", "dedup_penalty": "0.0D", "ai_entities": "''", "ai_mitre_technique": "''"}
    return df.withColumns({k: F.expr(v) for k, v in off.items()})


def rule_entities(text: Column) -> Column:
    """Entities (type, text, score) by patterns, where no tagger is at hand: addresses and digests, vulnerabilities, malware."""
    kinds = [("Indicator", r"\b(?:\d{1,3}\.){3}\d{1,3}\b|\b[0-9a-fA-F]{32,64}\b", 0.95), ("Vulnerability", r"(?i)\bcve-\d{4}-\d+\b", 0.99), ("Malware", r"(?i)\b(?:mimikatz|trojan|ransomware|rootkit)\b", 0.9)]

    def tagged(kind: str, pattern: str, sure: float) -> Column:
        return F.transform(F.regexp_extract_all(text, F.lit(f"({pattern})"), F.lit(1)), lambda m: F.struct(F.lit(kind).alias("type"), m.alias("text"), F.lit(sure).alias("score")))

    found = [tagged(*k) for k in kinds]
    return F.concat(*found)


def entity_string(entities: Column) -> Column:
    """Texts of entities in the order of types, each once, joined by commas."""
    of = lambda t: F.transform(F.filter(entities, lambda e: e["type"] == t), lambda e: e["text"])
    return F.array_join(F.array_distinct(F.concat(*[of(t) for t in C.ENTITY_TYPES])), ",")


def token_overlap_scores(text: Column, candidates: Column) -> Column:
    """candidates (struct no, id, description) with ``score``: a stand-in for a cross-encoder, the share of the description's words in the text."""
    words = lambda s: F.array_distinct(F.regexp_extract_all(F.lower(s), F.lit("([a-z0-9]{3,})"), F.lit(1)))
    own = words(text)
    share = lambda d: F.coalesce(F.try_divide(F.size(F.array_intersect(own, words(d))).cast("double"), F.size(words(d)).cast("double")), F.lit(0.0))
    return F.transform(candidates, lambda c: F.struct(c["no"].alias("no"), c["id"].alias("id"), share(c["description"]).alias("score")))
