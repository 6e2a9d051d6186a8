"""Threat scores: a cost-gated cascade of models, floors, the composite, its label and its confidence."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sparkwarden.functions import constants as C
from sparkwarden.functions.vector import clamp
from sparkwarden.operators.rules import is_attack


@dataclass(frozen=True)
class Thresholds:
    high: float = C.HIGH
    medium: float = C.MEDIUM
    low: float = C.LOW

    def __post_init__(self):
        if not 0 <= self.low < self.medium < self.high <= 1:
            raise ValueError("thresholds must be 0 <= low < medium < high <= 1")


@dataclass(frozen=True)
class Band:
    """Scores that the second tier looks at, both ends included."""

    low: float
    high: float

    def __post_init__(self):
        if not 0 <= self.low <= self.high <= 1:
            raise ValueError("a band must be 0 <= low <= high <= 1")


def cascade(df: DataFrame, condition: Column, model: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """model over the rows of the condition, null as false, and the rest as it is.

    A condition around a Python function still runs it on every row; two branches do not.
    """
    chosen = F.coalesce(condition, F.lit(False))
    return model(df.where(chosen)).unionByName(df.where(~chosen), allowMissingColumns=True)


def classify(df: DataFrame, syslog_model: Callable[[DataFrame], Column], event_model: Callable[[DataFrame], Column]) -> DataFrame:
    """classifier_score by the model of a row's source type: lines of SYSLOG_MODEL_TYPES by the one, others by the other."""
    syslog = F.col("source_type").isin(*C.SYSLOG_MODEL_TYPES)
    one = lambda part: part.withColumn("classifier_score", clamp(syslog_model(part)))
    other = lambda part: part.withColumn("classifier_score", clamp(event_model(part)))
    return one(df.where(syslog)).unionByName(other(df.where(F.coalesce(~syslog, F.lit(True)))))


def in_band(df: DataFrame, band: Band) -> Column:
    """Whether the second tier is meant for a row: its score is in the band, and it isn't syslog-like."""
    return F.coalesce(F.col("classifier_score").between(band.low, band.high) & ~F.col("source_type").isin(*C.SYSLOG_MODEL_TYPES), F.lit(False))


def second_tier(df: DataFrame, band: Band, model: Callable[[DataFrame], Column], drifting: Column | None = None, split: bool = True) -> DataFrame:
    """tier2_score, tier2_used and the classifier_score it replaces, for rows in the band that aren't syslog-like; skipped while drift is on. A null score keeps the first tier's.

    split: rows that the model doesn't see go another way; a model of built-in functions needs no split, as a condition is enough.
    """
    inside = in_band(df, band)
    if drifting is not None:
        inside = inside & ~drifting

    def run(part: DataFrame) -> DataFrame:
        part = part.withColumn("tier2_score", clamp(model(part)))
        return part.withColumn("tier2_used", F.col("tier2_score").isNotNull()).withColumn("classifier_score", F.coalesce("tier2_score", "classifier_score"))

    if not split:
        told = df.withColumn("tier2_score", F.when(inside, clamp(model(df))))
        return told.withColumn("tier2_used", F.col("tier2_score").isNotNull()).withColumn("classifier_score", F.coalesce("tier2_score", "classifier_score"))
    return cascade(df, inside, run).withColumn("tier2_used", F.coalesce("tier2_used", F.lit(False)))


def floors(classifier: Column, raw: Column, sigma: Column) -> Column:
    """The classifier's score lifted by attack signatures and by matched rules."""
    attack = F.when(is_attack(raw), F.greatest(classifier, F.lit(C.ATTACK_FLOOR))).otherwise(classifier)
    return F.when(sigma, F.greatest(attack, F.lit(C.SIGMA_FLOOR))).otherwise(attack)


def composite(classifier: Column, entity: Column, cross: Column, novelty: Column, penalty: Column, w_novelty: float = C.W_NOVELTY) -> Column:
    """The weighted sum, in [0, 1]. The penalty counts only where a cross-encoder's score does, as duplicates have none."""
    paid = F.when(cross > 0, penalty).otherwise(F.lit(0.0))
    return clamp(C.W_CLASSIFIER * classifier + C.W_ENTITY * entity + C.W_CROSS * cross + w_novelty * novelty - paid)


def priority(score: Column, sigma: Column, t: Thresholds = Thresholds()) -> Column:
    return F.when(sigma | (score >= t.high), "HIGH").when(score >= t.medium, "MEDIUM").when(score >= t.low, "LOW").otherwise("INFO")


def confidence(classifier: Column, entity_confidence: Column, cross: Column) -> Column:
    """Mean of the signals there are: scores above 0, and the entities' confidence (even 0) where entities were looked for."""
    signals = F.filter(F.array(F.when(classifier > 0, classifier), entity_confidence, F.when(cross > 0, cross)), lambda s: s.isNotNull())
    return F.when(F.size(signals) > 0, F.aggregate(signals, F.lit(0.0), lambda a, s: a + s) / F.size(signals)).otherwise(F.lit(0.0))


def entity_boost(types: Column) -> Column:
    return F.when(F.arrays_overlap(types, F.array(*[F.lit(t) for t in C.BOOST_TYPES])), F.lit(C.ENTITY_BOOST)).otherwise(F.lit(0.0))


def keep_entities(entities: Column, least: float) -> Column:
    """Entities (struct type, text, score) of enough confidence that aren't outside or blank, without a leading piece mark."""
    clean = F.transform(entities, lambda e: F.struct(e["type"].alias("type"), F.regexp_replace(e["text"], "^#+", "").alias("text"), e["score"].alias("score")))
    return F.filter(clean, lambda e: (e["score"] >= least) & (e["type"] != "O") & (F.btrim(e["text"]) != ""))


def rerank(candidates: Column) -> Column:
    """Candidates (struct with score and no) by score, highest first, ties by no."""
    sign = lambda a, b: F.when(a["score"] > b["score"], -1).when(a["score"] < b["score"], 1).when(a["no"] < b["no"], -1).when(a["no"] > b["no"], 1).otherwise(0)
    return F.array_sort(candidates, sign)


def score(df: DataFrame, t: Thresholds = Thresholds(), w_novelty: float = C.W_NOVELTY) -> DataFrame:
    """ai_threat_score, ai_priority and ai_confidence out of the signals' columns; those that are missing count as off."""
    signals = {"entity_boost": "0.0D", "cross_encoder_max": "0.0D", "novelty_score": "0.0D", "dedup_penalty": "0.0D", "entity_confidence": "CAST(NULL AS DOUBLE)", "sigma_matched": "false"}
    for name, value in signals.items():
        if name not in df.columns:
            df = df.withColumn(name, F.expr(value))
    df = df.withColumn("classifier_score", floors(F.col("classifier_score"), F.col("raw"), F.col("sigma_matched")))
    df = df.withColumn("dedup_penalty", F.when(is_attack(F.col("raw")), F.lit(0.0)).otherwise(F.col("dedup_penalty")))
    df = df.withColumn("ai_threat_score", composite(*[F.col(c) for c in ("classifier_score", "entity_boost", "cross_encoder_max", "novelty_score", "dedup_penalty")], w_novelty))
    return df.withColumn("ai_priority", priority(F.col("ai_threat_score"), F.col("sigma_matched"), t)).withColumn("ai_confidence", confidence(F.col("classifier_score"), F.col("entity_confidence"), F.col("cross_encoder_max")))
