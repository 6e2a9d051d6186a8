"""The whole scoring plan: rules, a classifier by source type, a second tier, duplicates, candidates, entities, a cross-encoder, novelty, the score.

Models fail by rows: a model column is null where its inference failed. What failed degrades its row and no other:
a classifier's score becomes the neutral one, the second tier keeps the first one's, and a failure after that resets
all that the tier has said of the row. Novelty alone fails without a mark.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sparkwarden.functions import constants as C
from sparkwarden.functions.vector import clamp
from sparkwarden.operators import drift, folds, models, scoring, similarity
from sparkwarden.operators.rules import match_rules

Model = Callable[[DataFrame], Column]


@dataclass(frozen=True)
class Models:
    """Columns of models over normalised rows; each gives null where it fails. ``None``: the model isn't ready, or the stage is off.

    syslog, event and second give probabilities; entities an array of structs (type, text, score); cross an array of structs
    (no, id, score) for the candidates of a row. Embeddings are a column of the rows (``vector``).

    split: each model runs over the rows that are meant for it and no other, which reads the rows once for each way. Models of built-in
    functions alone need no split: a condition around them is enough, and the rows go one way.
    """

    syslog: Model | None = None
    event: Model | None = None
    second: Model | None = None
    entities: Model | None = None
    cross: Model | None = None
    band: scoring.Band = scoring.Band(0.3, 0.7)
    entity_confidence: float = 0.5
    split: bool = True


def first_tier(df: DataFrame, m: Models) -> DataFrame:
    """classifier_score and score_degraded. A failed row gets the neutral score; without any model all rows are degraded at 0."""
    syslog = F.coalesce(F.col("source_type").isin(*C.SYSLOG_MODEL_TYPES), F.lit(False))
    if m.syslog is None and m.event is None:
        return df.withColumns({"classifier_score": F.lit(0.0), "score_degraded": F.lit(True)})

    if not m.split:
        of = lambda model: F.lit(0.0) if model is None else clamp(model(df).cast("double"))
        told = df.withColumn("_p", F.when(syslog, of(m.syslog)).otherwise(of(m.event)))
        return told.withColumn("classifier_score", F.coalesce("_p", F.lit(C.NEUTRAL_SCORE))).withColumn("score_degraded", F.col("_p").isNull()).drop("_p")

    def run(part: DataFrame, model: Model | None) -> DataFrame:
        score = F.lit(0.0) if model is None else clamp(model(part).cast("double"))
        return part.withColumn("_p", score).withColumn("classifier_score", F.coalesce("_p", F.lit(C.NEUTRAL_SCORE))).withColumn("score_degraded", F.col("_p").isNull()).drop("_p")

    return run(df.where(syslog), m.syslog).unionByName(run(df.where(~syslog), m.event))


def with_fallback(df: DataFrame, seq: str, m: Models, monitor: folds.Drift) -> DataFrame:
    """The second tier under a monitor: drifting, tier2_score, tier2_used and the classifier_score that counts."""
    told = scoring.second_tier(df.withColumn("_first", F.col("classifier_score")), m.band, m.second, split=m.split)
    states = drift.fallback(told, seq, "_first", "tier2_score", monitor).select(seq, "drifting", "final_score")
    rows = told.join(states, seq)
    return rows.withColumns({"tier2_used": F.col("tier2_used") & ~F.col("drifting"), "tier2_score": F.when(~F.col("drifting"), F.col("tier2_score")), "classifier_score": F.col("final_score")}).drop("_first", "final_score")


def third_tier(df: DataFrame, vector: str, techniques: DataFrame, m: Models, k: int = 3, least: float = C.DEDUP_SIMILARITY) -> DataFrame:
    """is_duplicate by dedup_similarity (null without an earlier event), candidates, entities and cross-encoder scores. Candidates that the rows bring along are taken. Duplicates skip the last two; a row whose embedding, entities or cross scores failed is reset and degraded."""
    rows = df.withColumn("is_duplicate", F.coalesce(F.col("dedup_similarity") >= least, F.lit(False)))
    if "candidates" not in rows.columns:
        rows = similarity.with_candidates(rows, techniques, vector, k)
    new = F.col("candidates").isNotNull() & ~F.coalesce(F.col("is_duplicate"), F.lit(False))

    def run(part: DataFrame, of=lambda c: c) -> DataFrame:
        part = part.withColumn("_entities", of(m.entities(part)) if m.entities else F.array().cast("array<struct<type:string,text:string,score:double>>"))
        return part.withColumn("_cross", of(m.cross(part)) if m.cross else F.array().cast("array<struct<no:int,id:string,score:double>>"))

    rows = rows.withColumn("_new", new)
    rows = scoring.cascade(rows, F.col("_new"), run) if m.split else run(rows, lambda c: F.when(F.col("_new"), c))
    failed = F.col("candidates").isNull() | (F.col("_new") & (F.col("_entities").isNull() | F.col("_cross").isNull()))
    kept = scoring.keep_entities(F.col("_entities"), m.entity_confidence)
    best = F.try_element_at(scoring.rerank(F.col("_cross")), F.lit(1))
    said = {
        "is_duplicate": F.coalesce(F.col("is_duplicate"), F.lit(False)), "dedup_similarity": F.coalesce("dedup_similarity", F.lit(0.0)), "dedup_penalty": F.when(F.col("is_duplicate"), F.lit(C.DEDUP_PENALTY)).otherwise(F.lit(0.0)),
        "ai_entities": F.coalesce(models.entity_string(kept), F.lit("")), "entity_boost": F.coalesce(scoring.entity_boost(F.transform(kept, lambda e: e["type"])), F.lit(0.0)),
        "entity_confidence": F.when(F.size(kept) > 0, F.aggregate(kept, F.lit(0.0), lambda a, e: a + e["score"]) / F.size(kept)),
        "cross_encoder_max": F.coalesce(best["score"], F.lit(0.0)), "ai_mitre_technique": F.coalesce(best["id"], F.lit("")),
    }
    neutral = {"is_duplicate": F.lit(False), "dedup_similarity": F.lit(0.0), "dedup_penalty": F.lit(0.0), "ai_entities": F.lit(""), "entity_boost": F.lit(0.0), "entity_confidence": F.lit(None).cast("double"), "cross_encoder_max": F.lit(0.0), "ai_mitre_technique": F.lit("")}
    rows = rows.withColumn("_failed", failed).withColumns({c: F.when(F.col("_failed"), neutral[c]).otherwise(v) for c, v in said.items()})
    return rows.withColumn("score_degraded", F.col("score_degraded") | F.col("_failed")).drop("candidates", "_new", "_entities", "_cross", "_failed")


def score_events(
    events: DataFrame, key: str, ts: str, m: Models, rules: DataFrame, techniques: DataFrame, vector: str = "embedding", seq: str | None = None, drifting: Column | None = None, novelty: dict | None = None, monitor: folds.Drift | None = None
) -> DataFrame:
    """Normalised events (raw, text, source_type, an embedding or null) with every signal, ai_threat_score, ai_priority and ai_confidence.

    seq: the order that novelty and the monitor go by, off without one; novelty: its windows. drifting: while it holds, no row goes to the second tier.
    monitor: drift is told from the scores that count, and while it is on the second tier's don't (``drift.fallback``).
    """
    known = events.where(F.col(vector).isNotNull())
    # Candidates first: a vector that nobody asks for afterwards needn't go through the joins.
    rows = similarity.with_candidates(events, techniques, vector).join(similarity.nearest_earlier(known, key, ts, vector), key, "left")
    if seq is not None:
        far = similarity.novelty(known, seq, vector, **(novelty or {}))
        rows = rows.join(far.select(seq, "novelty_score"), seq, "left").withColumn("novelty_score", F.coalesce("novelty_score", F.lit(0.0)))
    rows = first_tier(match_rules(rows, rules), m)
    if m.second is not None:
        rows = scoring.second_tier(rows, m.band, m.second, drifting, m.split) if monitor is None else with_fallback(rows, seq, m, monitor)
    rows = third_tier(rows, vector, techniques, m)
    return scoring.score(rows)
