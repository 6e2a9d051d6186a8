"""Bag-of-event features of texts, shared by training and scoring."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sparkwarden.functions import constants as C
from sparkwarden.functions import patterns


def prepare(names: list[str], stopwords: list[str] | None = None) -> list[tuple[str, list[str]]]:
    """(phrase, tokens) of each feature: lower case, plus signs as spaces, tokens of three characters or more that aren't stopwords."""
    stop = set(C.FEATURE_STOPWORDS if stopwords is None else stopwords)
    out = []
    for name in names:
        phrase = name.lower().replace("+", " ")
        out.append((phrase, [t for t in re.findall(C.FEATURE_TOKEN, phrase) if len(t) > 2 and t not in stop]))
    return out


def feature_vector(text: Column, names: list[str], stopwords: list[str] | None = None) -> Column:
    """0/1 for each feature: its phrase is in the text, or enough of its tokens are. One automaton finds them all; a null text has none."""
    return patterns.found_by(patterns.Features(prepare(names, stopwords)), F.lower(text), "array<float>")


def bag_of_events(events: DataFrame, task: str, event: str) -> DataFrame:
    """Counts of events by task in long form (task_id, event_id, cnt)."""
    return events.groupBy(F.col(task).alias("task_id"), F.col(event).alias("event_id")).agg(F.count("*").alias("cnt"))


def wide(bag: DataFrame, event_ids: list[str]) -> DataFrame:
    """The long form as one column for each known event, missing ones 0."""
    return bag.groupBy("task_id").pivot("event_id", event_ids).agg(F.sum("cnt")).fillna(0, event_ids)


def feature_density(vectors: DataFrame, vector: str = "features") -> DataFrame:
    """One row: share of non-zero entries and mean number of active features."""
    active = F.size(F.filter(vector, lambda x: x != 0))
    return vectors.agg((F.sum(active) / F.sum(F.size(vector))).alias("nonzero_fraction"), F.avg(active).alias("mean_active"))
