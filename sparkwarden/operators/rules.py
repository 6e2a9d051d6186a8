"""Detection rules over texts: simplified Sigma items and signatures of attack tools."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sparkwarden.functions import constants as C
from sparkwarden.functions import patterns

_HITS = "array<struct<rule_no:int,rule_id:string>>"
RULE_SCHEMA = "rule_id string, rule_no int, field string, modifier string, value string"


def usable_values(rules: DataFrame) -> DataFrame:
    """Values of rules (RULE_SCHEMA; modifier contains, startswith, endswith, null for a word) that text can be held against.

    A wildcard's parts are joined by a space; values of other fields, with other modifiers or without text never match.
    """
    value = F.lower(F.btrim(F.array_join(F.filter(F.split("value", r"[*?]+"), lambda p: p != ""), " ")))
    return rules.withColumn("value", value).where(F.col("field").isin(*C.SIGMA_FIELDS) & (F.col("value") != "")).where("modifier is null or modifier in ('contains', 'startswith', 'endswith')")


def match_rules(events: DataFrame, rules: DataFrame, text: str = "text", chunk: int = patterns.CHUNK) -> DataFrame:
    """events with sigma_matched and sigma_rule_ids, in the order of rule_no; any one value of a rule is enough.

    An automaton over all values goes through each text once, and what it finds is held against the value's modifier, so time hardly
    grows with their number. Nothing is shuffled, no pairs of rows are made, and rows need no key. Null texts match nothing.
    """
    out = events.withColumn("_low", F.lower(F.col(text))).withColumn("_hits", F.array().cast(_HITS))
    for part in patterns.shared(usable_values(rules), patterns.Rules, ["rule_no", "rule_id", "modifier", "value"], chunk):
        out = out.withColumn("_hits", F.concat("_hits", patterns.told(part, F.col("_low"), _HITS)))
    ids = F.transform(F.array_distinct(F.array_sort("_hits")), lambda r: r["rule_id"])
    return out.withColumn("sigma_rule_ids", ids).drop("_low", "_hits").withColumn("sigma_matched", F.size("sigma_rule_ids") > 0)


def is_attack(raw: Column) -> Column:
    """Whether raw shows a known tool or category of attack, in any case."""
    return F.coalesce(raw.rlike("(?i)(?:" + "|".join(C.ATTACK_SIGNATURES) + ")"), F.lit(False))
