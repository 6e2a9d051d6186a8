"""Sketches that are made once for each day and label, kept as columns of a table, and merged for any span: distinct counts and quantiles without the rows.

Errors are bounded by the sketches' sizes, whatever the number of rows: ``distinct_error`` and ``rank_error`` say by how much.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Binary logarithm of the registers of a distinct count, and the size of a quantile sketch.
REGISTERS, SIZE = 14, 400


def distinct_error(registers: int = REGISTERS, sigmas: float = 3.0) -> float:
    """The relative error that a distinct count keeps with the odds of so many standard deviations."""
    return sigmas * 1.04 / math.sqrt(2**registers)


def rank_error(size: int = SIZE) -> float:
    """The error of a quantile's rank, as a share of the rows, with odds of 99 %."""
    return 2.296 / size**0.9021


def daily(df: DataFrame, ts: str, labels: list[str], item: Column, value: Column, registers: int = REGISTERS, size: int = SIZE) -> DataFrame:
    """(day, labels, rows, items, values): a distinct-count sketch of item and a quantile sketch of value for each day and label. Nulls are in neither. Partial sketches are merged, so no key is hot."""
    rows = df.select(F.to_date(ts).alias("day"), *labels, item.alias("_item"), value.cast("double").alias("_value"))
    return rows.groupBy("day", *labels).agg(F.count("*").alias("rows"), F.hll_sketch_agg("_item", F.lit(registers)).alias("items"), F.kll_sketch_agg_double("_value", F.lit(size)).alias("values"))


def merged(sketches: DataFrame, by: list[str | Column]) -> DataFrame:
    """The sketches of each group as one, with the sum of their rows."""
    return sketches.groupBy(*by).agg(F.sum("rows").alias("rows"), F.hll_union_agg("items").alias("items"), F.kll_merge_agg_double("values").alias("values"))


def estimates(sketches: DataFrame, shares: list[float]) -> DataFrame:
    """sketches with n_distinct, n_values and quantiles (an array, in the order of shares; null without values), in place of the sketches."""
    n = F.kll_sketch_get_n_double("values")
    found = F.when(n > 0, F.kll_sketch_get_quantile_double("values", F.array(*[F.lit(float(s)) for s in shares])))
    return sketches.withColumns({"n_distinct": F.hll_sketch_estimate("items"), "n_values": n, "quantiles": found}).drop("items", "values")
