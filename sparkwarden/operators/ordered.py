"""Running sums over one order of all rows, without bringing the rows together, and small tables beside each row."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Rows of a range, as expected, and the fewest and most ranges that an order is cut into; their sums, a row for each, are what is ordered in one place.
RANGE_ROWS, LEAST, MOST = 50_000, 16, 10_000
#: Values that are drawn for each bound of an order that has no quantiles of its own.
DRAWN = 20
_BY_VALUE = ("tinyint", "smallint", "int", "bigint", "float", "double", "date", "timestamp", "timestamp_ntz")


def _bounds(df: DataFrame, order: str, kind: str, rows: int) -> list:
    """Values that cut the order into ranges of about as many rows each; the fewer the rows, the fewer."""
    wanted = lambda n: max(LEAST, min(MOST, -(-n // rows)))
    if kind.startswith("decimal") or kind in _BY_VALUE:
        shares = [k / 1024 for k in range(1, 1024)]
        n, found = df.agg(F.count("*"), F.percentile_approx(order, shares, 10_000)).first()
        step = max(1, 1024 // wanted(n))
        return sorted(set((found or [])[step - 1 :: step]))
    n = df.count()
    share = min(1.0, DRAWN * wanted(n) / max(1, n))
    drawn = sorted(r[0] for r in df.select(order).where(F.col(order).isNotNull()).sample(share, seed=7).collect())  # some DRAWN for each range
    return sorted(set(drawn[DRAWN::DRAWN]))


def range_of(df: DataFrame, order: str, rows: int = RANGE_ROWS) -> Column:
    """The range of ``order`` that a row is in, by bounds that hold about as many rows each: texts and other types as well as numbers and times.

    Bounds are fixed values, so every use of the column agrees. They are looked up in two steps, of some square root of their number each.
    """
    kind = dict(df.dtypes)[order]
    bounds = _bounds(df, order, kind, rows)
    if not bounds:
        return F.lit(0)
    step = math.isqrt(len(bounds) - 1) + 1
    parts = [bounds[i : i + step] for i in range(0, len(bounds), step)]
    lits = lambda values: F.array(*[F.lit(b).cast(kind) for b in values])
    below = lambda array: F.size(F.filter(array, lambda b: b <= F.col(order)))
    part = below(lits([p[0] for p in parts]))
    fine = F.array(*[lits(p) for p in parts])
    return F.when(part > 0, (part - 1) * step + below(F.get(fine, part - 1))).otherwise(0)


def running(df: DataFrame, order: str, sums: dict[str, Column], by: list[str] | None = None, where: Column | None = None, ties: list[str] | None = None) -> DataFrame:
    """df with each of sums over the rows before in the order, within ``by`` (nulls are a group); ties: columns that order equal ones.

    Rows are summed within ranges of the order, and ranges' totals are added up: no task holds more than a range.
    where: the range of each row, if it is known already (``range_of``).
    """
    by = by or []
    rows = df.withColumn("_range", range_of(df, order) if where is None else where)
    inner = Window.partitionBy(*by, "_range").orderBy(order, *(ties or [])).rowsBetween(Window.unboundedPreceding, -1)
    outer = Window.partitionBy(*by).orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    totals = rows.groupBy(*by, "_range").agg(*[F.sum(c).alias(f"_before_{name}") for name, c in sums.items()])
    zero = F.lit(0)
    totals = totals.select(*[F.col(c).alias(f"_of_{c}") for c in [*by, "_range"]], *[F.coalesce(F.sum(f"_before_{name}").over(outer), zero).alias(f"_before_{name}") for name in sums])
    rows = rows.withColumns({name: F.coalesce(F.sum(c).over(inner), zero) for name, c in sums.items()})
    same = [F.col(c).eqNullSafe(F.col(f"_of_{c}")) for c in by] + [F.col("_range") == F.col("_of__range")]
    joined = rows.join(totals, same)
    out = joined.withColumns({name: F.col(name) + F.col(f"_before_{name}") for name in sums})
    return out.drop("_range", *[f"_of_{c}" for c in [*by, "_range"]], *[f"_before_{name}" for name in sums])


def chunks(table: DataFrame, columns: list[Column], size: int) -> list[DataFrame]:
    """One-row frames of ``rows``, an array of at most ``size`` structs of the columns in their order each: a small table to go along with every row, in as many parts as it needs."""
    rows = table.select(F.struct(*columns).alias("r"))
    n = rows.count()
    if n <= size:
        return [rows.agg(F.array_sort(F.collect_list("r")).alias("rows"))]
    numbered = rows.withColumn("chunk", F.floor((F.row_number().over(Window.orderBy("r")) - 1) / size))
    return [numbered.where(F.col("chunk") == k).agg(F.array_sort(F.collect_list("r")).alias("rows")) for k in range(-(-n // size))]
