"""String expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from sparkwarden.functions import constants as C

_SEP, _MARK = "\x01", "\x02\x01"


def strip(s: Column) -> Column:
    """Without white space of any kind at both ends."""
    return F.btrim(s, F.lit(C.WHITE_SPACE))


def groups(s: Column, pattern: str, n: int) -> Column:
    """The n groups of a pattern that spans the whole string, as an array, by one run of it; null without a match. A group that takes no part is empty."""
    joined = F.regexp_replace(s, pattern, _MARK + _SEP.join(f"${k}" for k in range(1, n + 1)))
    return let(joined, lambda j: F.when(j.startswith(_MARK) & ~s.startswith(_MARK), F.split(F.substring(j, F.lit(len(_MARK) + 1), F.length(j)), _SEP, n)))


def named(array: Column, names: list[str]) -> dict[str, Column]:
    return {name: array[k] for k, name in enumerate(names)}


def fields(values: dict[str, Column], keep) -> Column:
    """A map of the values that keep(value) holds for."""
    pairs = F.map_from_arrays(F.array(*[F.lit(k) for k in values]), F.array(*values.values()))
    return F.map_filter(pairs, lambda k, v: keep(v))


def or_else(*values: Column) -> Column:
    """The first that is neither null nor empty; the last as it is, but for null."""
    return F.coalesce(*[F.nullif(v, F.lit("")) for v in values[:-1]], values[-1])


def tokens(s: Column, pattern: str = C.FEATURE_TOKEN) -> Column:
    """Distinct tokens of the lower-cased string."""
    return F.array_distinct(F.regexp_extract_all(F.lower(s), F.lit(f"({pattern})"), F.lit(1)))


def sanitise(s: Column) -> Column:
    """Without what ends a field, an attribute or a line."""
    return F.regexp_replace(s, r"[|\t\r\n]", " ")


def has_word(s: Column, word: Column) -> Column:
    """Whether a word of s, without marks at its ends, is ``word`` in any case."""
    return F.exists(F.split(F.lower(s), r"\s+"), lambda w: F.btrim(w, F.lit(C.WORD_EDGE)) == word)


def ordered_distinct(*arrays: Column, sep: str = ",") -> Column:
    """Items of the arrays, the first of equal ones each, joined."""
    return F.array_join(F.array_distinct(F.concat(*arrays)), sep)


def valid_utf8(data: Column) -> Column:
    """Bytes as text, with the replacement character for what isn't UTF-8."""
    return F.make_valid_utf8(data.cast("string"))


def last_of_each(entries: Column) -> Column:
    """A map of key-value structs (k, v) in which later keys win. Keys are held against each other only where some repeat."""

    def last(held: Column, keys: Column) -> Column:
        return F.filter(held, lambda e, i: ~F.array_contains(F.slice(keys, i + 2, F.size(keys)), e["k"]))

    def kept(held: Column) -> Column:
        return let(F.transform(held, lambda e: e["k"]), lambda keys: F.when(F.size(F.array_distinct(keys)) == F.size(keys), held).otherwise(last(held, keys)))

    return F.map_from_entries(let(entries, kept))


def let(value: Column, body) -> Column:
    """body(value) with value worked out once, however often body names it."""
    return F.element_at(F.transform(F.array(value), body), 1)
