"""Many literal patterns in texts at once: one automaton over all of them, gone through once for each text, however many there are.

The patterns of a task's automaton are broadcast, CHUNK of them at most; more make more automata, so no table is too large. Each worker builds
an automaton once and keeps it.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import cached_property

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sparkwarden.functions import constants as C

#: Patterns (of some 200 bytes) of one automaton.
CHUNK = 100_000
_SPACE = re.compile(r"[ \t\n\x0b\f\r]+")
_TOKEN = re.compile(C.FEATURE_TOKEN)


class Automaton:
    """Which of the patterns are in a text, and where each of them ends."""

    def __init__(self, patterns: list[str]):
        self.patterns = patterns

    def __getstate__(self):
        return {"patterns": self.patterns}  # what is built stays with its worker

    @cached_property
    def _built(self):
        import ahocorasick

        a = ahocorasick.Automaton()
        for i, p in enumerate(self.patterns):
            a.add_word(p, i)
        a.make_automaton()
        return a

    def ends(self, text: str) -> Iterator[tuple[int, int]]:
        """(number of the pattern, place of its last character) of each occurrence; empty patterns have none."""
        if self.patterns:
            for end, i in self._built.iter(text):
                yield i, end

    def inside(self, text: str) -> set[int]:
        return {i for i, _ in self.ends(text)}


def _strings(column: pa.Array) -> list[str | None]:
    return (column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column).to_pylist()


class Rules:
    """Values of rules (no, id, modifier, value): contains, startswith, endswith, or a word without the marks at its ends."""

    kind = pa.list_(pa.struct([("rule_no", pa.int32()), ("rule_id", pa.string())]))

    def __init__(self, values: list[tuple[int, str, str | None, str]]):
        by = {}
        for no, name, modifier, value in values:
            by.setdefault(value, []).append((no, name, modifier))
        self.of, self.automaton = list(by.values()), Automaton(list(by))

    def found(self, low: str | None) -> list[dict]:
        hits, words = set(), None
        for i, end in self.automaton.ends(low or ""):
            value = self.automaton.patterns[i]
            for no, name, modifier in self.of[i]:
                if (no, name) in hits:
                    continue
                if modifier is None and words is None:
                    words = {w.strip(C.WORD_EDGE) for w in _SPACE.split(low)}
                if {"contains": True, "startswith": end + 1 == len(value), "endswith": end + 1 == len(low)}.get(modifier, modifier is None and value in words):
                    hits.add((no, name))
        return [{"rule_no": no, "rule_id": name} for no, name in sorted(hits, key=lambda h: (h[0] is not None, h))]

    def run(self, column: pa.Array) -> pa.Array:
        return pa.array([self.found(t) for t in _strings(column)], self.kind)


class Labels:
    """Labels of patterns (pattern, label): those of the patterns in a text, each once."""

    kind = pa.list_(pa.string())

    def __init__(self, labelled: list[tuple[str, str]]):
        by = {}
        for pattern, label in labelled:
            by.setdefault(pattern, []).append(label)
        self.always, self.of, self.automaton = by.pop("", []), list(by.values()), Automaton(list(by))

    def run(self, column: pa.Array) -> pa.Array:
        found = []
        for t in _strings(column):
            found.append([] if t is None else list(dict.fromkeys([*self.always, *(x for i in sorted(self.automaton.inside(t)) for x in self.of[i])])))
        return pa.array(found, self.kind)


class Features:
    """0/1 of features (phrase, tokens): the phrase is in a text, or enough of its tokens are. A token of four characters or more may be part of a word; a shorter one is one."""

    kind = pa.list_(pa.float32())

    def __init__(self, prepared: list[tuple[str, list[str]]]):
        self.prepared = prepared
        phrases, words = {}, {}
        for k, (phrase, tokens) in enumerate(prepared):
            if phrase:
                phrases.setdefault(phrase, []).append(k)
            for w in tokens:
                words.setdefault(w, []).append(k)
        self.short = {w: ks for w, ks in words.items() if len(w) < 4}
        of = {p: (phrases.get(p, []), words.get(p, []) if len(p) >= 4 else []) for p in dict.fromkeys([*phrases, *(w for w in words if len(w) >= 4)])}
        self.of, self.automaton = list(of.values()), Automaton(list(of))

    def vector(self, low: str | None) -> list[float]:
        out, hits = [0.0] * len(self.prepared), {}
        if low is None:
            return out
        for i in self.automaton.inside(low):
            whole, parts = self.of[i]
            for k in whole:
                out[k] = 1.0
            for k in parts:
                hits[k] = hits.get(k, 0) + 1
        if self.short:
            for w in self.short.keys() & set(_TOKEN.findall(low)):
                for k in self.short[w]:
                    hits[k] = hits.get(k, 0) + 1
        for k, n in hits.items():
            of = len(self.prepared[k][1])
            if n / of >= (0.50 if of <= 3 else 0.65):
                out[k] = 1.0
        return out

    def run(self, column: pa.Array) -> pa.Array:
        return pa.array([self.vector(t) for t in _strings(column)], self.kind)


def found_by(finder: Rules | Labels | Features, low: Column, kind: str) -> Column:
    """What the finder says of each text; it goes along with the plan."""

    @F.arrow_udf(kind)
    def run(column: pa.Array) -> pa.Array:
        return finder.run(column)

    return run(low)


def shared(table: DataFrame, make, columns: list[str], chunk: int = CHUNK) -> list:
    """Broadcast finders, what make(rows) gives for each ``chunk`` rows of table at most."""
    rows = table.select(*columns)
    n = rows.count()
    if n <= chunk:
        pieces = [rows.collect()] if n else []
    else:
        dealt = rows.withColumn("_c", F.pmod(F.xxhash64(*columns), F.lit(-(-2 * n // chunk))))  # half full, as expected
        pieces = (dealt.where(F.col("_c") == k).drop("_c").collect() for k in range(-(-2 * n // chunk)))
    return [table.sparkSession.sparkContext.broadcast(make([tuple(r) for r in piece])) for piece in pieces]


def told(part, low: Column, kind: str) -> Column:
    """What a part's finder says of each text."""

    @F.arrow_udf(kind)
    def run(column: pa.Array) -> pa.Array:
        return part.value.run(column)

    return run(low)
