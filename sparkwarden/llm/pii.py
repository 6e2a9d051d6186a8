"""Personal data in whole texts: exact patterns, and a skip-chain conditional random field on top.

Patterns find e-mail addresses, IPv4 addresses, payment cards and phone numbers. The field labels the words that hold
a digit or an at-sign, those that a key such as ``password =`` is given, and words equal to these (LABELS; others are no nodes). Neighbours in the text share transition potentials;
words of a document that are alike (the same letters and digits, or the same six or more digits) are
joined by skip edges, which favour one label for all. Loopy message passing gives each node's marginals,
and words that a pattern missed are added where a label is certain.

The field is trained here, on labels that the patterns and assignments such as ``token = "..."`` give to
a bounded sample of rows. A document's alike words exchange messages through one sum for each
set of them, so work is in proportion to its words.
"""

from __future__ import annotations

import hashlib
import re
import zlib
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sparkwarden.llm import textkit as tk
from sparkwarden.llm.session import parts

KINDS = ["email", "ip", "card", "phone"]
LABELS = ["none", *KINDS, "secret"]
#: Bounds of the training: rows drawn (as expected, by a hash of id and text; rows that repeat both are one), and nodes and steps between nodes
#: taken of each (by a hash as well). All rows are labelled, whole. The marginal from which on a label counts.
SAMPLE, SAMPLE_WORDS, SURE = 20_000, 100, 0.9
#: Hashed features, rounds of messages at most, and the part of a message that stays from the round before, which keeps loops from swinging.
WIDTH, ROUNDS, KEEP = 4096, 12, 0.3

_DOMAIN = re.compile(r"[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++")
_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
# Runs of digits are taken whole and from their start: no suffix of a run can match where the run doesn't.
_IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
_CARD = re.compile(r"[0-9](?:[ -]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
_SECRET = re.compile(r"(?i)(?:token|secret|passw(?:or)?d|api[_-]?key|access[_-]?key)[\"']?\s{0,3}[=:]\s{0,3}[\"']?([A-Za-z0-9+/_.-]{16,})")
_KEY = r"(?i)token|secret|passwd|password|api[_-]?key|access[_-]?key"
_WORD = re.compile(r"\S+")
_EDGE = "\"'`.,;:!?#$%&*()[]{}<>|="
_NODE = np.zeros(256, bool)
_NODE[[*range(48, 58), 64]] = True


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        n = int(c) * (1 + i % 2)
        total += n - 9 if n > 9 else n
    return total % 10 == 0


def _emails(text: str):
    end, at = 0, text.find("@")
    while at >= 0:
        start = at
        while start > end and text[start - 1] in _LOCAL:
            start -= 1
        if start < at and (m := _DOMAIN.match(text, at + 1)):
            yield start, m.end()
            end = m.end()
        at = text.find("@", max(at + 1, end))


def base_spans(text: str) -> list[tuple[int, int, str]]:
    """(start, end, kind) of the patterns' matches, by start and then kind; code points."""
    found = [(s, 0, e) for s, e in _emails(text)]
    for m in _IP.finditer(text):
        if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or 0) <= 255 for p in m[0].split(".")):
            found.append((m.start(), 1, m.end()))
    for m in _CARD.finditer(text):
        digits = m[0].replace(" ", "").replace("-", "")
        if 14 <= len(digits) <= 19 and luhn(digits):
            found.append((m.start(), 2, m.end()))
    for m in _PHONE.finditer(text):
        if 10 <= sum(c.isdigit() for c in m[0]) <= 15:
            found.append((m.start(), 3, m.end()))
    return [(s, e, KINDS[k]) for s, k, e in sorted(found)]


@dataclass
class Nodes:
    """A document's nodes: their cores' places, the word's number, features and the key that alike ones share."""

    spans: list[tuple[int, int]]
    word: list[int]
    features: np.ndarray
    keys: list[str]


def _shape(word: str) -> str:
    return re.sub(r"(.)\1{2,}", r"\1\1", re.sub(r"[^\W\d_]", "a", re.sub(r"\d", "9", word[:48])))


def nodes(text: str) -> Nodes:
    spans, at, features, keys = [], [], [], []
    before = second = ""
    given = [m.span(1) for m in _SECRET.finditer(text)]
    secrets = {text[a:b].strip(_EDGE).lower() for a, b in given}
    j = 0
    for k, m in enumerate(_WORD.finditer(text)):
        word = m[0]
        while j < len(given) and given[j][1] <= m.start():
            j += 1
        asked = j < len(given) and given[j][0] < m.end()
        if asked or "@" in word or any(c.isdigit() and c.isascii() for c in word) or (secrets and word.strip(_EDGE).lower() in secrets):
            lead = len(word) - len(word.lstrip(_EDGE))
            core = word[lead:].rstrip(_EDGE)
            digits = "".join(c for c in core if c.isascii() and c.isdigit())
            letters = sum(c.isalpha() for c in core)
            names = [
                "shape=" + _shape(core), "digits=%d" % min(len(digits), 20), "letters=%d" % min(letters, 8), "dots=%d" % min(core.count("."), 5), "at=%d" % ("@" in core), "plus=%d" % core.startswith("+"),
                "open=" + word[:lead][-1:], "long=%d" % min(len(core) // 8, 6), "hex=%d" % bool(re.fullmatch(r"[0-9a-fA-F]{16,}", core)), "luhn=%d" % (14 <= len(digits) <= 19 and luhn(digits)),
                "before=" + _shape(before)[-12:] + ("=" if before[-1:] in "=:" else ""), "second=" + (second.lower()[-12:] if before in ("=", ":") else ""),
            ]
            if core:
                spans.append((m.start() + lead, m.start() + lead + len(core)))
                at.append(k)
                features.append([zlib.crc32(x.encode()) % WIDTH for x in names])
                keys.append(digits if len(digits) >= 6 and letters == 0 else core.lower())
        before, second = word, before
    return Nodes(spans, at, np.array(features, np.int64).reshape(len(spans), -1), keys)


def weak_labels(text: str, found: Nodes, base: list[tuple[int, int, str]]) -> np.ndarray:
    """A label for each node: of the pattern that covers most of its core, or secret, or none. Secrets that come again are such."""
    marks = [(s, e, LABELS.index(k)) for s, e, k in base] + [(m.start(1), m.end(1), LABELS.index("secret")) for m in _SECRET.finditer(text)]
    marks.sort()
    out, j = np.zeros(len(found.spans), np.int64), 0
    for i, (s, e) in enumerate(found.spans):
        while j < len(marks) and marks[j][1] <= s:
            j += 1
        if j < len(marks) and 2 * (min(e, marks[j][1]) - max(s, marks[j][0])) > e - s:
            out[i] = marks[j][2]
    secrets = {found.keys[i] for i in np.flatnonzero(out == LABELS.index("secret"))}
    out[[i for i, key in enumerate(found.keys) if key in secrets and not out[i]]] = LABELS.index("secret")
    return out


def _log_softmax(x: np.ndarray) -> np.ndarray:
    x = x - x.max(-1, keepdims=True)
    return x - np.log(np.exp(x).sum(-1, keepdims=True))


@dataclass
class Field:
    """unary: WIDTH x labels; chain: log potentials of neighbours' labels; skip: what two alike words gain by one label."""

    unary: np.ndarray
    chain: np.ndarray
    skip: float

    def marginals(self, found: Nodes, rounds: int = ROUNDS) -> np.ndarray:
        n, size = len(found.spans), self.unary.shape[1]
        own = self.unary[found.features].sum(1)
        key = {}
        group = np.array([key.setdefault(k, len(key)) for k in found.keys])
        others = np.bincount(group)[group] - 1
        left = np.flatnonzero(np.diff(found.word) == 1)  # nodes whose next word is a node
        forward, backward = np.zeros((n, size)), np.zeros((n, size))
        skips, last = np.zeros((n, size)), None
        for _ in range(rounds):
            belief = _log_softmax(own + forward + backward + skips)
            # What a word tells its likes is without what they told it, so nothing echoes; for pairs this is exact.
            sent = np.log1p((np.exp(self.skip) - 1) * np.exp(_log_softmax(own + forward + backward)))
            total = np.zeros((len(key), size))
            np.add.at(total, group, sent)
            # All messages of the others count in full.
            skips = KEEP * skips + (1 - KEEP) * np.where(others[:, None] > 0, total[group] - sent, 0.0)
            f, b = np.zeros((n, size)), np.zeros((n, size))
            if len(left):
                out = (belief - backward)[left][:, :, None] + self.chain[None]
                f[left + 1] = _log_softmax(np.logaddexp.reduce(out, 1))
                back = (belief - forward)[left + 1][:, None, :] + self.chain[None]
                b[left] = _log_softmax(np.logaddexp.reduce(back, 2))
            forward, backward = f, b
            if last is not None and np.abs(belief - last).max(initial=0) < 1e-3:
                break
            last = belief
        return np.exp(_log_softmax(own + forward + backward + skips))


def train(rows: list[tuple[list[int], int]], steps: list[tuple[int, int]], alike: tuple[int, int]) -> Field:
    """A field out of (features, label) rows, labels of neighbours, and how many alike pairs agree, of all."""
    size = len(LABELS)
    w = np.zeros((WIDTH, size))
    if rows:
        x, y = np.array([f for f, _ in rows]), np.eye(size)[[label for _, label in rows]]
        weight = 1 / np.sqrt(np.maximum(y.sum(0), 1))[y.argmax(1)]
        weight = (weight / weight.mean())[:, None]
        for k in range(120):
            g = weight * (np.exp(_log_softmax(w[x].sum(1))) - y)
            grad = np.stack([np.bincount(x.ravel(), np.repeat(g[:, c], x.shape[1]), WIDTH) for c in range(size)], 1)
            hits = np.bincount(x.ravel(), minlength=WIDTH)[:, None]
            w -= 0.4 * grad / (hits + 5) + 1e-4 * w
    counts = np.full((size, size), 1.0)
    for a, b in steps:
        counts[a, b] += 1
    joint = np.log(counts / counts.sum())
    chain = joint - np.log(counts.sum(1, keepdims=True) / counts.sum()) - np.log(counts.sum(0, keepdims=True) / counts.sum())
    same, pairs = alike
    return Field(w, np.clip(chain, -2, 2), float(np.clip(np.log((same + 1) / (pairs - same + 1)), 0.5, 3.0)))


def _may_hold(column: pa.Array) -> np.ndarray:
    """Which texts hold an ASCII digit, an at-sign or a key of secrets; no other can have a span."""
    out = pc.fill_null(pc.match_substring_regex(column, _KEY), False).to_numpy(zero_copy_only=False)
    for texts in tk.slices(column):
        sums = np.concatenate(([0], np.cumsum(_NODE[texts.data])))
        out[texts.first : texts.first + len(texts)] |= np.diff(sums[texts.bounds]) > 0
    return out


def _training_rows(batches):
    def some(items, name):
        return sorted(range(len(items)), key=lambda k: zlib.crc32(f"{k}:{name(k)}".encode()))[:SAMPLE_WORDS]

    for batch in parts(batches):
        out = []
        for i in np.flatnonzero(_may_hold(batch.column("text"))):
            text = batch.column("text")[int(i)].as_py()
            found = nodes(text)
            y = weak_labels(text, found, base_spans(text))
            steps = [(int(y[k]), int(y[k + 1])) for k in np.flatnonzero(np.diff(found.word) == 1)]
            last, same, pairs = {}, 0, 0
            for k, key in enumerate(found.keys):
                if key in last:
                    pairs, same = pairs + 1, same + int(y[last[key]] == y[k])
                last[key] = k
            chosen = some(y, lambda k, keys=found.keys: keys[k])
            out.append(([[*found.features[k].tolist(), int(y[k])] for k in chosen], [list(steps[k]) for k in some(steps, lambda k: "step")], same, pairs))
        yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in out], t) for i, t in enumerate((pa.list_(pa.list_(pa.int64())), pa.list_(pa.list_(pa.int64())), pa.int64(), pa.int64()))], ["rows", "steps", "same", "pairs"])


def fit(docs: DataFrame, sample: int = SAMPLE) -> Field:
    """Trains on rows drawn from docs (doc_id, text); without any, a field that adds next to nothing."""
    texts = docs.select(F.col("doc_id").cast("string").alias("doc_id"), F.col("text").cast("string").alias("text"))
    n = texts.count()
    if n > sample:
        texts = texts.where(F.pmod(F.xxhash64("doc_id", "text"), F.lit(1 << 40)) < F.lit(int((1 << 40) * sample / n))).dropDuplicates(["doc_id", "text"])
    got = texts.where("text is not null").select("text").mapInArrow(_training_rows, "rows array<array<bigint>>, steps array<array<bigint>>, same long, pairs long").collect()
    rows = sorted((tuple(r[:-1]), r[-1]) for g in got for r in g["rows"])
    return train([(list(f), y) for f, y in rows], [tuple(s) for g in got for s in g["steps"]], (sum(g["same"] for g in got), sum(g["pairs"] for g in got)))


def all_spans(text: str, field: Field, sure: float = SURE) -> tuple[list[tuple[int, int, str]], list[tuple[int, int, str]]]:
    """The patterns' spans, and these with what the field adds; by start, then kind."""
    base = base_spans(text)
    found = nodes(text)
    more: list[tuple[int, int, str]] = []
    if found.spans:
        p = field.marginals(found)
        best, k = p.argmax(1), 0
        for i, (s, e) in enumerate(found.spans):
            if not best[i] or p[i, best[i]] < sure:
                continue
            while k < len(base) and base[k][1] <= s:
                k += 1
            if any(b[0] < e and b[1] > s for b in base[k : k + len(LABELS)]):
                continue
            kind = LABELS[best[i]]
            if more and more[-1][2] == kind and kind in ("phone", "card") and text[more[-1][1] : s].strip("() -.") == "" and s - more[-1][1] <= 3:
                more[-1] = (more[-1][0], e, kind)
            else:
                more.append((s, e, kind))
    return base, sorted(base + more, key=lambda x: (x[0], LABELS.index(x[2]), x[1]))


def _join(spans) -> str:
    return ",".join(f"{k}:{s}:{e}" for s, e, k in spans)


def _find(shared, redact: bool):
    def run(batches):
        field = shared.value
        nothing = hashlib.sha256(b"").hexdigest()
        for batch in parts(batches):
            some = _may_hold(batch.column("text"))
            n = batch.num_rows
            counts, shas, joined, masked = np.zeros((4, n), np.int64), [nothing] * n, [""] * n, {}
            for i in np.flatnonzero(some):
                text = batch.column("text")[int(i)].as_py()
                base, spans = all_spans(text, field)
                for _, _, kind in base:
                    counts[KINDS.index(kind), i] += 1
                shas[i], joined[i] = hashlib.sha256(_join(base).encode()).hexdigest(), _join(spans)
                if redact:
                    masked[int(i)] = mask(text, spans)
            if redact:
                texts = pa.array([masked.get(i, t) for i, t in enumerate(batch.column("text").to_pylist())], pa.string()) if masked else batch.column("text")
                yield pa.RecordBatch.from_arrays([texts if c == "text" else batch.column(c) for c in batch.schema.names], batch.schema.names)
            else:
                yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *map(pa.array, counts), pa.array(shas), pa.array(joined)], ["doc_id", *("n_" + k for k in KINDS), "base_sha256", "spans"])

    return run


def mask(text: str, spans: list[tuple[int, int, str]]) -> str:
    """text with each span, or run of spans that overlap, as <KIND> of its first."""
    out, end = [], 0
    for s, e, kind in spans:
        if s >= end:
            out += [text[end:s], f"<{kind.upper()}>"]
        end = max(end, e)
    return "".join([*out, text[end:]])


def find_pii(docs: DataFrame, field: Field | None = None) -> DataFrame:
    """(doc_id, n_email, n_ip, n_card, n_phone, base_sha256, spans) for each row of docs (doc_id, text); null text as empty.

    The counts and base_sha256 are of the patterns' spans, spans is of all: ``kind:start:end`` joined by commas. Texts of any
    length are labelled whole; rows that repeat each get their text's result; an empty table gives no rows; other columns are passed over.
    """
    spark = docs.sparkSession
    shared = spark.sparkContext.broadcast(field or fit(docs))
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return texts.mapInArrow(_find(shared, False), "doc_id long, n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, spans string")


def redact_pii(docs: DataFrame, field: Field | None = None) -> DataFrame:
    """docs with all spans of its text column masked; other columns, rows that repeat, null texts and those without spans stay as they are. Texts of any length are masked whole."""
    spark = docs.sparkSession
    shared = spark.sparkContext.broadcast(field or fit(docs))
    return docs.mapInArrow(_find(shared, True), docs.schema)
