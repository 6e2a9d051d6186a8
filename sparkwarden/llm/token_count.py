"""Token counts of whole texts, without the tokens.

The library encodes batches of about BATCH_BYTES bytes, however many texts that is, and only lengths come back. Where a
.json file's vocabulary is one of ranks, plain texts take their counts from the ranks' library, which cuts and merges by the same
vocabulary in less than half the time; texts with a special string or with what the two may take otherwise (``tokens.by_ranks``) go to the file's own. A
text longer than CUT is split where the tokenizer can't join what stands on both sides, so that the
pieces' counts add up: for byte-level BPE before a space that follows a visible character and comes before an
ASCII letter. Texts that hold a special string, and those of tokenizers not known to split there, are given
whole. A memo of pieces was tried: it gained nothing where most words are rare.
"""

from __future__ import annotations

import json
import re

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sparkwarden.llm.session import parts
from sparkwarden.llm.tokens import by_ranks, ranks_of

BATCH_BYTES, CUT = 1 << 18, 1 << 15
_SAFE = re.compile(r"(?<=[!-~]) (?=[A-Za-z])")
_loaded: dict = {}


class Counter:
    """Counts for one tokenizer file, by the library that its suffix names."""

    def __init__(self, path: str):
        self.splits, self.special, self.ranks = False, [], None
        if path.endswith(".model"):
            import sentencepiece

            model = sentencepiece.SentencePieceProcessor(model_file=path)
            self.encode = lambda texts: [len(x) for x in model.encode(texts, num_threads=1)]
            return
        from tokenizers import Tokenizer

        model = Tokenizer.from_file(path)
        model.no_truncation()
        model.no_padding()
        own = lambda texts: [x.ids for x in model.encode_batch_fast(texts, add_special_tokens=False)]
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        pre, added = spec.get("pre_tokenizer") or {}, spec.get("added_tokens", [])
        self.special = [t["content"] for t in added]
        self.splits = spec.get("normalizer") is None and pre.get("type") == "ByteLevel" and pre.get("use_regex", True) and not pre.get("add_prefix_space", True)
        self.ranks = ranks_of(spec) if self.splits else None
        ids = own if self.ranks is None else lambda texts: by_ranks(texts, self.ranks, own, self.special)
        self.encode = lambda texts: [len(x) for x in ids(texts)]

    def pieces(self, text: str) -> list[str]:
        """text cut at the first safe place after each CUT characters; a text without such a place is one piece."""
        if len(text) <= CUT or not self.splits or any(x in text for x in self.special):
            return [text]
        out, start = [], 0
        while found := _SAFE.search(text, start + CUT):
            out.append(text[start : found.start()])
            start = found.start()
        return [*out, text[start:]]

    def count(self, texts: list[str], sizes: list[int] | None = None) -> list[int]:
        """Tokens of each text. sizes: their bytes, if known."""
        sizes = [len(t.encode()) for t in texts] if sizes is None else sizes
        out, held, size = [0] * len(texts), [], 0
        for i, text in enumerate(texts):
            cut = self.pieces(text)
            for piece in cut:
                held.append((i, piece))
                size += sizes[i] if len(cut) == 1 else len(piece.encode())
                if size >= BATCH_BYTES:
                    self._add(out, held)
                    held, size = [], 0
        self._add(out, held)
        return out

    def _add(self, out: list[int], held: list[tuple[int, str]]) -> None:
        for (i, _), n in zip(held, self.encode([x for _, x in held]) if held else [], strict=True):
            out[i] += n


def _run(path: str, limit: int):
    def run(batches):
        if path not in _loaded:
            _loaded[path] = Counter(path)
        for batch in parts(batches):
            texts = batch.column("text").fill_null("")
            sizes = pc.binary_length(texts)
            counts = _loaded[path].count(texts.to_pylist(), sizes.to_pylist())
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), sizes.cast(pa.int64()), pa.array(counts, pa.int64()), pa.array([n > limit for n in counts], pa.bool_())],
                ["doc_id", "n_bytes", "n_tokens", "over_limit"],
            )

    return run


def token_counts(docs: DataFrame, tokenizer: str, limit: int = 512) -> DataFrame:
    """(doc_id, n_bytes, n_tokens, over_limit) for each row of docs (doc_id, text), null text as empty.

    tokenizer: path of a .json (tokenizers) or .model (sentencepiece) file that every worker has. Special
    strings inside texts count as the library takes them by default; none are added. No
    truncation. Rows stay where they are read: there is no exchange. Each row counts for itself, also where ids or texts repeat; a
    text of any length is counted whole, an empty table gives no rows, and other columns are passed over.
    """
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return texts.mapInArrow(_run(tokenizer, limit), "doc_id long, n_bytes long, n_tokens long, over_limit boolean")
