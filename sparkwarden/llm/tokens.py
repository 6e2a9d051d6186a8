"""Tokens of whole texts with the bytes that they stand for, for byte-level BPE (.json) and sentencepiece (.model) files.

A text longer than CUT is cut before a space that follows a visible ASCII character and comes before a letter, where neither kind of
tokenizer joins what stands on both sides: pieces' tokens add up to the text's.
"""

from __future__ import annotations

import json
import re

import numpy as np

CUT = 1 << 15
_SAFE = re.compile(r"(?<=[!-~]) (?=[A-Za-z])")
#: Texts that the ranks' library may take otherwise than the file's own: characters whose class depends on the version of Unicode, and very long words.
_OTHER = re.compile(r"[^\x00-ɏ]|\S{400}|\s{400}")
#: The words that byte-level BPE cuts texts into.
_WORDS = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


def byte_letters() -> dict[str, int]:
    """The character that stands for each byte in a byte-level vocabulary: itself if it is visible, else one from 256 on, in order."""
    visible = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in set(visible)]
    return {chr(b): b for b in visible} | {chr(256 + k): b for k, b in enumerate(rest)}


def _entries(spec: dict) -> list[bytes]:
    """The bytes of each id of a byte-level vocabulary."""
    letters = byte_letters()
    by_id = {i: t for t, i in spec["model"]["vocab"].items()}
    return [bytes(letters[c] for c in by_id.get(i, "")) for i in range(max(by_id) + 1)]


def ranks_of(spec: dict):
    """The vocabulary of a byte-level BPE file as ranks, whose library is several times faster; None unless each merge makes the id of its rank."""
    import tiktoken

    model = spec["model"]
    if model.get("type", "BPE") != "BPE" or model.get("dropout") or model.get("ignore_merges"):
        return None
    vocab, letters, special = model["vocab"], byte_letters(), {t["content"] for t in spec.get("added_tokens", [])}
    if any(c not in letters for t in vocab if t not in special for c in t):
        return None
    entries = _entries({"model": {"vocab": {t: i for t, i in vocab.items() if t not in special}}})
    merges = [m.split(" ") if isinstance(m, str) else m for m in model["merges"]]
    base = sum(len(e) == 1 for e in entries)
    if base != 256 or any(vocab.get(a + b) != base + k for k, (a, b) in enumerate(merges)):
        return None
    ranks = {entries[i]: i for t, i in vocab.items() if t not in special}
    return tiktoken.Encoding("own", pat_str=_WORDS, mergeable_ranks=ranks, special_tokens={}) if len(ranks) == base + len(merges) else None


def by_ranks(texts: list[str], ranks, own, special: list[str] = ()) -> list[list[int]]:
    """Ids of each text by its ranks, or by the file's own library (own) where the two may differ or one of the strings of special occurs."""
    other = [i for i, t in enumerate(texts) if _OTHER.search(t) or any(x in t for x in special)]
    out = [None] * len(texts)
    for i, ids in zip(other, own([texts[i] for i in other]) if other else [], strict=True):
        out[i] = ids
    return [ranks.encode_ordinary(t) if ids is None else ids for t, ids in zip(texts, out, strict=True)]


class Vocabulary:
    """One tokenizer: texts' ids, and the bytes of each id (entries end to end in table, id i from offset[i], size[i] of them)."""

    def __init__(self, path: str):
        self.adds_space = path.endswith(".model")  # a text's first space is its own doing
        if self.adds_space:
            import sentencepiece

            model = sentencepiece.SentencePieceProcessor(model_file=path)
            self._encode = lambda texts: model.encode(texts, num_threads=1)
            pieces = [model.id_to_piece(i) for i in range(model.get_piece_size())]
            entries = [bytes([int(p[3:5], 16)]) if model.is_byte(i) else p.replace("▁", " ").encode() for i, p in enumerate(pieces)]
            self.splits = not any(re.search("[^▁]▁", p) for p in pieces)
        else:
            from tokenizers import Tokenizer

            model = Tokenizer.from_file(path)
            model.no_truncation()
            model.no_padding()
            model.encode_special_tokens = True  # their strings in a text are text
            with open(path, encoding="utf-8") as f:
                spec = json.load(f)
            entries = _entries(spec)
            pre = spec.get("pre_tokenizer") or {}
            self.splits = spec.get("normalizer") is None and pre.get("type") == "ByteLevel" and pre.get("use_regex", True) and not pre.get("add_prefix_space", True)
            ranks = ranks_of(spec) if self.splits else None
            own = lambda texts: [x.ids for x in model.encode_batch_fast(texts, add_special_tokens=False)]
            self._encode = own if ranks is None else lambda texts: by_ranks(texts, ranks, own)
        self.size = np.array([len(e) for e in entries], np.int64)
        self.offset = np.concatenate(([0], np.cumsum(self.size)))[:-1]
        self.table = np.frombuffer(b"".join(entries), np.uint8)

    def encode(self, pieces: list[str]) -> list[list[int]]:
        """Ids of each piece, all of which begin with a space."""
        return self._encode([p[1:] for p in pieces] if self.adds_space else pieces)

    def spread(self, ids: np.ndarray) -> np.ndarray:
        """The bytes of the ids end to end."""
        size = self.size[ids]
        before = np.cumsum(size) - size
        return self.table[np.repeat(self.offset[ids] - before, size) + np.arange(int(size.sum()))]


def pieces(text: str) -> list[str]:
    """text cut at the first safe place after each CUT characters; each piece but the first begins with a space."""
    if len(text) <= CUT:
        return [text]
    out, start = [], 0
    while found := _SAFE.search(text, start + CUT):
        out.append(text[start : found.start()])
        start = found.start()
    return [*out, text[start:]]
