"""Byte n-gram profiles of whole texts, hashed to a fixed width."""

from __future__ import annotations

import numpy as np

from sparkwarden.llm import textkit as tk

WIDTH = 1 << 13
#: Letters and what lies beyond ASCII stay, lower-cased; all else is one gap.
_FOLD = np.full(256, 32, np.uint8)
_FOLD[97:123] = np.arange(97, 123)
_FOLD[65:91] = np.arange(97, 123)
_FOLD[128:] = np.arange(128, 256)


def profiles(texts: tk.Texts, width: int = WIDTH) -> np.ndarray:
    """A row of ``width`` for each text: square roots of the shares of its 1- to 3-grams, of length 1.

    Square roots keep one word that repeats from hiding the rest. A text without letters is all zero.
    """
    n = len(texts)
    if n > 256:  # the counts take width numbers for each text
        cut = texts.bounds[256]
        head = tk.Texts(texts.data[:cut], texts.bounds[:257], 0)
        return np.concatenate([profiles(head, width), profiles(tk.Texts(texts.data[cut:], texts.bounds[256:] - cut, 0), width)])
    data = _FOLD[texts.data].astype(np.uint32)
    of = np.repeat(np.arange(n), np.diff(texts.bounds))
    out = np.zeros((n, width), np.float32)
    letters = data != 32
    for size in (1, 2, 3):
        m = len(data) - size + 1
        if m <= 0:
            break
        h = data[:m].copy()
        some = letters[:m].copy()
        for j in range(1, size):
            h = h * np.uint32(257) + data[j : j + m]
            some |= letters[j : j + m]
        h = ((h * np.uint32(2654435761) + np.uint32(size * 977)) >> np.uint32(19)).astype(np.int64) & (width - 1)
        some &= of[:m] == of[size - 1 :]
        out += np.bincount(of[:m][some] * width + h[some], minlength=n * width).reshape(n, width)
    np.sqrt(out, out)
    norm = np.sqrt((out * out).sum(1, keepdims=True))
    return np.divide(out, norm, out=out, where=norm > 0)
