"""Hashed character n-grams of texts, in numpy."""

from __future__ import annotations

import unicodedata
from collections.abc import Iterator

import numpy as np

#: Texts are hashed in blocks of so many characters, so memory does not follow the longest text.
BLOCK = 1 << 20
_letters: np.ndarray | None = None


def letters() -> np.ndarray:
    """True for each code point that is a letter."""
    global _letters
    if _letters is None:
        _letters = np.fromiter((unicodedata.category(chr(c))[0] == "L" for c in range(0x110000)), bool, 0x110000)
    return _letters


def codes(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)


def word_codes(text: str) -> np.ndarray:
    """Lower-case code points with 0 for whatever is no letter, and a 0 at both ends."""
    c = codes(text.lower())
    out = np.zeros(len(c) + 2, np.uint32)
    out[1:-1] = np.where(letters()[c], c, 0)
    return out


def grams(c: np.ndarray, sizes: tuple[int, ...], bits: int, seed: int = 0, inside: bool = True) -> np.ndarray:
    """Buckets of the n-grams of ``c`` for each n of ``sizes``, one after the other.

    With ``inside``, an n-gram has no 0 but at its ends, and something else than 0.
    Each hash extends the one of the n-gram shorter by one.
    """
    out = []
    h = np.full(len(c), (seed * 0x85EBCA77 + 0x9E3779B1) & 0xFFFFFFFF, np.uint32)
    full = c != 0
    inner = np.ones(len(c), bool)  # no 0 between the first and the last
    for n in range(1, max(sizes) + 1):
        m = len(c) - n + 1
        if m <= 0:
            break
        h = (h[:m] ^ c[n - 1 :]) * np.uint32(0x2C1B3C6D)
        h ^= h >> np.uint32(15)
        if n > 2:
            inner = inner[:m] & full[n - 2 : n - 2 + m]
        if n in sizes:
            idx = (h * np.uint32(0x297A2D39)) >> np.uint32(32 - bits)
            if inside:
                idx = idx[full] if n == 1 else idx[full[:m] | full[1 : 1 + m]] if n == 2 else idx[inner[:m]]
            out.append(idx)
    return np.concatenate(out) if out else np.empty(0, np.uint32)


def text_blocks(text: str, overlap: int) -> Iterator[str]:
    for at in range(0, max(1, len(text) - overlap), BLOCK):
        yield text[at : at + BLOCK + overlap]
