"""Words of many texts at once, as arrays of hashes."""

from __future__ import annotations

import re

import numpy as np

_P = np.uint64(0x9E3779B97F4A7C15)
_M = np.uint64(0xFF51AFD7ED558CCD)
_POWERS = np.array([pow(int(_P), i, 1 << 64) for i in range(64)], np.uint64)
_WORD_BYTE = np.zeros(256, bool)
_WORD_BYTE[[*range(48, 58), *range(97, 123), 95, *range(128, 256)]] = True
_NO_WORD = re.compile(r"[^\w\s]")
#: Scripts written without spaces: each character is a word.
_UNSPACED = re.compile(r"([\u0e00-\u0eff\u1000-\u109f\u1780-\u17ff\u3040-\u30ff\u3400-\u4dbf\u4e00-\u9fff\uf900-\ufaff\U00020000-\U0003ffff])")


def plain(text: str) -> bytes:
    low = text.lower()
    if not low.isascii():
        low = _UNSPACED.sub(r" \1 ", _NO_WORD.sub(" ", low))
    return low.encode("utf-8", "replace")


def mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(32))) * _M
    return h ^ (h >> np.uint64(29))


def word_hashes(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the words (runs of letters and digits, lower case) of all texts one after the
    other, and where each text begins among them, with the end as last entry."""
    parts = [plain(t) for t in texts]
    buf = np.frombuffer(b" ".join([b"", *parts, b""]), np.uint8)
    begins = np.cumsum([1, *(len(p) + 1 for p in parts)])
    is_word = _WORD_BYTE[buf]
    edge = np.flatnonzero(is_word[1:] != is_word[:-1]) + 1
    starts, ends = edge[0::2], edge[1::2]
    if not len(starts):
        return np.empty(0, np.uint64), np.zeros(len(texts) + 1, np.int64)
    lengths = ends - starts
    positions = np.flatnonzero(is_word)
    within = positions - np.repeat(starts, lengths)
    values = (buf[positions].astype(np.uint64) + np.uint64(1)) * _POWERS[within & 63]
    sums = np.add.reduceat(values, np.concatenate(([0], np.cumsum(lengths)[:-1])))
    return mix(sums + lengths.astype(np.uint64)), np.searchsorted(starts, begins)


def shingles(words: np.ndarray, size: int) -> np.ndarray:
    """Hash of every run of ``size`` words; runs over the end of a text are the caller's to drop."""
    n = len(words) - size + 1
    if n <= 0:
        return np.empty(0, np.uint64)
    h = np.zeros(n, np.uint64)
    for k in range(size):
        h = h * _P + words[k : n + k]
    return mix(h)
