"""Hashes of words, word sequences and shingles; powers for rolling hashes."""

from __future__ import annotations

import hashlib
from functools import lru_cache

import numpy as np
import xxhash

from .common import CACHES

SIZE = 5
BASE = 0x9E3779B97F4A7C15 | 1
INVERSE = pow(BASE, -1, 1 << 64)
#: Powers that stay in memory.
KEPT = 1 << 20
#: Words whose hashes stay in memory.
WORDS = 1 << 19


def powers(base: int, n: int) -> np.ndarray:
    """base ** 0 .. base ** (n - 1), modulo 2 ** 64; the usual length is kept, longer ones are made anew."""
    return _powers(base, KEPT)[:n] if n <= KEPT else _made(base, n)


@lru_cache(maxsize=4)
def _powers(base: int, n: int) -> np.ndarray:
    return _made(base, n)


def _made(base: int, n: int) -> np.ndarray:
    out = np.full(n, np.uint64(base), np.uint64)
    out[0] = 1
    return np.multiply.accumulate(out)


def mixed(x: np.ndarray) -> np.ndarray:
    x = x ^ (x >> np.uint64(32))
    x = x * np.uint64(0xD6E8FEB86659FD93)
    x = x ^ (x >> np.uint64(32))
    x = x * np.uint64(0xD6E8FEB86659FD93)
    return x ^ (x >> np.uint64(32))


class _Words(dict):
    """word -> 64-bit hash, made when it is asked for."""

    def __missing__(self, word: bytes) -> int:
        self[word] = h = xxhash.xxh3_64_intdigest(word)
        return h


_KNOWN = _Words()
CACHES["words"] = _KNOWN.clear


def words_of(text: str | None) -> list[bytes]:
    """The words (runs of bytes outside 0x20, 0x09-0x0D), in order."""
    return (text or "").encode("utf-8", "surrogatepass").split()


def word_hashes(words: list[bytes]) -> np.ndarray:
    if len(_KNOWN) > WORDS:
        _KNOWN.clear()
    return np.fromiter(map(_KNOWN.__getitem__, words), np.uint64, len(words))


def digest(words: list[bytes]) -> bytes:
    """A 128-bit digest of the word sequence (cryptographic: different sequences do not share one)."""
    return hashlib.blake2b(b" ".join(words), digest_size=16).digest()


def shingled(w: np.ndarray) -> np.ndarray:
    """Shingle hashes of a text's word hashes; fewer than SIZE words make one shingle, none makes none."""
    n = len(w)
    if n == 0:
        return w
    size = min(n, SIZE)
    h = np.full(n - size + 1, np.uint64(size), np.uint64)
    for k in range(size):
        h = mixed(h * np.uint64(BASE) + w[k : n - size + 1 + k])
    return h
