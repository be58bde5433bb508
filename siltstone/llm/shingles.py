"""Word shingles of whole texts, hashed over whole Arrow batches at once."""

from __future__ import annotations

import numpy as np

from .common import SPACES, U64, mix64

_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_IS_SPACE = np.zeros(256, bool)
_IS_SPACE[list(SPACES)] = True
_SYMBOL = mix64(np.arange(1, 257, dtype=np.uint64) * U64(0x9E3779B97F4A7C15))
_BASE = 0x9E3779B97F4A7C15 | 1
_POWERS: dict[str, np.ndarray] = {}
_PLACES = mix64(np.arange(11, 27, dtype=np.uint64)) | U64(1)


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """The first n powers of the hash base and of its inverse, modulo 2**64."""
    if len(_POWERS.get("up", ())) < n:
        size = 1 << max(18, int(n).bit_length())
        with np.errstate(over="ignore"):
            for name, b in (("up", _BASE), ("down", pow(_BASE, -1, 1 << 64))):
                out = np.empty(size, np.uint64)
                out[0] = 1
                k, step = 1, b
                while k < size:
                    out[k : 2 * k] = out[:k] * U64(step)
                    step = step * step % (1 << 64)
                    k *= 2
                _POWERS[name] = out
    return _POWERS["up"], _POWERS["down"]


def word_hashes(data: np.ndarray) -> np.ndarray:
    """Hashes of the words of one text: lower-cased A-Z, split at ASCII white space."""
    n = len(data)
    if not n:
        return np.zeros(0, np.uint64)
    space = _IS_SPACE[data]
    edge = np.flatnonzero(np.diff(space.view(np.int8), prepend=1, append=1))
    start, end = edge[::2], edge[1::2]
    if not len(start):
        return np.zeros(0, np.uint64)
    up, down = powers(n + 1)
    total = np.zeros(n + 1, np.uint64)
    np.cumsum(_SYMBOL[_LOWER[data]] * up[:n], out=total[1:])
    return mix64((total[end] - total[start]) * down[start] + (end - start).astype(np.uint64))


def shingle_set(data: np.ndarray, width: int) -> np.ndarray:
    """Sorted distinct hashes of the `width`-word shingles; with fewer words, of the whole sequence."""
    w = word_hashes(data)
    if not len(w):
        return w
    k = min(width, len(w))
    h = w[: len(w) - k + 1] * _PLACES[0]
    for i in range(1, k):
        h = h + w[i : len(w) - k + 1 + i] * _PLACES[i]
    h = mix64(h + U64(k if k < width else 0))
    h.sort()
    return h[np.concatenate(([True], h[1:] != h[:-1]))]
