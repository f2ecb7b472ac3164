"""Hashed character n-grams of whole texts."""

from __future__ import annotations

import numpy as np

_STEP = np.uint64(0x9E3779B185EBCA87)
_SPREAD = np.uint64(0xC2B2AE3D27D4EB4F)
#: Characters taken at a time; stretches overlap by the longest n-gram, so none is lost.
STRETCH = 1 << 20


def grams(text: str | None, orders: tuple[int, ...], bits: int) -> np.ndarray:
    """Bucket of every n-gram occurrence of the lower-cased text, with a blank at either end."""
    if not text:
        return np.empty(0, np.int64)
    cp = np.frombuffer(f" {text.lower()} ".encode("utf-32-le", "surrogatepass"), np.uint32)
    if len(cp) > STRETCH:
        parts = []
        for n in orders:
            parts += [_of(cp[max(0, at - n + 1) : at + STRETCH], (n,), bits) for at in range(0, len(cp), STRETCH)]
        return np.concatenate(parts)
    return _of(cp, orders, bits)


def _of(cp: np.ndarray, orders: tuple[int, ...], bits: int) -> np.ndarray:
    x = cp.astype(np.uint64) + np.uint64(1)
    h, out = x, []
    for n in range(1, max(orders) + 1):
        if n > 1:
            h = h[:-1] * _STEP + x[n - 1 :]
        if not len(h):
            break
        if n in orders:
            out.append((((h ^ (h >> np.uint64(29))) * _SPREAD + np.uint64(n * int(_STEP) % 2**64)) * _SPREAD) >> np.uint64(64 - bits))
    return np.concatenate(out).astype(np.int64) if out else np.empty(0, np.int64)
