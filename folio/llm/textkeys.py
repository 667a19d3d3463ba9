"""Rolling hashes and winnowing over sequences, vectorised; shared by the span and leakage operators."""

from __future__ import annotations

import numpy as np

BASE = 0x9E3779B97F4A7C15 | 1
INVERSE = pow(BASE, -1, 1 << 64)


def powers(base: int, n: int) -> np.ndarray:
    """base**0 .. base**(n-1) modulo 2**64."""
    out = np.full(n, base, np.uint64)
    if n:
        out[0] = 1
        np.multiply.accumulate(out, out=out)
    return out


class Powers:
    """Power tables that grow on demand."""

    def __init__(self):
        self.up = self.down = np.empty(0, np.uint64)

    def get(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        if len(self.up) < n:
            m = max(n, 2 * len(self.up), 4096)
            self.up, self.down = powers(BASE, m), powers(INVERSE, m)
        return self.up[:n], self.down[:n]


_POWERS = Powers()


def mix(h: np.ndarray) -> np.ndarray:
    """Finaliser that spreads a 64-bit hash over all bits."""
    h = (h ^ (h >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def codes(text: str) -> np.ndarray:
    """Code points of a text."""
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)


def grams(values: np.ndarray, k: int) -> np.ndarray:
    """Hash of every run of k consecutive values (empty if there are fewer)."""
    n = len(values)
    if n < k:
        return np.empty(0, np.uint64)
    up, down = _POWERS.get(n)
    total = np.concatenate([np.zeros(1, np.uint64), np.cumsum((values.astype(np.uint64) + np.uint64(1)) * up)])
    return mix((total[k:] - total[:-k]) * down[: n - k + 1])


_LOW = np.uint64((1 << 24) - 1)


def window_picks(h: np.ndarray, w: int) -> np.ndarray:
    """For every window of w hashes, the position of its least hash, the rightmost of equals (n >= w)."""
    n = len(h)
    pos = np.arange(n, dtype=np.uint64)
    key = (h & ~_LOW) | (_LOW - (pos & _LOW))
    # prefix and suffix minima of blocks of w give every window's minimum in three passes
    pad = (-n) % w
    x = np.concatenate([key, np.full(pad, np.iinfo(np.uint64).max, np.uint64)]).reshape(-1, w)
    pre = np.minimum.accumulate(x, axis=1).ravel()
    suf = np.minimum.accumulate(x[:, ::-1], axis=1)[:, ::-1].ravel()
    low = np.minimum(suf[: n - w + 1], pre[w - 1 : n])
    first = pos[: n - w + 1]
    return (first + (((_LOW - (low & _LOW)) - first) & _LOW)).astype(np.int64)


def winnow(h: np.ndarray, w: int) -> np.ndarray:
    """Positions picked by winnowing (of the whole, if there are fewer than w hashes).

    Two sequences that share w + k - 1 consecutive values share the hash of at least one picked k-gram there.
    """
    if not len(h):
        return np.empty(0, np.int64)
    return np.unique(window_picks(h, min(w, len(h))))
