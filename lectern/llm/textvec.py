"""Words of whole Arrow string columns as 64-bit hashes, without a Python object per word."""

from __future__ import annotations

import numpy as np
import pyarrow as pa

_BASE = np.uint64(0x9E3779B97F4A7C15)  # odd, so it has an inverse modulo 2**64
_UNBASE = np.uint64(pow(int(_BASE), -1, 2**64))
_SPACE = np.zeros(256, bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[ord("A") : ord("Z") + 1] += 32
_PLAIN = np.arange(256, dtype=np.uint8)


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser: every input bit reaches every output bit."""
    x = x ^ (x >> np.uint64(32))
    x = x * np.uint64(0xD6E8FEB86659FD93)
    x = x ^ (x >> np.uint64(32))
    x = x * np.uint64(0xD6E8FEB86659FD93)
    return x ^ (x >> np.uint64(32))


def _powers(base: np.uint64, n: int) -> np.ndarray:
    out = np.full(n, base, np.uint64)
    if n:
        out[0] = 1
    return np.multiply.accumulate(out)


class Powers:
    """Powers of the base and of its inverse, grown to the longest buffer seen."""

    def __init__(self) -> None:
        self.up = self.down = np.ones(0, np.uint64)

    def to(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        if len(self.up) < n:
            n = max(n, 1 << 16)
            self.up, self.down = _powers(_BASE, n), _powers(_UNBASE, n)
        return self.up, self.down


def text_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """All bytes of a string column and each row's bounds in them; null rows are empty."""
    column = column.cast(pa.large_string())
    if column.null_count:
        column = column.fill_null("")
    if len(column) == 0:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    _, bounds, data = column.buffers()
    bounds = np.frombuffer(bounds, np.int64)[column.offset : column.offset + len(column) + 1]
    data = np.frombuffer(data, np.uint8) if data else np.zeros(0, np.uint8)
    return data[bounds[0] : bounds[-1]], bounds - bounds[0]


def words(column: pa.Array, powers: Powers, lower: bool = True) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Hashes of all words in order, the row bounds among them, and each word's byte start and end."""
    data, bounds = text_bytes(column)
    n = len(data)
    if n == 0:
        none = np.zeros(0, np.int64)
        return np.zeros(0, np.uint64), np.zeros(len(bounds), np.int64), none, none
    solid = ~_SPACE[data]
    first = np.zeros(n + 1, bool)
    first[bounds] = True
    begins = solid.copy()
    begins[1:] &= ~solid[:-1] | first[1:n]
    ends = solid.copy()
    ends[:-1] &= ~solid[1:] | first[1:n]
    s, e = np.flatnonzero(begins), np.flatnonzero(ends) + 1
    up, down = powers.to(n)
    total = np.zeros(n + 1, np.uint64)
    np.cumsum(((_LOWER if lower else _PLAIN)[data].astype(np.uint64) + np.uint64(1)) * up[:n], out=total[1:])
    h = mix((total[e] - total[s]) * down[s] + (e - s).astype(np.uint64))
    return h, np.searchsorted(s, bounds), s, e


def shingles(h: np.ndarray, bounds: np.ndarray, k: int = 5) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of each row's ``k``-word windows (of the whole row where it has fewer words), and row bounds."""
    step = np.uint64(0xC2B2AE3D27D4EB4F)
    sizes = np.diff(bounds)
    counts = np.where(sizes >= k, sizes - k + 1, np.minimum(sizes, 1))
    out_bounds = np.concatenate([[0], np.cumsum(counts)])
    if len(h) == 0:
        return np.zeros(0, np.uint64), out_bounds
    whole = max(0, len(h) - k + 1)
    rolled = np.zeros(whole, np.uint64)
    for j in range(k):
        rolled = rolled * step + h[j : j + whole]
    row = np.repeat(np.arange(len(sizes)), counts)
    at = np.arange(out_bounds[-1]) - out_bounds[row] + bounds[row]
    out = np.zeros(len(at), np.uint64)
    long = sizes[row] >= k
    out[long] = rolled[at[long]] + np.uint64(k)
    for i in np.flatnonzero(~long):
        x = np.uint64(0)
        with np.errstate(over="ignore"):
            for y in h[bounds[row[i]] : bounds[row[i] + 1]]:
                x = x * step + y
            out[i] = x + np.uint64(sizes[row[i]])
    return mix(out), out_bounds
