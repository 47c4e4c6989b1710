"""Words of many texts at once, as 64-bit hashes, with numpy."""

from __future__ import annotations

import numpy as np
import pyarrow as pa

U = np.uint64
_RNG = np.random.Generator(np.random.PCG64(20240517))
POWERS = _RNG.integers(1, 1 << 63, 64, dtype=np.int64).astype(U) | U(1)


def flat(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """All bytes of the texts (no nulls), and where each text begins and ends."""
    texts = texts.cast(pa.large_string())
    n = len(texts)
    offsets = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + n + 1]
    data = texts.buffers()[2]
    b = np.frombuffer(data, np.uint8)[offsets[0] : offsets[-1]] if data is not None and offsets[-1] > offsets[0] else np.zeros(0, np.uint8)
    return b, offsets - offsets[0]


def lowered(b: np.ndarray) -> np.ndarray:
    """A-Z in lower case; other bytes stay."""
    b = b.copy()
    b[(b >= 65) & (b <= 90)] += 32
    return b


def runs(inside: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the runs of true bytes; no run crosses a bound."""
    near = np.concatenate([[False], inside, [False]])
    before, after = near[:-1].copy(), near[1:]
    before[bounds] = False
    after[bounds] = False
    return np.flatnonzero(inside > before[:-1]), np.flatnonzero(inside > after[1:]) + 1


TILE = 1 << 15
ROOT = 0x9E3779B97F4A7C15
with np.errstate(over="ignore"):
    RISING = np.cumprod(np.concatenate([[U(1)], np.full(TILE - 1, U(ROOT))]))
    FALLING = np.cumprod(np.concatenate([[U(1)], np.full(TILE - 1, U(pow(ROOT, -1, 1 << 64)))]))


def _mixed(h: np.ndarray) -> np.ndarray:
    h = h ^ (h >> U(31))
    h *= POWERS[7]
    h ^= h >> U(29)
    return h


def hashes(b: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each run of bytes: a polynomial in its bytes, from prefix sums over tiles."""
    if not len(starts):
        return np.zeros(0, U)
    out = np.empty(len(starts), U)
    tile = starts // TILE
    first = np.searchsorted(tile, np.arange(int(tile[-1]) + 2))
    for t in range(len(first) - 1):
        a, z = int(first[t]), int(first[t + 1])
        if a == z:
            continue
        base = t * TILE
        part = b[base : base + TILE].astype(U)
        part += U(1)
        part *= RISING[: len(part)]
        sums = np.zeros(len(part) + 1, U)
        np.cumsum(part, out=sums[1:])
        s, e = starts[a:z] - base, ends[a:z] - base
        out[a:z] = (sums[np.minimum(e, len(part))] - sums[s]) * FALLING[s]
        if e[-1] > len(part):  # it runs on into the next tiles
            h, power = 0, 1
            for v in b[starts[z - 1] : ends[z - 1]].tolist():
                h += (v + 1) * power
                power = power * ROOT & 0xFFFFFFFFFFFFFFFF
            out[z - 1] = U(h & 0xFFFFFFFFFFFFFFFF)
    return _mixed(out)
