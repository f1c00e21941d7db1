"""A minimal perfect hash over distinct 128-bit keys: levels of bit arrays whose set bits are ranked.

At each level every remaining key hashes to a bit; bits hit once are set and their keys settled, the rest go to
the next level. A key's number is the rank of its bit among all set bits of all levels.
"""

from __future__ import annotations

import numpy as np

GAMMA = 1.7
LEVELS = 64


def spread(a: np.ndarray, b: np.ndarray, level: int) -> np.ndarray:
    """64 well-mixed bits of a key at a level."""
    with np.errstate(over="ignore"):
        x = a + (b | np.uint64(1)) * np.uint64(2 * level + 1)
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        return x ^ (x >> np.uint64(31))


def build(a: np.ndarray, b: np.ndarray) -> dict[str, np.ndarray]:
    """words (bit arrays of all levels), ranks (set bits before each word), sizes (bits of each level)."""
    words, sizes = [], []
    for level in range(LEVELS):
        if not len(a):
            break
        m = (int(len(a) * GAMMA) // 64 + 1) * 64
        at = spread(a, b, level) % np.uint64(m)
        hits = np.bincount(at.astype(np.int64), minlength=m)
        once = hits == 1
        words.append(np.packbits(once, bitorder="little").view("<u8"))
        sizes.append(m)
        left = ~once[at.astype(np.int64)]
        a, b = a[left], b[left]
    if len(a):
        raise ValueError("keys are not distinct")
    flat = np.concatenate(words) if words else np.zeros(0, "<u8")
    counts = np.bitwise_count(flat).astype(np.int64)
    return {"words": flat, "ranks": np.cumsum(counts) - counts, "sizes": np.array(sizes, np.int64)}


def find(h: dict[str, np.ndarray], a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Number of each key, -1 for some of the keys it wasn't built on; the others' numbers mean nothing."""
    out = np.full(len(a), -1, np.int64)
    rest, first = np.arange(len(a)), 0
    for level, m in enumerate(h["sizes"]):
        if not len(rest):
            break
        at = (spread(a[rest], b[rest], level) % np.uint64(m)).astype(np.int64) + first
        word, bit = h["words"][at >> 6], (at & 63).astype(np.uint64)
        on = (word >> bit & np.uint64(1)) == 1
        below = np.bitwise_count(word & ((np.uint64(1) << bit) - np.uint64(1))).astype(np.int64)
        out[rest[on]] = (h["ranks"][at >> 6] + below)[on]
        rest = rest[~on]
        first += int(m)
    return out
