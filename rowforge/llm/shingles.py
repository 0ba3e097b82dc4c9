"""Sets of word shingles as sorted 64-bit hashes, and their circulant MinHash signatures.

Plain functions for Arrow tasks; they see one batch of documents at a time.
"""

from __future__ import annotations

from functools import lru_cache

import numpy as np
import xxhash

#: Odd multipliers that give each place in a shingle and in a band its own weight.
_ODD = np.random.Generator(np.random.PCG64(1)).integers(1, 2**63, 64, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def _mixed(h: np.ndarray) -> np.ndarray:
    """Spreads every bit of a 64-bit number over all of them, one to one."""
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def shingle_set(text: str | None, width: int = 5) -> np.ndarray:
    """Sorted distinct hashes of the shingles of ``width`` words.

    A-Z are lower-cased; a text of fewer words is one shingle; no words, no shingles.
    """
    # bytes: lower() and split() then know ASCII letters and ASCII white space only
    words = text.encode("utf-8", "surrogatepass").lower().split() if text else []
    if not words:
        return np.empty(0, np.uint64)
    of = xxhash.xxh3_64_intdigest
    hashes = np.fromiter((of(w) for w in words), np.uint64, len(words))
    size = min(width, len(words))
    n = len(words) - size + 1
    total = np.full(n, np.uint64(size))
    for k in range(size):
        total += hashes[k : k + n] * _ODD[k]
    return np.unique(_mixed(total))


def set_key(shingles: np.ndarray) -> tuple[int, int]:
    """128 bits that stand for a set."""
    raw = shingles.tobytes()
    return tuple(int(np.uint64(xxhash.xxh3_64_intdigest(raw, seed=s)).astype(np.int64)) for s in (1, 2))


@lru_cache(maxsize=2)
def _permutations(universe: int, coordinates: int, seed: int) -> tuple[np.ndarray, np.ndarray]:
    draw = np.random.Generator(np.random.PCG64(seed))
    first = draw.permutation(universe).astype(np.int32)
    second = draw.permutation(universe).astype(np.int32)
    circle = np.concatenate([second, second[:coordinates]])
    return first, np.lib.stride_tricks.sliding_window_view(circle, coordinates)


def signature(shingles: np.ndarray, coordinates: int, universe: int = 1 << 20, seed: int = 7) -> np.ndarray:
    """Circulant MinHash: the first permutation places the shingles on a circle, the second
    one is read from there on, once for every shift, so two permutations give all
    coordinates."""
    first, shifted = _permutations(universe, coordinates, seed)
    places = first[(shingles & np.uint64(universe - 1)).astype(np.int64)]
    least = np.full(coordinates, universe, np.int32)
    for at in range(0, len(places), 2048):  # bounds the memory of a long text
        np.minimum(least, shifted[places[at : at + 2048]].min(axis=0), out=least)
    return least


def band_keys(least: np.ndarray, bands: int, rows: int) -> np.ndarray:
    """One 64-bit key per band; equal coordinates of different bands give different keys."""
    by_band = least.reshape(bands, rows).astype(np.uint64)
    total = (by_band * _ODD[8 : 8 + rows]).sum(axis=1, dtype=np.uint64)
    return _mixed(total + np.arange(1, bands + 1, dtype=np.uint64) * _ODD[7]).astype(np.int64)


#: 64-bit words of a parity sketch.
SKETCH_WORDS = 16


def parity_sketch(shingles: np.ndarray) -> np.ndarray:
    """Which of 1,024 cells hold an odd number of a set's shingles, as 16 integers.

    Sketches of two sets differ in no more cells than there are shingles in one set only:
    what both have cancels out.
    """
    cells = np.bincount((shingles >> np.uint64(54)).astype(np.int64), minlength=64 * SKETCH_WORDS)
    return np.packbits((cells & 1).astype(np.uint8)).view(np.int64)
