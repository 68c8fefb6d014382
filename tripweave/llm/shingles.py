"""Words, shingles and signatures of one text, for use inside tasks."""

from __future__ import annotations

import numpy as np
import xxhash

#: Words whose hash a worker remembers, and the longest word it remembers.
REMEMBERED, LONGEST = 500_000, 64

_C = [np.uint64(c) for c in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9)]
_S = [np.uint64(s) for s in (31, 27, 33)]


def mix(h: np.ndarray) -> np.ndarray:
    """Spread the bits of 64-bit values (a bijection)."""
    h = (h ^ (h >> _S[0])) * _C[1]
    h = (h ^ (h >> _S[1])) * _C[2]
    return h ^ (h >> _S[2])


class WordHashes:
    """64-bit hashes of words; frequent ones come from a bounded memory."""

    def __init__(self):
        self.known: dict[bytes, int] = {}

    def __call__(self, words: list[bytes]) -> np.ndarray:
        known = self.known
        if len(known) > REMEMBERED:
            known.clear()
        try:
            return np.array([known[w] for w in words], dtype=np.uint64)
        except KeyError:
            pass
        out = np.empty(len(words), dtype=np.uint64)
        for i, w in enumerate(words):
            h = known.get(w)
            if h is None:
                h = xxhash.xxh3_64_intdigest(w)
                if len(w) <= LONGEST:
                    known[w] = h
            out[i] = h
        return out


def words_of(text: bytes | None) -> list[bytes]:
    """Words between ASCII white space."""
    return text.split() if text else []


def join_hashes(left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """Hash of two passages put together, from the hashes of both."""
    return mix(left * _C[0] + mix(right + _C[2]))


def windows(hashes: np.ndarray, size: int, made: dict[int, np.ndarray] | None = None) -> np.ndarray:
    """Hash of every run of ``size`` words, built by doubling: a run of 2n words from two
    of n, any other size from its largest power of two and the rest. ``made`` keeps the
    sizes on the way."""
    made = {} if made is None else made
    if size not in made:
        if size == 1:
            made[1] = hashes
        else:
            half = 1 << ((size - 1).bit_length() - 1)
            left, right = windows(hashes, half, made), windows(hashes, size - half, made)
            n = max(0, len(hashes) - size + 1)
            made[size] = join_hashes(left[:n], right[half : half + n])
    return made[size]


def shingle_set(hashes: np.ndarray, size: int) -> np.ndarray:
    """Sorted distinct hashes of all runs of ``size`` words; of the whole, if it is shorter."""
    if not len(hashes):
        return hashes
    return np.unique(windows(hashes, min(size, len(hashes))))


class Signer:
    """MinHash signatures: the least of ``a * x + b`` over a set, for each (a, b)."""

    def __init__(self, length: int, seed: int = 11):
        rng = np.random.default_rng(seed)
        self.a = (rng.integers(0, 2**31, length, dtype=np.uint32) * np.uint32(2) + np.uint32(1))[:, None]
        self.b = rng.integers(0, 2**32, length, dtype=np.uint32)[:, None]
        self.room = np.empty((length, 1024), dtype=np.uint32)

    def hashed(self, shingles: np.ndarray) -> np.ndarray:
        """length x shingles matrix (a view that the next call overwrites)."""
        x = (shingles >> np.uint64(32)).astype(np.uint32)
        out = self.room[:, : len(x)]
        np.multiply(self.a, x, out=out)
        out += self.b
        return out

    def __call__(self, shingles: np.ndarray) -> np.ndarray:
        step = self.room.shape[1]
        least = [self.hashed(shingles[i : i + step]).min(axis=1) for i in range(0, len(shingles), step)]
        return np.minimum.reduce(least)
