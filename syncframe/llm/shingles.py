"""Hashes of words and of five-word shingles, worked out on whole batches of texts."""

from __future__ import annotations

import hashlib

import numpy as np

from syncframe.llm.arrow import joined, runs

WIDTH = 5
_random = np.random.default_rng(20240501)
#: A random value for each byte; white space adds nothing, capitals of A-Z count as small letters.
_BYTE = _random.integers(1, 2**63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_SPACES = np.zeros(256, bool)
_SPACES[[0x20, *range(0x09, 0x0E)]] = True
_BYTE[_SPACES] = 0
_BYTE[ord("A") : ord("Z") + 1] = _BYTE[ord("a") : ord("z") + 1]
_STEP = np.uint64(0x9E3779B97F4A7C15)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit values that spreads every bit."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def word_hashes(data: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """A 64-bit hash of each word of the joined texts, and where each text's words begin (the end last)."""
    inside = ~_SPACES[data]
    first = inside.copy()
    first[1:] &= ~inside[:-1]
    begins = bounds[:-1][bounds[:-1] < len(data)]
    first[begins] = inside[begins]
    starts = np.flatnonzero(first)
    counts = np.searchsorted(starts, bounds)
    if not len(starts):
        return np.zeros(0, np.uint64), counts
    lengths = np.diff(starts, append=len(data))
    place = np.arange(len(data) - starts[0]) - np.repeat(starts - starts[0], lengths)
    powers = np.cumprod(np.full(int(lengths.max()), _STEP, np.uint64))
    sums = np.add.reduceat(_BYTE[data[starts[0] :]] * powers[place], starts - starts[0])
    return mix(sums), counts


def shingle_sets(texts: list[bytes]) -> list[np.ndarray]:
    """For each text the sorted distinct hashes of its five-word shingles; a shorter text with words has one
    for its whole sequence, a text without words none."""
    sets = []
    for begin, end in runs(texts):
        words, at = word_hashes(*joined(texts[begin:end]))
        if len(words) >= WIDTH:
            folded = words[: len(words) - WIDTH + 1]
            for k in range(1, WIDTH):
                folded = mix(folded + _STEP) + words[k : len(words) - WIDTH + 1 + k]
            folded = mix(folded)
        for i in range(end - begin):
            n = at[i + 1] - at[i]
            if n >= WIDTH:
                own = np.sort(folded[at[i] : at[i + 1] - WIDTH + 1])
                sets.append(own[np.append(True, own[1:] != own[:-1])])
            elif n:
                whole = np.full(1, n, np.uint64)
                for k in range(at[i], at[i + 1]):
                    whole = mix(whole + _STEP) + words[k]
                sets.append(mix(whole))
            else:
                sets.append(np.zeros(0, np.uint64))
    return sets


def set_key(hashes: np.ndarray) -> tuple[int, int]:
    """128 bits that stand for a set."""
    a, b = np.frombuffer(hashlib.blake2b(hashes.tobytes(), digest_size=16).digest(), np.int64)
    return int(a), int(b)
