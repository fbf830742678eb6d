"""Words and word shingles of many texts at once, as 64-bit hashes in numpy arrays."""

from __future__ import annotations

import numpy as np

U = np.uint64
_IS_SPACE = np.zeros(256, bool)
_IS_SPACE[[32, *range(9, 14)]] = True


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective scrambling of 64-bit integers."""
    x = (x ^ (x >> U(30))) * U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> U(27))) * U(0x94D049BB133111EB)
    return x ^ (x >> U(31))


def keys(n: int, seed: int) -> np.ndarray:
    """n fixed random 64-bit integers."""
    return mix((np.arange(1, n + 1, dtype=U) + U(seed * 0x632BE59BD9B4E019 % 2**64)) * U(0x9E3779B97F4A7C15))


def word_hashes(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """(hash of each word of all texts, end of each text in that array).

    Words are runs of bytes other than ASCII white space. A word's hash is the scrambled sum of
    its bytes times a random key for each place.
    """
    raw = np.frombuffer(b" ".join(texts) + b" ", np.uint8)
    space = _IS_SPACE[raw]
    start = np.flatnonzero(~space & np.concatenate([[True], space[:-1]]))
    ends = np.cumsum([len(t) + 1 for t in texts])
    if not len(start):
        return np.zeros(0, U), np.zeros(len(texts), np.int64)
    place = np.arange(len(raw)) - np.repeat(np.concatenate([[0], start]), np.diff(np.concatenate([[0], start, [len(raw)]])))
    place[space] = 0
    longest = int(place.max()) + 1
    value = (raw.astype(U) + U(1)) * keys(longest, 1)[place]
    value[space] = 0
    return mix(np.add.reduceat(value, start)), np.searchsorted(start, ends)


def shingle_sets(texts: list[bytes], size: int) -> list[np.ndarray]:
    """Each text's sorted distinct shingles of ``size`` words; with fewer words, all of them as
    one shingle; without words, none."""
    word, ends = word_hashes(texts)
    key = keys(size, 2)
    n = max(0, len(word) - size + 1)
    shingle = np.zeros(n, U)
    for i in range(size):
        shingle += word[i : i + n] * key[i]
    shingle = mix(shingle)
    out, a = [], 0
    for b in ends.tolist():
        if b - a >= size:
            out.append(np.unique(shingle[a : b - size + 1]))
        elif b > a:
            few = (word[a:b] * key[: b - a]).sum(keepdims=True)
            out.append(mix(few + keys(b - a, 3)[-1:]))
        else:
            out.append(np.zeros(0, U))
        a = b
    return out
