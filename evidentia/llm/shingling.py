"""Words of UTF-8 buffers and their fingerprints, in numpy over whole batches.

A word's fingerprint is a sum over its bytes of random numbers for byte and
place, mixed; two of them with different numbers make 128 bits.
"""

from __future__ import annotations

import numpy as np

_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_PLACES = 4096
U = np.uint64


def _randoms(seed: int, n: int) -> np.ndarray:
    return np.random.PCG64(seed).random_raw(n).astype(np.uint64)


_BYTE = [_randoms(s, 256) for s in (11, 12)]
_PLACE = [_randoms(s, _PLACES) | U(1) for s in (13, 14)]
_FAR = [_randoms(s, 1)[0] | U(1) for s in (15, 16)]
_STEP = [_randoms(s, 1)[0] | U(1) for s in (17, 18)]


def mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> U(32))) * U(0xD6E8FEB86659FD93)
    h = (h ^ (h >> U(29))) * U(0xA0761D6478BD642F)
    return h ^ (h >> U(32))


def lower(data: np.ndarray) -> np.ndarray:
    """A-Z as a-z; other bytes as they are."""
    return _LOWER[data]


def word_bounds(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """First byte and end of each word, and the rows' offsets among the words."""
    inside = np.append(~_SPACE[data], False)
    before = np.append(False, inside[:-1])
    edges = offsets[(offsets > 0) & (offsets < len(data))]
    starts_here = inside & ~before
    starts_here[edges] = inside[edges]
    ends_here = before & ~inside
    ends_here[edges] = before[edges]
    starts, ends = np.flatnonzero(starts_here), np.flatnonzero(ends_here)
    return starts, ends, np.searchsorted(starts, offsets)


def word_fingerprints(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, which: int) -> np.ndarray:
    if not len(starts):
        return np.zeros(0, np.uint64)
    lengths = ends - starts
    begin = np.cumsum(lengths) - lengths
    place = np.arange(int(lengths.sum()), dtype=np.int32)
    place -= np.repeat(begin.astype(np.int32), lengths)
    letters = _BYTE[which][data[~_SPACE[data]]]
    if lengths.max() > _PLACES:
        far = np.cumprod(np.append(U(1), np.full(int(lengths.max()) // _PLACES, _FAR[which])), dtype=np.uint64)
        letters *= far[place // _PLACES]
        place %= _PLACES
    letters *= _PLACE[which][place]
    return mix(np.add.reduceat(letters, begin) + lengths.astype(np.uint64) * _STEP[which])


def runs(words: np.ndarray, n: int, which: int) -> np.ndarray:
    """A fingerprint of every n consecutive words; also of those that cross rows, which callers leave out."""
    if len(words) < n:
        return np.zeros(0, np.uint64)
    out = words[: len(words) - n + 1].copy()
    for j in range(1, n):
        out *= _STEP[which]
        out += words[j : len(words) - n + 1 + j]
    return mix(out)


def within_rows(word_offsets: np.ndarray, n: int) -> np.ndarray:
    """The first words of all n-word windows that lie in one row."""
    total = int(word_offsets[-1])
    ends = np.repeat(word_offsets[1:], np.diff(word_offsets))
    return np.flatnonzero(ends - np.arange(total) >= n)
