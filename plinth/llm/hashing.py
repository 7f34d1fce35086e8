"""Vectorised hashes of words, shingles and byte ranges of many texts at once.

A polynomial hash modulo 2**64 with a random 64-bit value for each byte is summed
once over a chunk of texts; any range's hash is then a difference, brought to a
common place by the inverse of the base.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np

#: Texts are hashed in chunks of about so many bytes; a longer text is a chunk of its own.
CHUNK_BYTES = 1 << 20

_U = np.uint64
_BASE = 0x9E3779B97F4A7C15 | 5
_INVERSE = pow(_BASE, -1, 1 << 64)
_BYTE = np.random.Generator(np.random.PCG64(20_240_601)).integers(1, 1 << 63, 256, dtype=np.uint64) * _U(2) + _U(1)
_SPACE = np.zeros(256, bool)
_SPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True
_PLACE = np.array([pow(0xD6E8FEB86659FD93, k + 1, 1 << 64) for k in range(64)], dtype=np.uint64)
_powers: list[np.ndarray] = [np.ones(1, _U), np.ones(1, _U)]


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """The first n powers of the base and of its inverse."""
    if len(_powers[0]) < n:
        size = 1 << max(n - 1, 1).bit_length()
        for i, base in enumerate((_BASE, _INVERSE)):
            own = np.full(size, base, _U)
            own[0] = 1
            _powers[i] = np.multiply.accumulate(own)
    return _powers[0][:n], _powers[1][:n]


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit values that spreads their bits."""
    x = x ^ (x >> _U(30))
    x = x * _U(0xBF58476D1CE4E5B9)
    x ^= x >> _U(27)
    x = x * _U(0x94D049BB133111EB)
    return x ^ (x >> _U(31))


def prefix_sums(data: np.ndarray) -> np.ndarray:
    """Sums so that range_hash can take any range of data, uint8."""
    sums = np.zeros(len(data) + 1, _U)
    np.cumsum(_BYTE[data] * powers(len(data))[0], out=sums[1:])
    return sums


def range_hash(sums: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Hashes of the ranges; equal contents have equal hashes wherever they lie."""
    return mix((sums[end] - sums[start]) * powers(len(sums))[1][start] + (end - start).astype(_U) * _PLACE[63])


def chunks(texts: Iterable[bytes]) -> Iterator[list[bytes]]:
    own, size = [], 0
    for t in texts:
        if own and size + len(t) > CHUNK_BYTES:
            yield own
            own, size = [], 0
        own.append(t)
        size += len(t) + 1
    if own:
        yield own


def joined(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """The texts' bytes with a line feed after each, and where each begins (and the end)."""
    begin = np.zeros(len(texts) + 1, np.int64)
    np.cumsum([len(t) + 1 for t in texts], out=begin[1:])
    return np.frombuffer(b"\n".join(texts) + b"\n", np.uint8), begin


def word_places(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where the words of data, uint8, begin and end; data ends with a blank or the last word with it."""
    space = _SPACE[data]
    padded = np.r_[True, space, True]
    return np.flatnonzero(padded[:-1] & ~padded[1:]), np.flatnonzero(~padded[:-1] & padded[1:])


def word_sums(words: np.ndarray) -> np.ndarray:
    """Sums so that range_hash can take any range of word hashes."""
    sums = np.zeros(len(words) + 1, _U)
    np.cumsum((words | _U(1)) * powers(len(words))[0], out=sums[1:])
    return sums


def shingle_sets(texts: Iterable[str | None], width: int = 5) -> Iterator[np.ndarray]:
    """For each text the sorted distinct hashes of its word shingles.

    Words are lower-cased in A-Z. A text of fewer words than the width has its whole
    sequence as one shingle; one without words has none.
    """
    for own in chunks((t or "").encode("utf-8", "surrogatepass").lower() for t in texts):
        data, begin = joined(own)
        sums = prefix_sums(data)
        start, end = word_places(data)
        words = range_hash(sums, start, end)
        first = np.searchsorted(start, begin)
        if len(words) >= width:
            n = len(words) - width + 1
            whole = words[:n] * _PLACE[0]
            for k in range(1, width):
                whole += words[k : n + k] * _PLACE[k]
            whole = mix(whole)
        for d in range(len(own)):
            a, b = first[d], first[d + 1]
            if b - a >= width:
                yield np.unique(whole[a : b - width + 1])
            elif b > a:
                few = (words[a:b] * _PLACE[: b - a]).sum(dtype=_U) ^ _PLACE[40 + (b - a)]
                yield mix(np.array([few], _U))
            else:
                yield np.zeros(0, _U)
