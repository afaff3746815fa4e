"""Sets of word shingles as sorted arrays of 64-bit hashes, made from whole batches of bytes at once."""

from __future__ import annotations

from collections.abc import Iterator
from functools import cache

import numpy as np

U = np.uint64
_BASE, _MIX1, _MIX2 = U(0x9E3779B97F4A7C15 | 1), U(0xBF58476D1CE4E5B9), U(0x94D049BB133111EB)
#: Bytes that are hashed at once: bounds a worker's memory.
CHUNK = 1 << 18


def mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> U(30))) * _MIX1
    h = (h ^ (h >> U(27))) * _MIX2
    return h ^ (h >> U(31))


@cache
def _tables() -> tuple[np.ndarray, np.ndarray]:
    """By byte: is it white space; a random number, the same for A-Z and a-z."""
    space = np.zeros(256, bool)
    space[[32, 9, 10, 11, 12, 13]] = True
    value = np.random.default_rng(5).integers(1, 1 << 63, 256, dtype=np.int64).astype(U) | U(1)
    value[65:91] = value[97:123]
    return space, value


@cache
def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    inverse = U(pow(int(_BASE), -1, 1 << 64))
    return np.cumprod(np.r_[U(1), np.full(n, _BASE, U)]), np.cumprod(np.r_[U(1), np.full(n, inverse, U)])


def _hash_words(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and hashes of the words in these bytes."""
    space, value = _tables()
    size = CHUNK if len(data) <= CHUNK else 1 << (len(data) - 1).bit_length()
    up, down = _powers(size) if size == CHUNK else _powers.__wrapped__(size)
    edge = np.flatnonzero(np.diff(np.r_[True, space[data], True].astype(np.int8)))
    a, b = edge[::2], edge[1::2]
    sums = np.zeros(len(data) + 1, U)
    np.cumsum(value[data] * up[: len(data)], out=sums[1:])
    return a, mix((sums[b] - sums[a]) * down[a] + (b - a).astype(U))


def word_hashes(texts: list[bytes]) -> list[np.ndarray]:
    """For each text the hashes of its words, A-Z lower-cased. Long texts are cut at spaces, so memory is bounded."""
    out: list[np.ndarray] = []
    for own in _grouped(texts):
        if len(own) == 1:
            data, parts, at = own[0], [], 0
            while at < len(data):
                end = at + CHUNK
                while end < len(data) and data[end] not in b" \t\n\x0b\x0c\r":
                    end += 1
                parts.append(_hash_words(np.frombuffer(data[at:end], np.uint8))[1])
                at = end
            out.append(np.concatenate(parts) if parts else np.empty(0, U))
            continue
        starts = np.cumsum([0, *(len(x) + 1 for x in own)])
        a, h = _hash_words(np.frombuffer(b"\n".join(own), np.uint8))
        out.extend(np.split(h, np.searchsorted(a, starts[1:-1])))
    return out


def _grouped(texts: list[bytes]) -> Iterator[list[bytes]]:
    own, size = [], 0
    for x in texts:
        if own and size + len(x) + 1 > CHUNK:
            yield own
            own, size = [], 0
        own.append(x)
        size += len(x) + 1
    if own:
        yield own


def shingle_set(words: np.ndarray, width: int) -> np.ndarray:
    """The distinct hashes of the windows of `width` words, sorted; of fewer words, of all as one; of none, none."""
    n = len(words)
    if n == 0:
        return np.empty(0, U)
    w = min(n, width)
    h = np.full(n - w + 1, U(w), U)
    for k in range(w):
        h = mix(h * _BASE + words[k : n - w + 1 + k])
    return np.unique(h)
