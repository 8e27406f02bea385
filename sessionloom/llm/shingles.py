"""Word shingles of whole texts as 64-bit hashes, computed on byte arrays."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np

SPACE = np.isin(np.arange(256), [32, *range(9, 14)])
LOWER = bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))
BASE = np.uint64(0x9E3779B97F4A7C15)


def mix(x: np.ndarray, salt: int = 0) -> np.ndarray:
    """A 64-bit finaliser: every input bit reaches every output bit."""
    x = x + np.uint64((0x632BE59BD9B4E019 * (salt + 1)) & (2**64 - 1))
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def powers(n: int) -> np.ndarray:
    return np.cumprod(np.full(n, BASE, np.uint64))


def words(data: np.ndarray, offsets: np.ndarray, space: np.ndarray = SPACE) -> tuple[np.ndarray, np.ndarray]:
    """(hash, document number) of every blank-separated word, A-Z lowered."""
    lowered = np.frombuffer(data.tobytes().translate(LOWER), np.uint8)
    inside = ~space[lowered]
    first = inside.copy()
    first[1:] &= ~inside[:-1]
    edges = offsets[:-1][offsets[:-1] < offsets[1:]]
    first[edges] = inside[edges]
    at = np.flatnonzero(inside)
    if not len(at):
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    starts = np.flatnonzero(first[at])
    sizes = np.diff(np.append(starts, len(at)))
    place = np.arange(len(at)) - np.repeat(starts, sizes)
    value = (lowered[at].astype(np.uint64) + np.uint64(1)) * powers(int(sizes.max()))[place]
    hashes = mix(np.add.reduceat(value, starts) + sizes.astype(np.uint64))
    return hashes, np.searchsorted(offsets, at[starts], "right") - 1


def sets(data: np.ndarray, offsets: np.ndarray, width: int) -> Iterator[np.ndarray]:
    """Per document the sorted distinct hashes of its shingles of ``width`` words.

    A document of fewer words, but not none, has its whole word sequence as the
    only shingle; one without words has the empty set.
    """
    hashes, owner = words(data, offsets)
    ends = np.searchsorted(owner, np.arange(len(offsets) - 1), "right")
    weights = powers(width + 1)
    total = np.zeros(max(0, len(hashes) - width + 1), np.uint64)
    for k in range(width):
        total += hashes[k : k + len(total)] * weights[k]
    total = mix(total, 1)
    begin = 0
    for end in ends.tolist():
        n = end - begin
        if n >= width:
            yield np.unique(total[begin : end - width + 1])
        elif n:
            short = (hashes[begin:end] * weights[:n]).sum(dtype=np.uint64, keepdims=True)
            yield mix(short + weights[width:] * np.uint64(n), 2)
        else:
            yield np.zeros(0, np.uint64)
        begin = end
