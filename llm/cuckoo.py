"""Cuckoo filters over arrays of 64-bit keys: insertion, deletion and lookup of many keys at a time.

A key has a 16-bit fingerprint and two buckets of four; the second bucket
follows from the first and the fingerprint.  Equal keys must be inserted once.
"""

from __future__ import annotations

import numpy as np

WAYS = 4
#: Load up to which a filter is filled, and rounds of moves before it is made anew with twice the buckets.
LOAD, ROUNDS = 0.85, 500


def mixed(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser: every input bit sways every output bit."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _places(keys: np.ndarray, buckets: int) -> tuple[np.ndarray, np.ndarray]:
    h = mixed(keys.astype(np.int64).view(np.uint64))
    marks = (h >> np.uint64(48)).astype(np.uint16)
    marks[marks == 0] = 1  # 0 is an empty place
    return marks, (h & np.uint64(buckets - 1)).astype(np.int64)


def _other(marks: np.ndarray, at: np.ndarray, buckets: int) -> np.ndarray:
    return at ^ (mixed(marks.astype(np.uint64)) & np.uint64(buckets - 1)).astype(np.int64)


def empty(keys: int) -> np.ndarray:
    buckets = 1 << max(4, int(np.ceil(np.log2(max(keys, 1) / (WAYS * LOAD)))))
    return np.zeros((buckets, WAYS), np.uint16)


def insert(cells: np.ndarray, keys: np.ndarray) -> bool:
    """Add keys in place; False if some found no room (the filter is then to be made anew)."""
    buckets = len(cells)
    marks, at = _places(keys, buckets)
    other = _other(marks, at, buckets)
    rng = np.random.default_rng(5)
    for turn in range(ROUNDS):
        for _ in range(WAYS):  # one newcomer for each bucket at a time
            if not len(marks):
                return True
            room = (cells[at] == 0)
            free = room.any(1)
            _, first = np.unique(np.where(free, at, -1 - np.arange(len(at))), return_index=True)
            first = first[free[first]]
            if not len(first):
                break
            cells[at[first], room[first].argmax(1)] = marks[first]
            keep = np.ones(len(at), bool)
            keep[first] = False
            marks, at, other = marks[keep], at[keep], other[keep]
        if turn == 0:
            at, other = other, at
            continue
        if not len(marks):
            return True
        # Each bucket that is wanted gives up one mark, which goes on to its other bucket.
        _, first = np.unique(at, return_index=True)
        full = first[(cells[at[first]] != 0).all(1)]
        way = rng.integers(0, WAYS, len(full))
        out = cells[at[full], way].copy()
        cells[at[full], way] = marks[full]
        marks[full] = out
        moved = _other(out, at[full], buckets)
        other[full], at[full] = at[full], moved
    return not len(marks)


def made(keys: np.ndarray) -> np.ndarray:
    """A filter that holds the keys, doubled until all find room."""
    cells = empty(len(keys))
    while not insert(cells, keys):
        cells = np.zeros((2 * len(cells), WAYS), np.uint16)
    return cells


def holds(cells: np.ndarray, keys: np.ndarray) -> np.ndarray:
    """True for every key inserted; for others with a chance of about one in eight thousand."""
    marks, at = _places(keys, len(cells))
    other = _other(marks, at, len(cells))
    return (cells[at] == marks[:, None]).any(1) | (cells[other] == marks[:, None]).any(1)


def delete(cells: np.ndarray, keys: np.ndarray) -> None:
    """Take out keys, each of which must have been inserted."""
    marks, at = _places(keys, len(cells))
    for mark, one, two in zip(marks, at, _other(marks, at, len(cells)), strict=True):
        for bucket in (one, two):
            ways = np.flatnonzero(cells[bucket] == mark)
            if len(ways):
                cells[bucket, ways[0]] = 0
                break


def packed(cells: np.ndarray) -> bytes:
    return cells.tobytes()


def unpacked(data: bytes) -> np.ndarray:
    return np.frombuffer(data, np.uint16).reshape(-1, WAYS).copy()
