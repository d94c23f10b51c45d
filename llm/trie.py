"""Double-array tries over sequences of whole numbers, walked for all positions of a text at once."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np

#: A number is taken digit by digit, so that the children of a state lie near each other.
BITS = 8
RADIX = 1 << BITS
#: Places that are looked through at a time for the children of one state.
WIDTH = 1 << 11


@dataclass(frozen=True)
class DoubleArray:
    """States are places in three arrays; 0 is the first state.

    From state s digit c leads to ``base[s] + c`` if ``check`` of that place is
    s.  ``accept`` has the number of the sequence that ends in a state, or -1.
    """

    base: np.ndarray
    check: np.ndarray
    accept: np.ndarray
    digits: int
    length: int

    @classmethod
    def of(cls, sequences: np.ndarray, numbers: int) -> DoubleArray:
        """From the rows of a matrix in lexicographic order, shorter ones filled up with -1, of numbers below ``numbers``."""
        digits = max(1, -(-(numbers - 1).bit_length() // BITS))
        state, used, edges = np.zeros(len(sequences), np.int64), np.zeros(2 * RADIX, bool), []
        used[:RADIX] = True
        for column in sequences.T:
            for digit in reversed(range(digits)):
                rows = np.flatnonzero(column >= 0)
                parent, symbol = state[rows], column[rows].astype(np.int64) >> BITS * digit & RADIX - 1
                new = np.ones(len(rows), bool)
                new[1:] = (parent[1:] != parent[:-1]) | (symbol[1:] != symbol[:-1])
                places, used = _placed(parent[new], symbol[new], used)
                edges.append((parent[new], symbol[new], places))
                state[rows] = places[np.cumsum(new) - 1]
        size = max(int(p.max(initial=0)) for *_, p in edges) + RADIX
        # States without children point to places behind all others.
        base, check, accept = np.full(size, size, np.int32), np.full(size + RADIX, -1, np.int32), np.full(size, -1, np.int32)
        for parent, symbol, place in edges:
            base[parent], check[place] = place - symbol, parent
        accept[state] = np.arange(len(sequences))
        return cls(base, check, accept, digits, sequences.shape[1])

    def walk(self, text: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """For each length from 1: the positions of ``text`` from which so many numbers lead to a state, and that state.

        Numbers below 0 are in no sequence.
        """
        at, state = np.arange(len(text)), np.zeros(len(text), np.int64)
        for more in range(self.length):
            here = np.flatnonzero(at < len(text) - more)
            here = here[text[at[here] + more] >= 0]
            at, state = at[here], state[here]
            number = text[at + more]
            for digit in reversed(range(self.digits)):
                place = self.base[state] + (number >> BITS * digit & RADIX - 1)
                go = np.flatnonzero(self.check[place] == state)
                at, state, number = at[go], place[go], number[go]
            yield at, state


def _placed(parent: np.ndarray, symbol: np.ndarray, used: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """A free place for each edge, at one distance from the symbols of its parent.

    The states with most children come first; each time there are half as many
    children the search begins at the front again.
    """
    first = np.flatnonzero(np.concatenate((np.ones(len(parent[:1]), bool), parent[1:] != parent[:-1])))
    count = np.diff(np.append(first, len(parent)))
    places, low, most = np.empty(len(parent), np.int64), 0, 0
    for group in np.argsort(-count, kind="stable"):
        if count[group] == 1:
            break
        if 2 * count[group] <= most or not most:
            low, most = 0, count[group]
        own = slice(first[group], first[group] + count[group])
        wanted = symbol[own]
        while True:
            if len(used) < low + WIDTH + 2 * RADIX:
                used = np.concatenate((used, np.zeros(len(used) + WIDTH, bool)))
            start = np.flatnonzero(~used[low:low + WIDTH]) + low - wanted[0]
            start = start[start >= 0]
            fits = np.flatnonzero(~used[start[:, None] + wanted].any(1))
            if len(fits):
                break
            low += WIDTH
        places[own] = start[fits[0]] + wanted
        used[places[own]] = True
    # An only child goes to any free place.
    single = first[count == 1]
    used = np.concatenate((used, np.zeros(len(single) + RADIX, bool)))
    places[single] = np.flatnonzero(~used)[:len(single)]
    used[places[single]] = True
    return places, used
