"""A priority queue that moves what is wanted last to a scratch file."""

from __future__ import annotations

import pickle
import tempfile
from collections.abc import Iterator
from heapq import heapify, heappop, heappush, heapreplace

#: Entries of a run that are read or written at a time.
CHUNK = 1 << 12


def _read(file, chunks: int) -> Iterator:
    for _ in range(chunks):
        yield from pickle.load(file)
    file.close()


class SpillingQueue:
    """Entries come out smallest first; at most ``most`` of them are in memory, beside one chunk for each run on disk.

    Runs are anonymous files of the task that works with the queue: nothing else
    reads them, they vanish with it, and a task that is run again writes its own.
    """

    def __init__(self, most: int):
        self.most, self.heap, self.runs, self.spilled = max(most, 2), [], [], 0

    def __bool__(self) -> bool:
        return bool(self.heap or self.runs)

    def push(self, entry) -> None:
        heappush(self.heap, entry)
        if len(self.heap) > self.most:
            self._spill()

    def _spill(self) -> None:
        self.heap.sort()
        late = self.heap[self.most // 2:]
        del self.heap[self.most // 2:]
        file = tempfile.TemporaryFile()
        for at in range(0, len(late), CHUNK):
            pickle.dump(late[at:at + CHUNK], file)
        file.seek(0)
        entries = _read(file, -(-len(late) // CHUNK))
        self.spilled += 1
        heappush(self.runs, (next(entries), self.spilled, entries))

    def peek(self):
        if self.runs and (not self.heap or self.runs[0][0] < self.heap[0]):
            return self.runs[0][0]
        return self.heap[0]

    def pop(self):
        if not self.runs or (self.heap and self.heap[0] < self.runs[0][0]):
            return heappop(self.heap)
        first, run, entries = self.runs[0]
        following = next(entries, None)
        if following is None:
            self.runs[0] = self.runs[-1]
            self.runs.pop()
            heapify(self.runs)
        else:
            heapreplace(self.runs, (following, run, entries))
        return first
