"""First rows of each owner, kept while batches of candidates stream past."""

from __future__ import annotations

import numpy as np

#: Stands for a missing id inside NumPy arrays; it comes after every other id.
NO_ID = np.iinfo(np.int64).max
LEAST = np.iinfo(np.int64).min


class Best:
    """The first ``k`` rows of each of ``owners`` owners: higher scores first, ties by smaller id.

    ``floor`` holds for each owner the score below which a row cannot be among its first any more, so that callers
    offer only what may still count. Memory is ``owners * k`` rows and one offer.
    """

    def __init__(self, owners: int, k: int):
        self.k = k
        self.floor = np.full(owners, LEAST)
        self.owner = self.score = self.id = np.zeros(0, np.int64)

    def offer(self, owner: np.ndarray, score: np.ndarray, ids: np.ndarray) -> None:
        owner, score, ids = (np.concatenate(x) for x in ((self.owner, owner), (self.score, score), (self.id, ids)))
        order = np.lexsort((ids, ~score, owner))
        owner, score, ids = owner[order], score[order], ids[order]
        starts = np.flatnonzero(np.diff(owner, prepend=-1))
        place = np.arange(len(owner)) - np.repeat(starts, np.diff(np.append(starts, len(owner))))
        last, kept = place == self.k - 1, place < self.k
        self.floor[owner[last]] = score[last]
        self.owner, self.score, self.id = owner[kept], score[kept], ids[kept]


def spans(total: int, most: int, first: int = 64):
    """(start, end) of successive stretches, doubling from ``first`` to ``most``: floors rise before much is offered."""
    start, size = 0, min(first, most)
    while start < total:
        yield start, min(total, start + size)
        start, size = start + size, min(2 * size, most)
