"""The k best of each row of scores that come in pieces, for tasks that keep their own best only."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame

#: Half a unit of the sixth place more, as rounding may lift a score to the least one.
SLACK = 1e-6


class Best:
    """The k best of each row by score, rounded to six places, then by key; NaN is the largest score, a null key the least.

    Rows are numbered from 0.  What can't be among the k best any more is dropped where it is added, by a bound for
    each row.
    """

    def __init__(self, k: int, n: int = 0, positive: bool = False, pending: int = 200_000) -> None:
        self.k, self.most, self.start = k, pending, np.nextafter(0, 1) if positive else -np.inf
        self.bound = np.full(n, self.start)
        self.parts: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        self.pending = 0

    def grow(self, n: int) -> None:
        self.bound = np.concatenate([self.bound, np.full(n, self.start)])

    def add(self, scores: np.ndarray, keys: np.ndarray, first: int = 0) -> None:
        """Scores of the rows from first on, one column for each of the keys."""
        bound = self.bound[first : first + len(scores)]
        passed = ~(scores < bound[:, None])
        if scores.shape[1] > self.k and len(many := np.flatnonzero(passed.sum(axis=1) > self.k)):
            least = np.partition(scores[many], -self.k, axis=1)[:, -self.k] - SLACK
            bound[many] = np.fmax(bound[many], least)
            passed[many] &= ~(scores[many] < bound[many, None])
        rows, at = np.nonzero(passed)
        if len(rows):
            self.parts.append((rows + first, np.round(scores[rows, at], 6), keys[at]))
            self.pending += len(rows)
            if self.pending > self.most:
                self._cut()

    def _cut(self, ties: bool = False) -> None:
        """Drops what is worse than the k best; ties with the last of them stay, unless asked for or too many."""
        if not self.parts:
            return
        rows, scores, keys = (np.concatenate(x) for x in zip(*self.parts, strict=True))
        rank = np.where(np.isnan(scores), np.inf, scores)
        by = [-rank, rows]
        if ties:
            number = {key: i for i, key in enumerate(sorted(set(keys.tolist()), key=lambda x: (x is not None, x)))}
            by.insert(0, np.array([number[key] for key in keys.tolist()]))
        order = np.lexsort(by)
        rows, scores, keys, rank = rows[order], scores[order], keys[order], rank[order]
        starts = np.flatnonzero(np.diff(rows, prepend=-1))
        counts = np.diff(starts, append=len(rows))
        last = np.where(counts >= self.k, rank[starts + np.minimum(self.k, counts) - 1], -np.inf)
        self.bound[rows[starts]] = np.fmax(self.bound[rows[starts]], last - SLACK)
        keep = np.arange(len(rows)) - np.repeat(starts, counts) < self.k if ties else rank >= np.repeat(last, counts)
        self.parts, self.pending = [(rows[keep], scores[keep], keys[keep])], 0
        if not ties and keep.sum() > 2 * max(self.most, len(starts) * self.k):
            self._cut(ties=True)

    def result(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Rows, scores and keys, best first within each row."""
        self._cut(ties=True)
        return self.parts[0] if self.parts else (np.zeros(0, dtype=np.int64), np.zeros(0), np.zeros(0, dtype=object))


def in_few_tasks(df: DataFrame) -> DataFrame:
    """df in some tasks for each core, however many files it has, as each task shuffles k rows of every question."""
    return df.coalesce(max(12, 2 * df.sparkSession.sparkContext.defaultParallelism))
