"""Agendas of many short symbol sequences that advance together, one merge each per step."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np

NONE = np.iinfo(np.int32).max


class PairAgenda:
    """Merges adjacent symbols by rank (0 first), leftmost among equals, until no pair is left.

    pairs: {(left, right): (union, rank)} of symbol numbers below 2^31.
    """

    def __init__(self, pairs: dict[tuple[int, int], tuple[int, int]]):
        coded = {left << 32 | right: found for (left, right), found in pairs.items()}
        order = sorted(coded)
        # The last place stands for pairs that do not merge.
        self.keys = np.array([*order, 1 << 62], dtype=np.int64)
        self.union = np.array([*(coded[k][0] for k in order), 0], dtype=np.int64)
        self.rank = np.array([*(coded[k][1] for k in order), NONE], dtype=np.int32)

    def _look_up(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        keys = left << 32 | right
        at = np.searchsorted(self.keys, keys)
        return np.where(self.keys[at] == keys, at, len(self.keys) - 1)

    def run(self, lengths: np.ndarray, start: Callable[[np.ndarray, int], np.ndarray], done: Callable[[np.ndarray, np.ndarray], None]) -> None:
        """lengths: symbols of each sequence (0: left out); start(rows, n): the symbols of sequences of n
        symbols, a row each; done(rows, symbols): takes sequences that are finished.

        Sequences of n symbols are the rows of a matrix; the agenda of a row is its n - 1 pairs.  A step
        takes the best pair of each row, merges it and ranks the two pairs beside it; all rows that go
        on have n - 1 symbols then and meet the sequences that began with so many.
        """
        rows = np.zeros(0, np.int64)
        symbols = agenda = np.zeros((0, 0), np.int64)
        for count in range(int(lengths.max(initial=0)), 0, -1):
            fresh = np.flatnonzero(lengths == count)
            if len(fresh):
                begun = start(fresh, count)
                places = self._look_up(begun[:, :-1], begun[:, 1:])
                if len(rows):
                    rows = np.concatenate([rows, fresh])
                    symbols, agenda = np.concatenate([symbols, begun]), np.concatenate([agenda, places])
                else:
                    rows, symbols, agenda = fresh, begun, places
            if not len(rows):
                continue
            every = np.arange(len(rows))
            if count > 1:
                offered = self.rank[agenda]
                best = offered.argmin(axis=1)
                ended = offered[every, best] == NONE
            else:
                ended = np.ones(len(rows), bool)
            if ended.any():
                done(rows[ended], symbols[ended])
            if count == 1:
                return
            going = ~ended
            rows, symbols, agenda, best = rows[going], symbols[going], agenda[going], best[going]
            every = np.arange(len(rows))
            symbols[every, best] = self.union[agenda[every, best]]
            keep = np.ones(symbols.shape, bool)
            keep[every, best + 1] = False
            symbols = symbols[keep].reshape(len(rows), count - 1)
            keep = np.ones(agenda.shape, bool)
            keep[every, best] = False
            agenda = agenda[keep].reshape(len(rows), count - 2)
            for shift in (-1, 0):
                near = np.flatnonzero((best + shift >= 0) & (best + shift < count - 2))
                at = best[near] + shift
                agenda[near, at] = self._look_up(symbols[near, at], symbols[near, at + 1])
