"""Double-array tries over integer symbols, built and walked with whole arrays.

A state is a slot. The child of state s by digit c lies in slot base[s] + c, and check of that slot names s. The root is slot 0 with
base 0, so a first symbol is its own state; every later symbol is two digits, its upper and its lower bits, so that the children of a
state lie close together however many symbols there are. States of all positions of a text advance together, one symbol at a time.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np

#: Children from which a node looks for its place alone, and places that it tries before the table grows.
WIDE, TRIES = 4, 64


class DoubleArray:
    """Trie of phrases: rows of symbols from 1 to `symbols`, filled up with 0. accept gives the row of the phrase that ends in a state."""

    def __init__(self, phrases: np.ndarray, symbols: int):
        n, width = phrases.shape
        self._random = np.random.default_rng(n)
        self.low = -(-int(symbols).bit_length() // 2)
        self._free = np.ones(symbols + 2 + int((phrases[:, 1:] > 0).sum()), bool)
        self._first = symbols + 1
        self._free[:self._first] = False
        self.base, self.check, self.accept = (np.full(len(self._free), fill, np.int32) for fill in (0, -1, -1))
        length = (phrases > 0).sum(1)
        state = np.zeros(n, np.int64)
        for level in range(width):
            rows = np.flatnonzero(length > level)
            if not len(rows):
                break
            own = phrases[rows, level].astype(np.int64)
            for digit in self._digits(own) if level else (own,):
                code, inverse = np.unique(state[rows] << 32 | digit, return_inverse=True)
                parent, symbol = code >> 32, code & (2**32 - 1)
                if level:
                    self._place(parent, symbol)
                slot = self.base[parent] + symbol
                self.check[slot] = parent
                state[rows] = slot[inverse]
        self.accept[state] = np.arange(n, dtype=np.int32)
        if n:
            self.accept[0] = -1

    def _digits(self, symbols: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        return symbols >> self.low, symbols & ((1 << self.low) - 1)

    def _grow(self, size: int) -> None:
        more = max(0, size - len(self._free))
        self._free = np.append(self._free, np.ones(more, bool))
        self.base, self.check, self.accept = (np.append(x, np.full(more, fill, np.int32)) for x, fill in ((self.base, 0), (self.check, -1), (self.accept, -1)))

    def _share(self) -> int:
        """Slots that the table grows by beyond what is asked for, so that it is copied seldom."""
        return (len(self._free) - self._first) // 8

    def _place(self, parent: np.ndarray, symbol: np.ndarray) -> None:
        """Bases for all parents of one level. parent is sorted and names each child's parent."""
        start = np.flatnonzero(np.append(True, parent[1:] != parent[:-1]))
        size = np.diff(np.append(start, len(parent)))
        for g in np.argsort(-size, kind="stable")[:int((size > WIDE).sum())].tolist():
            own = symbol[start[g]:start[g] + size[g]]
            tries = self._random.integers(self._first - own[0], max(len(self._free) - own[-1], self._first + 1 - own[0]), TRIES)
            at = np.minimum(tries[:, None] + own, len(self._free) - 1)
            good = np.flatnonzero(self._free[at].all(1) & (tries + own[-1] < len(self._free)))
            base = int(tries[good[0]]) if len(good) else len(self._free) - int(own[0])
            if not len(good):
                self._grow(base + int(own[-1]) + 1 + self._share())
            self.base[parent[start[g]]] = base
            self._free[base + own] = False
        left = np.flatnonzero((size <= WIDE) & (size > 1))
        while len(left):
            child = np.repeat(start[left] - np.append(0, np.cumsum(size[left])[:-1]), size[left]) + np.arange(size[left].sum())
            group = np.repeat(np.arange(len(left)), size[left])
            base = self._random.integers(self._first, max(self._first + 1, len(self._free) - int(symbol.max())), len(left))
            slot = base[group] + symbol[child]
            inside = slot < len(self._free)
            _, first, inverse = np.unique(slot, return_index=True, return_inverse=True)
            fits = inside & self._free[np.minimum(slot, len(self._free) - 1)] & (group[first][inverse] == group)
            won = np.bincount(group, weights=~fits, minlength=len(left)) == 0
            self.base[parent[start[left[won]]]] = base[won]
            self._free[slot[won[group]]] = False
            if won.sum() * 8 < len(left):
                self._grow(len(self._free) + 2 * self._share() + int(symbol.max()) + 2)
            left = left[~won]
        single = np.flatnonzero(size == 1)
        room = np.flatnonzero(self._free)
        if len(room) < len(single):
            self._grow(len(self._free) + len(single))
            room = np.flatnonzero(self._free)
        slot = room[:len(single)]
        self.base[parent[start[single]]] = slot - symbol[start[single]]
        self._free[slot] = False

    def __getstate__(self) -> dict:
        return {"base": self.base, "check": self.check, "accept": self.accept, "low": self.low}

    def walk(self, symbols: np.ndarray, run: np.ndarray, depth: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """For 1 to `depth` symbols: the positions from which that many symbols of one run lead to a state, and the states.

        symbols: 0 where a position's symbol is not in the trie; run: positions of a run are neighbours and have the same number.
        """
        at = np.flatnonzero(symbols)
        state = symbols[at].astype(np.int64)
        live = self.check[state] == 0
        at, state = at[live], state[live]
        for level in range(1, depth + 1):
            yield at, state
            inside = at + level < len(symbols)
            at, state = at[inside], state[inside]
            new = symbols[at + level].astype(np.int64)
            live = (new > 0) & (run[at + level] == run[at])
            at, state, digits = at[live], state[live], self._digits(new[live])
            for k in range(2):
                slot = self.base[state] + digits[k]
                live = (slot >= 0) & (slot < len(self.check))
                live[live] = self.check[slot[live]] == state[live]
                at, state, digits = at[live], slot[live], tuple(d[live] for d in digits)
