"""Minimal acyclic automata over byte strings, as numpy arrays.

Built from sorted words one after the other (states that accept the same
endings are one), so the automaton is minimal at every step.  Each edge also
holds how many accepted words come before those through it: along a word's
path these outputs add up to the word's place in the sorted list.  Numbers
are the outputs that keep the automaton as small as the plain acceptor, and
whatever a word maps to is found under its number.
"""

from __future__ import annotations

from collections.abc import Iterable

import numpy as np


class Automaton:
    """States 0..n-1 with their edges side by side, in order of symbols.

    ``first``: where each state's edges begin (one longer than the states);
    ``symbol``, ``target``, ``before``: of each edge; ``final`` and ``below``
    (words accepted from here on): of each state; ``start``: the first state.
    """

    def __init__(self, words: Iterable[bytes]) -> None:
        """``words`` ascend and differ from one another."""
        known: dict[tuple, int] = {}
        states: list[tuple] = []
        final, edges = [False], [[]]  # of the states on the last word's path
        last = b""

        def close(down_to: int) -> None:
            for depth in range(len(last), down_to, -1):
                key = (final.pop(), *edges.pop())
                number = known.get(key)
                if number is None:
                    number = known[key] = len(states)
                    states.append(key)
                edges[-1].append((last[depth - 1], number))

        for word in words:
            same = 0
            for a, b in zip(last, word):
                if a != b:
                    break
                same += 1
            close(same)
            for _ in range(same, len(word)):
                final.append(False)
                edges.append([])
            final[-1] = True
            last = word
        close(0)
        states.append((final[0], *edges[0]))
        self.start = len(states) - 1
        self.final = np.array([s[0] for s in states], bool)
        degree = np.array([len(s) - 1 for s in states], np.int64)
        self.first = np.concatenate([[0], np.cumsum(degree)])
        flat = np.array([e for s in states for e in s[1:]], np.int64).reshape(-1, 2)
        self.symbol, self.target = flat[:, 0].astype(np.uint8), flat[:, 1]
        self.below, before = [0] * len(states), []
        for number, s in enumerate(states):  # targets come before their sources
            count = int(s[0])
            for _, target in s[1:]:
                before.append(count)
                count += self.below[target]
            self.below[number] = count
        self.below, self.before = np.array(self.below, np.int64), np.array(before, np.int64)
        self.edge = np.repeat(np.arange(len(states)), degree) << 8 | self.symbol

    def edges_of(self, states: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """All edges of the given states, and for each the place of its state among those given."""
        degree = self.first[states + 1] - self.first[states]
        which = np.repeat(np.arange(len(states)), degree)
        ends = np.cumsum(degree)
        return self.first[states][which] + np.arange(len(which)) - (ends - degree)[which], which

    def edge_by(self, states: np.ndarray, symbols: np.ndarray) -> np.ndarray:
        """The edge of each state with a symbol, -1 where it has none."""
        if not len(self.edge):
            return np.full(len(states), -1)
        wanted = states << 8 | symbols
        at = np.minimum(np.searchsorted(self.edge, wanted), len(self.edge) - 1)
        return np.where(self.edge[at] == wanted, at, -1)
