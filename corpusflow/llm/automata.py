"""Probabilistic automata inferred from strings by merging states of a prefix tree."""

from __future__ import annotations

import math
import numpy as np

class Automaton:
    """A deterministic automaton with counts on its transitions and on its ends.

    ``infer`` builds the prefix tree of the strings and merges states whose futures agree. Two states agree if, for the
    end and for every next symbol, the relative frequencies differ by less than the Hoeffding bound at level ``alpha``,
    and so do their successors. States of equal depth are merged first and states of other depths after that: a format of
    fixed length becomes a chain that keeps its length, and a loop appears only where the futures of two depths agree.
    """

    def __init__(self) -> None:
        self.count: list[int] = [0]
        self.ends: list[int] = [0]
        self.next: list[dict[int, int]] = [{}]
        self.depth: list[int] = [0]

    def add(self, symbols: list[int], times: int = 1) -> None:
        state = 0
        self.count[0] += times
        for s in symbols:
            if s not in self.next[state]:
                self.next[state][s] = len(self.count)
                self.count.append(0)
                self.ends.append(0)
                self.next.append({})
                self.depth.append(self.depth[state] + 1)
            state = self.next[state][s]
            self.count[state] += times
        self.ends[state] += times

    def _find(self, state: int) -> int:
        while self.parent[state] != state:
            self.parent[state] = self.parent[self.parent[state]]
            state = self.parent[state]
        return state

    def _agree(self, a: int, b: int, limit: float) -> bool:
        """Whether nothing tells the futures of a and b apart; iterative, since chains can be long."""
        stack, seen = [(a, b)], set()
        while stack:
            pair = stack.pop()
            a, b = self._find(pair[0]), self._find(pair[1])
            if a == b or (a, b) in seen:
                continue
            seen.add((a, b))
            na, nb = self.count[a], self.count[b]
            bound = limit * (1 / math.sqrt(na) + 1 / math.sqrt(nb))
            if bound >= 1:  # too few strings pass here to tell them apart
                continue
            if abs(self.ends[a] / na - self.ends[b] / nb) > bound:
                return False
            fa, fb = self.flow[a], self.flow[b]
            for s in fa.keys() | fb.keys():
                if abs(fa.get(s, 0) / na - fb.get(s, 0) / nb) > bound:
                    return False
                if s in fa and s in fb:
                    stack.append((self.next[a][s], self.next[b][s]))
        return True

    def _merge(self, a: int, b: int) -> None:
        """Make b and a one state, and their successors by equal symbols too, so that the automaton stays deterministic."""
        stack = [(a, b)]
        while stack:
            pair = stack.pop()
            a, b = self._find(pair[0]), self._find(pair[1])
            if a == b:
                continue
            self.parent[b] = a
            self.count[a] += self.count[b]
            self.ends[a] += self.ends[b]
            self.depth[a] = min(self.depth[a], self.depth[b])
            for s, child in self.next[b].items():
                self.flow[a][s] = self.flow[a].get(s, 0) + self.flow[b][s]
                if s in self.next[a]:
                    stack.append((self.next[a][s], child))
                else:
                    self.next[a][s] = child

    @classmethod
    def infer(cls, strings: list[list[int]], alpha: float = 0.01) -> Automaton:
        self = cls()
        for x in strings:
            self.add(x)
        self.parent = list(range(len(self.count)))
        self.flow = [{s: self.count[t] for s, t in n.items()} for n in self.next]
        limit = math.sqrt(0.5 * math.log(2 / alpha))
        # first within each depth, from the root down: by then the strings of a whole depth meet in few states
        layer, order = [0], [0]
        while layer:
            below = {self._find(t) for r in layer for t in self.next[r].values()}
            layer = []
            for blue in sorted(below, key=lambda t: (-self.count[t], t)):
                blue = self._find(blue)
                if blue in layer:
                    continue
                for red in layer:
                    if self._agree(red, blue, limit):
                        self._merge(red, blue)
                        break
                else:
                    layer.append(blue)
            order += layer
        # then across depths
        red = []
        for blue in order:
            if self._find(blue) != blue:
                continue
            for target in red:
                if self._find(target) == target and self._agree(target, blue, limit):
                    self._merge(target, blue)
                    break
            else:
                red.append(blue)
        states = [0, *sorted({self._find(r) for r in order} - {0})]
        number = {r: i for i, r in enumerate(states)}
        self.next = [{s: number[self._find(t)] for s, t in self.next[r].items()} for r in states]
        self.flow = [self.flow[r] for r in states]
        self.count, self.ends = [self.count[r] for r in states], [self.ends[r] for r in states]
        self.depth = [self.depth[r] for r in states]
        return self

    def tables(self, symbols: int, smoothing: float = 0.1) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Successors and log probabilities (states x symbols) and log end probabilities.

        A symbol never seen in a state leads to a sink where every symbol and the end are equally likely.
        """
        n = len(self.count)
        to = np.full((n + 1, symbols), n, dtype=np.int32)
        log = np.full((n + 1, symbols), -math.log(symbols + 1))
        end = np.full(n + 1, -math.log(symbols + 1))
        for state in range(n):
            seen = sum(self.flow[state].values()) + self.ends[state]
            total = seen + smoothing * (symbols + 1)
            log[state] = math.log(smoothing / total)
            end[state] = math.log((self.ends[state] + smoothing) / total)
            for s, t in self.next[state].items():
                to[state, s] = t
                log[state, s] = math.log((self.flow[state][s] + smoothing) / total)
        return to, log, end
