"""Probabilistic automata learned from strings by merging the states of their prefix tree."""

from __future__ import annotations

import math

SYMBOLS = 66  # the characters of which a credential may consist, and the end


class Automaton:
    """States hold how often they were reached and ended in, and for each character the next state and its count."""

    def __init__(self, strings: list[str], alpha: float = 0.05):
        self.reached, self.ended, self.next = [0], [0], [{}]
        for s in strings:
            self._add(s)
        self._merge(math.sqrt(0.5 * math.log(2 / alpha)))

    def _add(self, s: str) -> None:
        at = 0
        self.reached[0] += 1
        for c in s:
            to = self.next[at].get(c)
            if to is None:
                self.reached.append(0), self.ended.append(0), self.next.append({})
                to = [len(self.next) - 1, 0]
                self.next[at][c] = to
            to[1] += 1
            at = to[0]
            self.reached[at] += 1
        self.ended[at] += 1

    def _differ(self, f: int, n: int, g: int, m: int, width: float) -> bool:
        """Whether two frequencies differ by more than a Hoeffding bound allows."""
        return abs(f / n - g / m) > width * (1 / math.sqrt(n) + 1 / math.sqrt(m))

    def _compatible(self, a: int, b: int, width: float) -> bool:
        todo, seen = [(a, b)], set()
        while todo:
            p, q = todo.pop()
            if p == q or (p, q) in seen:
                continue
            seen.add((p, q))
            n, m = self.reached[p], self.reached[q]
            if not n or not m:
                continue
            if self._differ(self.ended[p], n, self.ended[q], m, width):
                return False
            for c in self.next[p].keys() | self.next[q].keys():
                x, y = self.next[p].get(c), self.next[q].get(c)
                if self._differ(x[1] if x else 0, n, y[1] if y else 0, m, width):
                    return False
                if x and y:
                    todo.append((x[0], y[0]))
        return True

    def _fold(self, into: int, tree: int) -> None:
        todo = [(into, tree)]
        while todo:
            p, q = todo.pop()
            self.reached[p] += self.reached[q]
            self.ended[p] += self.ended[q]
            for c, (child, n) in self.next[q].items():
                own = self.next[p].get(c)
                if own is None:
                    self.next[p][c] = [child, n]
                else:
                    own[1] += n
                    todo.append((own[0], child))

    def _merge(self, width: float) -> None:
        """Settled states grow from the root; a child of one is merged into the first compatible settled state or settles."""
        settled, kept = [0], {0}
        while True:
            open_ = [(-self.reached[to[0]], to[0], s, c) for s in settled for c, to in self.next[s].items() if to[0] not in kept]
            if not open_:
                break
            _, child, parent, c = min(open_)
            for s in settled:
                if self._compatible(s, child, width):
                    self.next[parent][c][0] = s
                    self._fold(s, child)
                    break
            else:
                settled.append(child)
                kept.add(child)
        self.states = settled

    def log_likelihood(self, s: str, smooth: float = 0.5) -> float:
        """Mean log probability of a character (and the end), with unseen characters smoothed."""
        at, total = 0, 0.0
        for c in s:
            n, to = self.reached[at], self.next[at].get(c)
            total += math.log(((to[1] if to else 0) + smooth / SYMBOLS) / (n + smooth))
            at = to[0] if to else at
        total += math.log((self.ended[at] + smooth / SYMBOLS) / (self.reached[at] + smooth))
        return total / (len(s) + 1)
