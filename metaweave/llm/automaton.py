"""A suffix automaton over numbers that grows as text is read, for several texts.

States are held in flat lists: nearly all have a single transition, which is stored in place; only
further ones need a dict.
"""

from __future__ import annotations


class SuffixAutomaton:
    def __init__(self):
        self.length, self.link, self.word, self.to = [0], [-1], [None], [0]
        self.more: dict[int, dict[int, int]] = {}

    def _go(self, state: int, c: int) -> int:
        if self.word[state] == c:
            return self.to[state]
        more = self.more.get(state)
        return more.get(c, -1) if more is not None else -1

    def _set(self, state: int, c: int, to: int) -> None:
        if self.word[state] is None or self.word[state] == c:
            self.word[state], self.to[state] = c, to
        else:
            self.more.setdefault(state, {})[c] = to

    def _new(self, length: int) -> int:
        self.length.append(length)
        self.link.append(0)
        self.word.append(None)
        self.to.append(0)
        return len(self.length) - 1

    def _split(self, p: int, q: int, c: int) -> int:
        clone = self._new(self.length[p] + 1)
        self.link[clone], self.word[clone], self.to[clone] = self.link[q], self.word[q], self.to[q]
        if q in self.more:
            self.more[clone] = dict(self.more[q])
        self.link[q] = clone
        while p != -1 and self._go(p, c) == q:
            self._set(p, c, clone)
            p = self.link[p]
        return clone

    def extend(self, last: int, c: int) -> int:
        """The state of the text so far and c; last is the state of the text so far (0 at a text's start)."""
        q = self._go(last, c)
        if q != -1:
            return q if self.length[q] == self.length[last] + 1 else self._split(last, q, c)
        current, p = self._new(self.length[last] + 1), last
        while p != -1 and self._go(p, c) == -1:
            self._set(p, c, current)
            p = self.link[p]
        if p != -1:
            q = self._go(p, c)
            self.link[current] = q if self.length[q] == self.length[p] + 1 else self._split(p, q, c)
        return current

    def step(self, state: int, size: int, c: int) -> tuple[int, int]:
        """Matching statistics: state and length of the longest suffix of what was read, now with c, that occurs in the automaton's texts."""
        q = self._go(state, c)
        while q == -1:
            state = self.link[state]
            if state == -1:
                return 0, 0
            size = self.length[state]
            q = self._go(state, c)
        return q, size + 1

    def matches(self, words: list[int]) -> list[int]:
        """For each place the length of the longest match that ends there."""
        out, state, size = [], 0, 0
        word, to, more, link, length = self.word, self.to, self.more, self.link, self.length
        for c in words:
            while True:
                if word[state] == c:
                    state, size = to[state], size + 1
                    break
                d = more.get(state)
                if d is not None and c in d:
                    state, size = d[c], size + 1
                    break
                if state == 0:
                    size = 0
                    break
                state = link[state]
                size = length[state]
            out.append(size)
        return out

    def add(self, words: list[int]) -> list[int]:
        """Read words and add them; the lengths of matches with what was there before each word, this text's earlier words included."""
        out, last, state, size = [], 0, 0, 0
        for c in words:
            state, size = self.step(state, size, c)
            out.append(size)
            before = len(self.length)
            last = self.extend(last, c)
            if len(self.length) > before and size:
                # a state may have been split: the match must stand in the part that holds its length
                while self.length[self.link[state]] >= size:
                    state = self.link[state]
        return out
