"""A suffix automaton of a vocabulary: which of its words end at each position of a text."""

from __future__ import annotations

from collections.abc import Iterable


class SuffixAutomaton:
    """Accepts every substring of the words. A state stands for substrings that end at the same places of the words;
    its suffix link leads to the longest suffix that ends at more places. After each symbol of a text the state is
    that of the longest suffix that is a substring, and the words among the suffixes lie on its chain of links.
    """

    def __init__(self, words: Iterable[tuple[str | bytes, int]]):
        words = list(words)
        self.next: list[dict] = [{}]
        self.link, self.length = [-1], [0]
        for word, _ in words:
            last = 0
            for symbol in word:
                last = self._extend(last, symbol)
        own: list[list[tuple[int, int]]] = [[] for _ in self.next]
        for word, value in words:
            state = 0
            for symbol in word:
                state = self.next[state][symbol]
            own[state].append((len(word), value))
        #: (length, value) of the words that end where a state's substrings end, longest first; those longer than what was matched don't count.
        self.ending: list[list[tuple[int, int]]] = own
        for state in sorted(range(1, len(self.next)), key=self.length.__getitem__):
            above = self.ending[self.link[state]]
            own[state] = sorted(own[state], reverse=True) + above if own[state] else above

    def _extend(self, last: int, symbol) -> int:
        there = self.next[last].get(symbol)
        if there is not None:
            return there if self.length[there] == self.length[last] + 1 else self._split(last, symbol, there)
        new = len(self.next)
        self.next.append({})
        self.length.append(self.length[last] + 1)
        self.link.append(0)
        while last >= 0 and symbol not in self.next[last]:
            self.next[last][symbol] = new
            last = self.link[last]
        if last >= 0:
            there = self.next[last][symbol]
            self.link[new] = there if self.length[there] == self.length[last] + 1 else self._split(last, symbol, there)
        return new

    def _split(self, last: int, symbol, there: int) -> int:
        """The shorter substrings of a state get a state of their own, as they now end at one more place."""
        new = len(self.next)
        self.next.append(dict(self.next[there]))
        self.length.append(self.length[last] + 1)
        self.link.append(self.link[there])
        self.link[there] = new
        while last >= 0 and self.next[last].get(symbol) == there:
            self.next[last][symbol] = new
            last = self.link[last]
        return new
