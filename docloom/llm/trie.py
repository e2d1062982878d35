"""Self-join of binary tries over 64-bit codes, within a Hamming budget; numpy only."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np

CHUNK = 400_000


def _popcount(x: np.ndarray) -> np.ndarray:
    return np.bitwise_count(x).astype(np.int64)


class Labels:
    """The component of each position so far, as the position it is named after."""

    def __init__(self, n: int):
        self.of = np.arange(n)
        self._changes: np.ndarray | None = None

    def link(self, i: np.ndarray, j: np.ndarray) -> None:
        of = self.of
        while len(i):
            a, b = of[i], of[j]
            differ = a != b
            i, j, a, b = i[differ], j[differ], a[differ], b[differ]
            if not len(i):
                break
            np.minimum.at(of, np.maximum(a, b), np.minimum(a, b))
            while True:  # halve the paths until each position names its root
                up = of[of]
                if np.array_equal(up, of):
                    break
                of = up
        self.of, self._changes = of, None

    def uniform(self, lo: np.ndarray, hi: np.ndarray) -> np.ndarray:
        if self._changes is None:
            self._changes = np.concatenate([[0], np.cumsum(self.of[1:] != self.of[:-1])])
        return self._changes[hi - 1] == self._changes[lo]


def link_within(group: np.ndarray, code: np.ndarray, budget: int, check: Callable[[np.ndarray, np.ndarray], np.ndarray] | None = None) -> np.ndarray:
    """The component label of each row, linking rows of one group whose codes differ in at most `budget` bits.

    Rows are sorted by (group, code). Each group is a binary trie whose nodes are ranges of rows; rows of one code
    share a leaf and are compared with each other. Pairs of nodes go down one bit at a time; a pair whose paths differ in more bits than
    the budget is pruned, and so is one whose rows are all linked already. `check`, if given, gets the positions
    of pairs within the budget and says which of them to link.
    """
    n = len(code)
    labels = Labels(n)
    if not n:
        return labels.of
    start = np.flatnonzero(np.concatenate([[True], group[1:] != group[:-1]]))
    end = np.concatenate([start[1:], [n]])
    wide = end - start > 1
    start, end = start[wide], end[wide]
    ones: dict[int, np.ndarray] = {}

    def set_bits(bit: int) -> np.ndarray:
        if bit not in ones:
            ones[bit] = np.concatenate([[0], np.cumsum((code >> np.uint64(bit)) & np.uint64(1), dtype=np.int32)])
        return ones[bit]

    stack = [(63, np.stack([start, end, start, end, np.zeros(len(start), np.int64)]))]
    while stack:
        bit, pairs = stack.pop()
        a, a_end, b, b_end, used = pairs
        single = (a_end - a == 1) & (b_end - b == 1)
        i, j = a[single], b[single]
        near = _popcount(code[i] ^ code[j]) <= budget
        i, j = i[near], j[near]
        if check is not None:
            apart = labels.of[i] != labels.of[j]
            i, j = i[apart], j[apart]
            ok = check(i, j)
            i, j = i[ok], j[ok]
        labels.link(i, j)
        if bit < 0:  # leaves of several rows
            for x, x_end, y, y_end in pairs[:4, ~single].T:
                for k in range(x, x_end):
                    j = np.arange(max(y, k + 1), y_end)
                    j = j[labels.of[j] != labels.of[k]]
                    i = np.full(len(j), k)
                    ok = np.ones(len(j), bool) if check is None or not len(j) else check(i, j)
                    labels.link(i[ok], j[ok])
            continue
        rest = ~single & ~((labels.of[a] == labels.of[b]) & labels.uniform(a, a_end) & labels.uniform(b, b_end))
        if not rest.any():
            continue
        a, a_end, b, b_end, used = pairs[:, rest]
        c = set_bits(bit)
        a_mid, b_mid = a_end - (c[a_end] - c[a]), b_end - (c[b_end] - c[b])
        same = a == b
        kids = []
        for lo, hi, lo2, hi2, more, keep in (
            (a_mid, a_end, b, b_mid, 1, ~same),
            (a, a_mid, b_mid, b_end, 1, None),
            (a, a_mid, b, b_mid, 0, None),
            (a_mid, a_end, b_mid, b_end, 0, None),
        ):
            ok = (hi > lo) & (hi2 > lo2) & (used + more <= budget) & ~((lo == lo2) & (hi - lo == 1))
            ok = ok if keep is None else ok & keep
            kids.append(np.stack([lo[ok], hi[ok], lo2[ok], hi2[ok], used[ok] + more]))
        found = np.concatenate(kids, axis=1)  # those within one node come last, so they are linked first
        for at in range(0, found.shape[1], CHUNK):
            stack.append((bit - 1, found[:, at : at + CHUNK]))
    return labels.of
