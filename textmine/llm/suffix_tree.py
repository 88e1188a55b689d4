"""Suffix trees of integer sequences by Ukkonen's construction, with constant-time extensions.

The longest common extension of two places is the depth of the lowest common
ancestor of their leaves: the least depth on the tour of the tree between them.
Of the Euler tour only what lies between neighbouring leaves matters, so one
depth is kept for each such step; a table of least values over powers of two
answers any pair in two reads.
"""

from __future__ import annotations

import numpy as np

END = -1  # closes a sequence; smaller than every symbol in either order


class SuffixTree:
    """Tree of all suffixes of ``symbols`` (integers of 0 or more), built from left to right."""

    def __init__(self, symbols: list[int]):
        s = [*symbols, END]
        self.n = len(symbols)
        stop = len(s)
        first, last, link, suffix = [0], [0], [0], [-1]  # edge into a node as s[first:last]; leaves reach the end
        kids: list = [{}]
        node = edge = length = waiting = 0
        for i, c in enumerate(s):
            waiting += 1
            fresh = 0  # inner node made in this step that has no link yet
            while waiting:
                if not length:
                    edge = i
                kid = kids[node].get(s[edge])
                if kid is None:
                    kids[node][s[edge]] = len(first)
                    if fresh:
                        link[fresh] = node
                        fresh = 0
                else:
                    span = last[kid] - first[kid]
                    if length >= span:
                        node, edge, length = kid, edge + span, length - span
                        continue
                    at = first[kid] + length
                    if s[at] == c:
                        length += 1
                        if fresh:
                            link[fresh] = node
                        break
                    inner = len(first)
                    kids[node][s[edge]] = inner
                    first.append(first[kid])
                    last.append(at)
                    link.append(0)
                    suffix.append(-1)
                    kids.append({s[at]: kid, c: inner + 1})
                    first[kid] = at
                    if fresh:
                        link[fresh] = inner
                    fresh = inner
                first.append(i)
                last.append(stop)
                link.append(0)
                suffix.append(i - waiting + 1)
                kids.append(None)
                waiting -= 1
                if node:
                    node = link[node]
                elif length:
                    length -= 1
                    edge = i - waiting + 1
        self._edges = first, last, suffix, kids
        order, low = self._tour(False)
        self.rank = np.empty(self.n + 1, dtype=np.int64)
        self.rank[order] = np.arange(self.n + 1)
        levels = [np.array(low, dtype=np.int32)]
        while (half := 1 << (len(levels) - 1)) * 2 <= len(low):
            below = levels[-1]
            levels.append(np.minimum(below[:len(below) - half], below[half:]))
        self._least = levels

    def _tour(self, falling: bool) -> tuple[list[int], list[int]]:
        """Suffixes in the order of the symbols (or the reverse one), and the least depth before each on the tour."""
        first, last, suffix, kids = self._edges
        order, low, lowest = [], [], 0
        nodes, depths = [0], [0]  # a node to visit, and its parent's depth
        while nodes:
            node, above = nodes.pop(), depths.pop()
            lowest = min(lowest, above)
            below = kids[node]
            if below is None:
                order.append(suffix[node])
                low.append(lowest)
                lowest = self.n + 1
                continue
            depth = above + last[node] - first[node]
            symbols = sorted(below, reverse=not falling)
            if falling and symbols[0] == END:
                symbols.append(symbols.pop(0))
            nodes += [below[c] for c in symbols]
            depths += [depth] * len(symbols)
        return order, low

    def falling_rank(self) -> np.ndarray:
        """Ranks of the suffixes when larger symbols come first."""
        order, _ = self._tour(True)
        out = np.empty(self.n + 1, dtype=np.int64)
        out[order] = np.arange(self.n + 1)
        return out

    def extensions(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Lengths of the longest common prefixes of the suffixes at ``a`` and ``b`` (different places, at most n)."""
        x, y = self.rank[a], self.rank[b]
        x, y = np.minimum(x, y) + 1, np.maximum(x, y) + 1
        level = np.frexp((y - x).astype(np.float64))[1] - 1
        out = np.zeros(len(x), dtype=np.int64)
        for k in np.unique(level):
            at = level == k
            table = self._least[k]
            out[at] = np.minimum(table[x[at]], table[y[at] - (1 << int(k))])
        return out


def lyndon_ends(rank: np.ndarray) -> np.ndarray:
    """End of the longest Lyndon word that starts at each place: the next place with a smaller suffix."""
    order = rank.tolist()
    n = len(order) - 1
    ends = [n] * (n + 1)
    for i in range(n - 1, -1, -1):
        j = i + 1
        while order[j] > order[i]:
            j = ends[j]
        ends[i] = j
    return np.array(ends[:n], dtype=np.int64)


def runs(symbols: list[int]) -> np.ndarray:
    """Every run (start, length, period) of a sequence: maximal, with its smallest period twice or more; by start, period.

    A run holds, for one of the two symbol orders, the longest Lyndon word at
    one of its places, as long as its period; so the words of both orders,
    extended to either side, give all runs.
    """
    n = len(symbols)
    if n < 2:
        return np.zeros((0, 3), dtype=np.int64)
    ahead, back = SuffixTree(symbols), SuffixTree(symbols[::-1])
    start = np.tile(np.arange(n), 2)
    end = np.concatenate([lyndon_ends(ahead.rank), lyndon_ends(ahead.falling_rank())])
    period = end - start
    right = end + ahead.extensions(start, end)
    left = start - back.extensions(n - start, n - end)
    found = np.stack([left, right - left, period], axis=1)[right - left >= 2 * period]
    found = np.unique(found, axis=0) if len(found) else found
    return found[np.lexsort((found[:, 2], found[:, 0]))]
