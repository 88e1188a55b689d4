"""Suffix automaton over word sequences of several documents."""

from __future__ import annotations


class SuffixAutomaton:
    """Automaton of all word runs of the added passages.

    Every state knows the smallest document that contains its runs, so a
    stream of words can be matched against earlier documents only.
    """

    def __init__(self):
        self.step: list[dict] = [{}]
        self.link = [-1]
        self.length = [0]
        self.owner = [float("inf")]

    def _new(self, step: dict, length: int, owner) -> int:
        self.step.append(step)
        self.link.append(0)
        self.length.append(length)
        self.owner.append(owner)
        return len(self.length) - 1

    def _split(self, parent: int, word, target: int) -> int:
        """State for the runs of ``target`` that are one word longer than ``parent``'s."""
        if self.length[target] == self.length[parent] + 1:
            return target
        copy = self._new(dict(self.step[target]), self.length[parent] + 1, float("inf"))
        self.link[copy] = self.link[target]
        self.link[target] = copy
        while parent >= 0 and self.step[parent].get(word) == target:
            self.step[parent][word] = copy
            parent = self.link[parent]
        return copy

    def add(self, words, owner) -> None:
        """Add one passage of document ``owner``."""
        last = 0
        step, link, length = self.step, self.link, self.length
        for word in words:
            known = step[last].get(word)
            if known is not None:
                last = self._split(last, word, known)
            else:
                new = self._new({}, length[last] + 1, float("inf"))
                at = last
                while at >= 0 and word not in step[at]:
                    step[at][word] = new
                    at = link[at]
                link[new] = 0 if at < 0 else self._split(at, word, step[at][word])
                last = new
            if owner < self.owner[last]:
                self.owner[last] = owner

    def finish(self) -> None:
        """Hand the smallest owner of every state on to the states of its suffixes."""
        for state in sorted(range(1, len(self.length)), key=self.length.__getitem__, reverse=True):
            up = self.link[state]
            if self.owner[state] < self.owner[up]:
                self.owner[up] = self.owner[state]

    def spans(self, words, owner, least: int) -> list[tuple[int, int]]:
        """Maximal spans covered by runs of ``least`` words that a smaller owner holds too."""
        step, link, length, owners = self.step, self.link, self.length, self.owner
        out: list[tuple[int, int]] = []
        state = matched = 0
        for end, word in enumerate(words, 1):
            while state and word not in step[state]:
                state = link[state]
                matched = length[state]
            nxt = step[state].get(word)
            if nxt is None:
                matched = 0
                continue
            state = nxt
            matched += 1
            if matched >= least:
                # The matching statistic beyond ``least`` is not needed: fall
                # back to the state of the last ``least`` words.
                while length[link[state]] >= least:
                    state = link[state]
                matched = min(matched, length[state])
                if owners[state] < owner:
                    if out and end - least <= out[-1][1]:
                        out[-1] = (out[-1][0], end)
                    else:
                        out.append((end - least, end))
        return out
