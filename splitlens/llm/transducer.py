"""Minimal acyclic transducers: sorted byte strings to their ordinals and back.

States with the same accepted rests are one state, so common endings are stored once as well as
common beginnings. Each transition carries the number of strings that come before those that
take it; their sum along a path is the string's ordinal. Built in one pass over the sorted
strings: when a string leaves the path of the one before, the states below the fork are
complete and are looked up in a register of complete states.
"""

from __future__ import annotations

from collections.abc import Iterable

import numpy as np


class _Node:
    __slots__ = ("final", "edges")

    def __init__(self):
        self.final, self.edges = False, {}


class Transducer:
    """Transitions sorted by ``state * 256 + byte``: ``keys``, with ``target`` and ``skip`` (strings
    before); ``final`` per state; ``start`` is the first state."""

    def __init__(self, keys: np.ndarray, target: np.ndarray, skip: np.ndarray, final: np.ndarray, start: int, size: int):
        self.keys, self.target, self.skip, self.final, self.start, self.size = keys, target, skip, final, start, size

    @property
    def nbytes(self) -> int:
        return self.keys.nbytes + self.target.nbytes + self.skip.nbytes + self.final.nbytes

    def ordinals(self, data: np.ndarray, offs: np.ndarray, start: np.ndarray | None = None) -> np.ndarray:
        """Ordinal of each string ``data[offs[i]:offs[i + 1]]``, -1 for those not accepted. All
        strings take a step at a time, those that have ended or fallen off drop out. ``start``
        gives every string's first state."""
        n = len(offs) - 1
        out = np.full(n, -1, np.int64)
        if not len(self.final):
            return out
        state = np.full(n, self.start, np.int64) if start is None else start.astype(np.int64)
        total, left, live, k = np.zeros(n, np.int64), np.diff(offs), np.arange(n), 0
        while len(live):
            done = left[live] == k
            ended = live[done]
            out[ended] = np.where(self.final[state[ended]], total[ended], -1)
            live = live[~done]
            if not len(self.keys):
                break
            want = state[live] * 256 + data[offs[:-1][live] + k]
            at = np.minimum(np.searchsorted(self.keys, want), len(self.keys) - 1)
            found = self.keys[at] == want
            live, at = live[found], at[found]
            state[live] = self.target[at]
            total[live] += self.skip[at]
            k += 1
        return out

    def string(self, ordinal: int, start: int | None = None) -> bytes:
        """The string with this ordinal among those accepted from ``start``."""
        state, out = self.start if start is None else start, bytearray()
        while True:
            if self.final[state]:
                if ordinal == 0:
                    return bytes(out)
            lo, hi = np.searchsorted(self.keys, [state * 256, state * 256 + 256])
            at = lo + int(np.searchsorted(self.skip[lo:hi], ordinal, side="right")) - 1
            if at < lo:
                raise IndexError("no such ordinal")
            out.append(int(self.keys[at]) & 255)
            ordinal -= int(self.skip[at])
            state = int(self.target[at])


def build(strings: Iterable[bytes]) -> Transducer:
    """The transducer of strictly ascending byte strings."""
    register: dict = {}
    keys, target, skip, final, counts = [], [], [], [], []

    def number(node: _Node) -> int:
        """The number of a complete state, an equal one's if there is one."""
        sign = (node.final, tuple(node.edges.items()))
        state = register.get(sign)
        if state is None:
            state = register[sign] = len(final)
            final.append(node.final)
            total = int(node.final)
            for byte, to in node.edges.items():
                keys.append(state * 256 + byte)
                target.append(to)
                skip.append(total)
                total += counts[to]
            counts.append(total)
        return state

    path, before, size = [_Node()], None, 0

    def close(depth: int) -> None:
        while len(path) - 1 > depth:
            node = path.pop()
            path[-1].edges[before[len(path) - 1]] = number(node)

    for s in strings:
        if before is not None and s <= before:
            raise ValueError("strings must ascend")
        common = 0
        if before is not None:
            common = next((i for i, (a, b) in enumerate(zip(before, s)) if a != b), min(len(before), len(s)))
            close(common)
        path.extend(_Node() for _ in range(len(s) - common))
        path[-1].final = True
        before, size = s, size + 1
    if before is not None:
        close(0)
    start = number(path[0])
    order = np.argsort(np.array(keys, np.int64), kind="stable")
    take = [np.array(x, np.int64)[order] for x in (keys, target, skip)]
    return Transducer(*take, np.array(final, bool), start, size)


def joined(parts: list[Transducer]) -> tuple[Transducer, np.ndarray]:
    """Transducers side by side in one set of arrays, and each one's start state there."""
    shift = np.cumsum([0, *(len(p.final) for p in parts)]).astype(np.int64)
    none = np.zeros(0, np.int64)
    one = Transducer(np.concatenate([none, *(p.keys + 256 * s for p, s in zip(parts, shift))]),
                     np.concatenate([none, *(p.target + s for p, s in zip(parts, shift))]),
                     np.concatenate([none, *(p.skip for p in parts)]),
                     np.concatenate([np.zeros(0, bool), *(p.final for p in parts)]), 0, sum(p.size for p in parts))
    return one, np.array([p.start + s for p, s in zip(parts, shift)], np.int64)
