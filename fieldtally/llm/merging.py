"""Front-coded sorted runs of byte strings, and their merge by a loser tree that never
compares a known prefix again."""

from __future__ import annotations

import numpy as np


def front_code(strings: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, bytes]:
    """Of sorted strings (rows of bytes, zero after their size): how many bytes each
    shares with the one before, and the rest of all in a row."""
    shared = np.zeros(len(sizes), np.int64)
    if len(sizes) > 1:
        differ = strings[1:] != strings[:-1]
        some = differ.any(axis=1)
        shared[1:] = np.where(some, differ.argmax(axis=1), strings.shape[1])
        shared[1:] = np.minimum(shared[1:], np.minimum(sizes[1:], sizes[:-1]))
    place = np.arange(strings.shape[1])
    return shared, strings[(place >= shared[:, None]) & (place < sizes[:, None])].tobytes()


class Run:
    """A front-coded run, read from its start."""

    def __init__(self, shared: np.ndarray, sizes: np.ndarray, rest: bytes) -> None:
        self.shared, self.rest = shared.tolist(), rest
        self.ends = np.cumsum(sizes - shared).tolist()
        self.at, self.string = -1, b""

    def step(self) -> int:
        """Go to the next string; bytes shared with the one before, -1 at the end."""
        self.at += 1
        at = self.at
        if at == len(self.shared):
            return -1
        shared = self.shared[at]
        self.string = self.string[:shared] + self.rest[self.ends[at - 1] if at else 0 : self.ends[at]]
        return shared


def _common(a: bytes, b: bytes, known: int) -> int:
    """Length of the common prefix, of which ``known`` bytes need no look."""
    most = min(len(a), len(b))
    step = 16
    while known < most:
        if a[known : known + step] == b[known : known + step]:
            known = min(known + step, most)
        elif step == 1:
            return known
        else:
            step = max(1, step // 4)
    return most


def merge(runs: list[Run]) -> tuple[list[int], list[int], list[bytes]]:
    """The runs' numbers in the order of the merged strings, how many bytes each string
    shares with the one before, and the strings.

    Every head knows how much it shares with the last winner.  Of two heads, the one that shares
    more is smaller, and only if they share equally much are they compared, from there
    on; the loser then knows what it shares with the one that beat it.
    """
    leaves = 1
    while leaves < max(1, len(runs)):
        leaves *= 2
    known = [run.step() for run in runs] + [-1] * (leaves - len(runs))
    loser = [-1] * (2 * leaves)

    def better(a: int, b: int) -> tuple[int, int]:
        """Winner and loser of two heads; run numbers settle ties."""
        ka, kb = known[a], known[b]
        if kb < 0 or ka > kb:
            return a, b
        if ka < 0 or kb > ka:
            return b, a
        x, y = runs[a].string, runs[b].string
        same = _common(x, y, ka)
        if same == len(x) == len(y):
            win, lose = (a, b) if a < b else (b, a)
        elif same == len(x) or (same < len(y) and x[same] < y[same]):
            win, lose = a, b
        else:
            win, lose = b, a
        known[lose] = same
        return win, lose

    winner = [0] * (2 * leaves)
    for leaf in range(leaves):
        winner[leaves + leaf] = leaf
    for node in range(leaves - 1, 0, -1):
        winner[node], loser[node] = better(winner[2 * node], winner[2 * node + 1])
    top = winner[1]
    order, shared, strings = [], [], []
    while known[top] >= 0:
        order.append(top)
        shared.append(known[top])
        strings.append(runs[top].string)
        known[top] = runs[top].step()
        node = (top + leaves) >> 1
        while node:
            other = loser[node]
            ka, kb = known[top], known[other]
            # Most matches are settled by what is known.
            if ka <= kb:
                if ka < kb:
                    top, loser[node] = other, top
                elif ka >= 0:
                    top, loser[node] = better(top, other)
            node >>= 1
    return order, shared, strings
