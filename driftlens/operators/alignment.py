"""Ordered alignment of two sequences by longest common blocks, in near-linear time.

The alignment is defined by recursion: take the longest block that both sides
share (of several the one that begins first in the old side, then first in the
new side), then align what lies before it and what lies behind it. Here the
recursion isn't followed a block at a time:

* Items become numbers, and windows of 1, 2, 4, ... items get ranks: two windows
  of one length are equal just if their ranks are. A window of any length is two
  overlapping windows of a power of two. Ranks come from sorting pairs of ranks,
  so no hash can collide.
* The length of a range's longest block is found by bisection, for a common
  window of n items contains one of n - 1.
* Blocks of that length are taken in one sweep from left to right: behind a
  block, the next one by the rule is the first window of the old side that
  occurs at or behind the block's end in the new side. Before a block lie only
  shorter ones, so a range is done again for each length that occurs, of which
  n items have at most the root of 2 n; nearly all have few.

Ranges of few items are aligned by a table of run lengths.
"""

from __future__ import annotations

import numpy as np

#: Ranges of up to this many pairs of items are aligned by a table.
SMALL = 4096


def numbered(a: list, b: list) -> tuple[np.ndarray, np.ndarray]:
    """Equal items as equal numbers."""
    number: dict = {}
    both = np.fromiter((number.setdefault(x, len(number)) for side in (a, b) for x in side), np.int64, len(a) + len(b))
    return both[: len(a)], both[len(a) :]


class Windows:
    """Ranks of the windows of two sequences laid end to end; a window across both is never asked for."""

    def __init__(self, a: np.ndarray, b: np.ndarray):
        self.shift = len(a)
        self.ranks = [np.concatenate([a, b])]

    def level(self, k: int) -> np.ndarray:
        """Ranks of windows of 2**k items."""
        while len(self.ranks) <= k:
            half, last = 1 << (len(self.ranks) - 1), self.ranks[-1]
            pairs = last[:-half] * (int(last.max(initial=0)) + 1) + last[half:]
            self.ranks.append(np.unique(pairs, return_inverse=True)[1].astype(np.int64))
        return self.ranks[k]

    def of(self, n: int, alo: int, ahi: int, blo: int, bhi: int) -> tuple[np.ndarray, np.ndarray]:
        """Numbers of the windows of n items within both ranges; equal windows have equal numbers."""
        k = n.bit_length() - 1
        rank, rest = self.level(k), n - (1 << k)
        top = int(rank.max(initial=0)) + 1

        def side(lo, hi):
            return rank[lo : hi - n + 1] * top + rank[lo + rest : hi - n + 1 + rest]

        return side(alo, ahi), side(blo + self.shift, bhi + self.shift)


def longest(w: Windows, alo: int, ahi: int, blo: int, bhi: int, most: int) -> int:
    """Length of the longest common block, ``most`` at most."""
    low, high = 0, min(most, ahi - alo, bhi - blo)
    while low < high:
        n = (low + high + 1) // 2
        x, y = w.of(n, alo, ahi, blo, bhi)
        if np.isin(x, y).any():
            low = n
        else:
            high = n - 1
    return low


def sweep(w: Windows, n: int, alo: int, ahi: int, blo: int, bhi: int) -> list[tuple[int, int]]:
    """Beginnings of the blocks of n items, from left to right, in ranges without a longer one."""
    x, y = w.of(n, alo, ahi, blo, bhi)
    order = np.argsort(y, kind="stable")
    sorted_y = y[order]
    first, last = np.searchsorted(sorted_y, x, "left"), np.searchsorted(sorted_y, x, "right")
    found, i, j = [], 0, 0
    for at in np.flatnonzero(last > first).tolist():
        if at < i:
            continue
        if j > len(y) - 1:
            break
        places = order[first[at] : last[at]]
        k = int(np.searchsorted(places, j))
        if k < len(places):
            found.append((alo + at, blo + int(places[k])))
            i, j = at + n, int(places[k]) + n
    return found


def small_block(a: list[int], b: list[int], alo: int, ahi: int, blo: int, bhi: int) -> tuple[int, int, int]:
    """The longest block of a small range by a table of run lengths: (length, beginnings)."""
    places: dict[int, list[int]] = {}
    for j in range(blo, bhi):
        places.setdefault(b[j], []).append(j)
    best, runs = (0, alo, blo), {}
    for i in range(alo, ahi):
        now = {}
        for j in places.get(a[i], ()):
            n = now[j] = runs.get(j - 1, 0) + 1
            if n > best[0]:
                best = (n, i - n + 1, j - n + 1)
        runs = now
    return best


def blocks(a: list, b: list) -> list[tuple[int, int, int]]:
    """(begin in a, begin in b, length) of the aligned blocks, in order."""
    x, y = numbered(a, b)
    w, out = Windows(x, y), []
    own_a, own_b = x.tolist(), y.tolist()
    todo = [(0, len(a), 0, len(b), min(len(a), len(b)))]
    while todo:
        alo, ahi, blo, bhi, most = todo.pop()
        if alo >= ahi or blo >= bhi or not most:
            continue
        if (ahi - alo) * (bhi - blo) <= SMALL:
            n, i, j = small_block(own_a, own_b, alo, ahi, blo, bhi)
            if n:
                out.append((i, j, n))
                todo += [(alo, i, blo, j, n), (i + n, ahi, j + n, bhi, n)]
            continue
        n = longest(w, alo, ahi, blo, bhi, most)
        if not n:
            continue
        i, j = alo, blo
        for p, q in sweep(w, n, alo, ahi, blo, bhi):
            out.append((p, q, n))
            todo.append((i, p, j, q, n - 1))
            i, j = p + n, q + n
        todo.append((i, ahi, j, bhi, n - 1))
    return sorted(out)


def edits(a: list | None, b: list | None) -> list[dict]:
    """What turns a into b, as (op, i1, i2, j1, j2) with op replace, delete or insert; unchanged ranges are left out."""
    a, b = (list(x) if x is not None else [] for x in (a, b))
    out, i, j = [], 0, 0
    for p, q, n in [*blocks(a, b), (len(a), len(b), 0)]:
        if i < p or j < q:
            op = "insert" if i == p else "delete" if j == q else "replace"
            out.append({"op": op, "i1": i, "i2": p, "j1": j, "j2": q})
        i, j = p + n, q + n
    return out


def applied(a: list, b: list, found: list[dict]) -> list:
    """The old side with the edits made: the new side, if the edits are right."""
    out, at = [], 0
    for e in found:
        out += a[at : e["i1"]] + b[e["j1"] : e["j2"]]
        at = e["i2"]
    return out + a[at:]
