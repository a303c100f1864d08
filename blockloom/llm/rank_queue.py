"""Byte-pair merging by a rank queue under a hierarchical bitmap.

All pre-tokens of a batch form one linked list (with barriers between them).
``cur[i]`` is the merge rank of the pair that starts at position ``i``.  Each
rank owns a bucket of positions; a bitmap of three levels marks the ranks whose
bucket isn't empty, and find-first-set picks the lowest.  A bucket is taken as a
whole: entries whose ``cur`` has changed meanwhile are stale and skipped, the
rest merge together, left to right where two of them overlap.  Work is linear in
the number of merges, however long a pre-token is.
"""

from __future__ import annotations

import numpy as np


class Bitmap:
    """Set of small integers with find-first-set; three levels of 64-bit words."""

    def __init__(self, size: int):
        self.low = [0] * ((size >> 6) + 1)
        self.mid = [0] * ((size >> 12) + 1)
        self.top = 0

    def add(self, x: int) -> None:
        a, b = x >> 6, x >> 12
        self.low[a] |= 1 << (x & 63)
        self.mid[b] |= 1 << (a & 63)
        self.top |= 1 << b

    def pop(self) -> int:
        """Remove and return the least member; -1 if there is none."""
        if not self.top:
            return -1
        b = (self.top & -self.top).bit_length() - 1
        m = self.mid[b]
        a = b << 6 | (m & -m).bit_length() - 1
        w = self.low[a]
        bit = w & -w
        self.low[a] = w ^ bit
        if not self.low[a]:
            self.mid[b] = m ^ (1 << (a & 63))
            if not self.mid[b]:
                self.top ^= 1 << b
        return a << 6 | bit.bit_length() - 1


class Merges:
    """Pairs of symbol ids with their merge rank and the id of the merged symbol."""

    def __init__(self, left: np.ndarray, right: np.ndarray, rank: np.ndarray, merged_of_rank: np.ndarray):
        keys = left.astype(np.uint64) << np.uint64(32) | right.astype(np.uint64)
        self.bits = max(4, int(len(keys) * 4).bit_length())
        self.mask = (1 << self.bits) - 1
        self.slot_key = np.full(1 << self.bits, np.iinfo(np.uint64).max, np.uint64)
        self.slot_rank = np.full(1 << self.bits, -1, np.int32)
        at, todo = self._hash(keys), np.arange(len(keys))
        while len(todo):  # open addressing: the first comer takes a slot, the others step on
            free = self.slot_rank[at[todo]] < 0
            _, first = np.unique(at[todo][free], return_index=True)
            won = todo[free][first]
            self.slot_key[at[won]], self.slot_rank[at[won]] = keys[won], rank[won]
            todo = np.setdiff1d(todo, won, assume_unique=True)
            at[todo] = at[todo] + 1 & self.mask
        self.merged = merged_of_rank.astype(np.int32)
        self.size = len(self.merged)

    def _hash(self, keys: np.ndarray) -> np.ndarray:
        return (keys * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(64 - self.bits)).astype(np.int64)

    def ranks(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Rank of each pair, -1 where the pair doesn't merge."""
        keys = left.astype(np.uint64) << np.uint64(32) | right.astype(np.uint64)
        at = self._hash(keys)
        found = self.slot_rank[at]
        wrong = np.flatnonzero((found >= 0) & (self.slot_key[at] != keys))
        while len(wrong):
            at[wrong] = at[wrong] + 1 & self.mask
            found[wrong] = self.slot_rank[at[wrong]]
            wrong = wrong[(found[wrong] >= 0) & (self.slot_key[at[wrong]] != keys[wrong])]
        return found


def greedy(pos: np.ndarray, nxt: np.ndarray) -> np.ndarray:
    """Of sorted positions, those that merge when pairs are taken left to right without overlap."""
    touches = nxt[pos[:-1]] == pos[1:]
    if not touches.any():
        return pos
    taken, last = [True], True
    for t in touches.tolist():
        last = not (t and last)
        taken.append(last)
    return pos[np.array(taken)]


def merge(tok: np.ndarray, starts: np.ndarray, merges: Merges) -> tuple[np.ndarray, np.ndarray]:
    """Merge the symbols ``tok`` inside the segments that begin at ``starts``.

    Returns the final symbols and the position at which each of them begins.
    """
    n = len(tok)
    if n == 0:
        return tok.astype(np.int32), np.zeros(0, np.int64)
    tok = np.append(tok.astype(np.int32), 0)  # one sentinel
    nxt, prv = np.arange(1, n + 2, dtype=np.int32), np.arange(-1, n, dtype=np.int32)
    nxt[np.append(starts[1:], n) - 1] = n
    prv[starts] = n
    cur = np.full(n + 1, -1, np.int32)
    alive = np.ones(n, bool)
    inner = np.flatnonzero(nxt[:n] < n).astype(np.int32)
    cur[inner] = merges.ranks(tok[inner], tok[nxt[inner]])
    queue, buckets = Bitmap(merges.size), {}

    def push(pos: np.ndarray, rank: np.ndarray) -> None:
        if len(pos) == 0:
            return
        order = np.argsort(rank, kind="stable")
        pos, rank = pos[order], rank[order]
        cuts = np.flatnonzero(rank[1:] != rank[:-1]) + 1
        at = [0, *cuts.tolist(), len(pos)]
        for r, a, b in zip(rank[[0, *cuts.tolist()]].tolist(), at, at[1:]):
            if r in buckets:
                buckets[r].append(pos[a:b])
            else:
                buckets[r] = [pos[a:b]]
                queue.add(r)

    live = inner[cur[inner] >= 0]
    push(live, cur[live])
    while (r := queue.pop()) >= 0:
        entries = buckets.pop(r)
        pos = entries[0] if len(entries) == 1 else np.concatenate(entries)
        pos = pos[cur[pos] == r]  # the others are stale
        if len(pos) == 0:
            continue
        if len(pos) > 1:
            pos = greedy(np.unique(pos), nxt)
        gone = nxt[pos]
        after = nxt[gone]
        tok[pos] = merges.merged[r]
        alive[gone] = False
        cur[gone] = -1
        nxt[pos] = after
        inside = after < n
        prv[after[inside]] = pos[inside]
        before = prv[pos]
        again = np.concatenate([pos, before[before < n]])
        if len(again) > 1:
            again = np.unique(again)
        follow = nxt[again]
        rank = merges.ranks(tok[again], tok[follow])
        rank[follow >= n] = -1
        cur[again] = rank
        good = rank >= 0
        push(again[good], rank[good])
    at = np.flatnonzero(alive)
    return tok[at], at
