"""Alignment of sequences: a wavefront aligner and a star of pairwise alignments."""

from __future__ import annotations

from collections.abc import Callable, Sequence


def wavefront(a: Sequence, b: Sequence, equal: Callable = lambda x, y: x == y, gap: int = 1, mismatch: int = 1) -> list[tuple[int | None, int | None]]:
    """Cheapest global alignment as pairs of positions (None: a gap), by the published wavefront recursion.

    ``front[s][k]`` is the furthest position in ``a`` on diagonal ``k`` (position in
    ``a`` minus position in ``b``) at cost ``s``.  On the way back a mismatch is preferred to an
    element of ``a`` alone, and that to an element of ``b`` alone.
    """
    n, m = len(a), len(b)
    fronts: dict[int, dict[int, int]] = {}
    s = 0
    while True:
        best: dict[int, int] = {0: 0} if s == 0 else {}
        for k, i in fronts.get(s - mismatch, {}).items():
            if i < n and i - k < m:
                best[k] = max(best.get(k, -1), i + 1)
        for k, i in fronts.get(s - gap, {}).items():
            if i < n:
                best[k + 1] = max(best.get(k + 1, -1), i + 1)
            if i - k < m:
                best[k - 1] = max(best.get(k - 1, -1), i)
        for k, i in best.items():
            while i < n and i - k < m and equal(a[i], b[i - k]):
                i += 1
            best[k] = i
        if best:
            fronts[s] = best
        if best.get(n - m, -1) >= n:
            break
        s += 1
        if s > gap * (n + m):
            raise RuntimeError("no alignment")
        reachable = [f for f in (s - gap, s - mismatch) if f in fronts]
        if not reachable:  # nothing ends at this cost: go on to the next that something reaches
            s = min([f + c for f in fronts for c in (gap, mismatch) if f + c >= s])
    pairs, k, i = [], n - m, n
    while i > 0 or i - k > 0:
        down = fronts.get(s - mismatch, {}).get(k, -2) + 1
        right = fronts.get(s - gap, {}).get(k - 1, -2) + 1
        left = fronts.get(s - gap, {}).get(k + 1, -2)
        start = max(x for x in (down if down <= n and down - k <= m else -2, right if right <= n else -2, left if left - k <= m else -2, 0 if s == 0 and k == 0 else -2))
        while i > start:  # matches
            i -= 1
            pairs.append((i, i - k))
        if s == 0:
            break
        if start == down and down > 0 and down - k > 0:
            i, s = i - 1, s - mismatch
            pairs.append((i, i - k))
        elif start == right and right > 0:
            i, s = i - 1, s - gap
            pairs.append((i, None))
            k -= 1
        else:
            pairs.append((None, i - k - 1))
            s, k = s - gap, k + 1
    return pairs[::-1]


def star(strings: list[str], gap: int = 1, mismatch: int = 1) -> list[str]:
    """Multiple alignment: every string is aligned to the longest, and columns that its rows insert are shared.

    All rows come out equally long; without gaps each is its input.
    """
    if not strings:
        return []
    centre = max(range(len(strings)), key=lambda i: (len(strings[i]), -i))
    base = strings[centre]
    made = [wavefront(base, x, gap=gap, mismatch=mismatch) for x in strings]
    wide = [0] * (len(base) + 1)  # inserted columns before each position of the centre
    for pairs in made:
        run, at = 0, 0
        for i, _ in pairs:
            if i is None:
                run += 1
                wide[at] = max(wide[at], run)
            else:
                run, at = 0, i + 1
    out = []
    for x, pairs in zip(strings, made):
        inserts, under, at = [[] for _ in wide], ["-"] * len(base), 0
        for i, j in pairs:
            if i is None:
                inserts[at].append(x[j])
            else:
                at = i + 1
                under[i] = x[j] if j is not None else "-"
        row = []
        for p in range(len(base) + 1):
            row.append("".join(inserts[p]).ljust(wide[p], "-"))
            if p < len(base):
                row.append(under[p])
        out.append("".join(row))
    return out
