"""Cutting stock by column generation.

The linear program asks for the fewest sequences that hold the demanded number
of pieces of each size class.  Columns are patterns (pieces of each class that
fit into one sequence together); a knapsack dynamic program finds the pattern of
the highest value under the current prices, and the simplex method takes it in.
The solution is rounded down, and what remains (fewer sequences than there are
classes, whatever the corpus) is packed first-fit decreasing into patterns too.
"""

from __future__ import annotations

import numpy as np


def best_pattern(prices: np.ndarray, sizes: np.ndarray, capacity: int) -> tuple[float, np.ndarray]:
    """The pattern of the highest total price within ``capacity``, and that price."""
    by_size, item = np.zeros(capacity + 1), np.full(capacity + 1, -1)
    by_size[sizes], item[sizes] = np.maximum(prices, 0), np.arange(len(sizes))
    value, choice = np.zeros(capacity + 1), np.zeros(capacity + 1, np.int64)
    for c in range(1, capacity + 1):
        total = value[c - 1 :: -1][:c] + by_size[1 : c + 1]  # a piece of size s on top of c - s
        s = int(total.argmax())
        value[c], choice[c] = total[s], s + 1
        if value[c - 1] >= value[c]:
            value[c], choice[c] = value[c - 1], 0
    counts, c = np.zeros(len(sizes)), capacity
    while c > 0:
        s = choice[c]
        if s == 0:
            c -= 1
        else:
            if item[s] >= 0:
                counts[item[s]] += 1
            c -= s
    return float(value[capacity]), counts


def relax(sizes: np.ndarray, demand: np.ndarray, capacity: int, tolerance: float = 1e-3, most_rounds: int = 20_000) -> tuple[np.ndarray, np.ndarray]:
    """Patterns (rows) and their fractional numbers.

    Stops when the bound (value of the prices over the best pattern's value) is
    within ``tolerance`` of the solution; any basis on the way is feasible.
    """
    m = len(sizes)
    patterns = np.diag((capacity // sizes).astype(float))
    inverse = np.diag(1 / np.diag(patterns))
    x = inverse @ demand
    for _ in range(most_rounds):
        prices = inverse.sum(axis=0)
        value, column = best_pattern(prices, sizes, capacity)
        if value <= 1 + tolerance:
            break
        step = inverse @ column
        ratios = np.where(step > 1e-9, x / np.where(step > 1e-9, step, 1), np.inf)
        out = int(ratios.argmin())
        theta = ratios[out]
        x = np.maximum(x - theta * step, 0)
        x[out] = theta
        row = inverse[out] / step[out]
        inverse -= np.outer(step, row)
        inverse[out] = row
        patterns[:, out] = column
    return patterns.T, x


def first_fit(sizes: np.ndarray, left: np.ndarray, capacity: int) -> list[np.ndarray]:
    """Patterns for the few pieces left, largest first."""
    bins, room = [], []
    for k in np.argsort(-sizes):
        for _ in range(int(left[k])):
            at = next((i for i, r in enumerate(room) if r >= sizes[k]), None)
            if at is None:
                bins.append(np.zeros(len(sizes), np.int64))
                room.append(capacity)
                at = len(bins) - 1
            bins[at][k] += 1
            room[at] -= sizes[k]
    return bins


def solve(sizes: np.ndarray, demand: np.ndarray, capacity: int) -> list[tuple[np.ndarray, int]]:
    """Patterns and how often each is used; together they hold the demand exactly."""
    sizes, demand = np.asarray(sizes, np.int64), np.asarray(demand, np.int64)
    if len(sizes) == 0:
        return []
    patterns, x = relax(sizes, demand.astype(float), capacity)
    plan, left = [], demand.copy()
    for p, n in zip(patterns.round().astype(np.int64), np.floor(x + 1e-7).astype(np.int64)):
        n = min([int(n), *(left[p > 0] // p[p > 0]).tolist()])
        if n > 0 and p.any():
            plan.append((p, n))
            left -= n * p
    return plan + [(p, 1) for p in first_fit(sizes, left, capacity)]
