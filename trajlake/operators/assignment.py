"""One-to-one assignment: of small groups by a matrix, of large sparse ones by an auction over their pairs."""

from __future__ import annotations

import math

import numpy as np


def assign(cost: np.ndarray) -> list[tuple[int, int]]:
    """Pairs (row, column) of finite cost: as many as possible, of these the smallest sum (shortest augmenting paths with
    potentials). Infinite cost forbids a pair."""
    rows, columns = cost.shape
    if not rows or not columns:
        return []
    if rows > columns:
        return sorted((r, c) for c, r in assign(cost.T))
    finite = np.isfinite(cost)
    top = float(np.abs(cost[finite]).sum() + 1) if finite.any() else 1.0
    cost = np.where(finite, cost, top)
    u, v, owner = np.zeros(rows + 1), np.zeros(columns + 1), np.full(columns + 1, rows)
    for row in range(rows):
        owner[columns], at = row, columns
        least, before, done = np.full(columns, np.inf), np.full(columns, columns), np.zeros(columns + 1, bool)
        while owner[at] != rows:
            done[at] = True
            slack = cost[owner[at]] - u[owner[at]] - v[:columns]
            better = ~done[:columns] & (slack < least)
            least[better], before[better] = slack[better], at
            open_ = np.where(done[:columns], np.inf, least)
            to = int(open_.argmin())
            step = open_[to]
            u[owner[done]] += step
            v[done] -= step
            least[~done[:columns]] -= step
            at = to
        while at != columns:
            owner[at], at = owner[before[at]], before[at]
    return sorted((int(owner[c]), c) for c in range(columns) if owner[c] < rows and finite[owner[c], c])


def assign_lists(cost: list[list[float]]) -> list[tuple[int, int]]:
    """assign() of costs in lists, with the same steps and results: faster for matrices of some dozens of numbers."""
    rows, columns = len(cost), len(cost[0]) if cost else 0
    if not rows or not columns:
        return []
    if rows > columns:
        return sorted((r, c) for c, r in assign_lists(list(map(list, zip(*cost, strict=True)))))
    finite = [[math.isfinite(x) for x in line] for line in cost]
    if not all(map(all, finite)):
        there = [x for line in cost for x in line if math.isfinite(x)]
        top = float(np.abs(there).sum() + 1) if there else 1.0
        cost = [[x if math.isfinite(x) else top for x in line] for line in cost]
    u, v, owner = [0.0] * (rows + 1), [0.0] * (columns + 1), [rows] * (columns + 1)
    for row in range(rows):
        owner[columns], at = row, columns
        least, before, done = [math.inf] * columns, [columns] * columns, [False] * (columns + 1)
        while owner[at] != rows:
            done[at] = True
            line, less, step, to = cost[owner[at]], u[owner[at]], math.inf, 0
            for c in range(columns):
                if not done[c]:
                    slack = line[c] - less - v[c]
                    if slack < least[c]:
                        least[c], before[c] = slack, at
                    if least[c] < step:
                        step, to = least[c], c
            for c in range(columns + 1):
                if done[c]:
                    u[owner[c]] += step
                    v[c] -= step
                elif c < columns:
                    least[c] -= step
            at = to
        while at != columns:
            owner[at], at = owner[before[at]], before[at]
    return sorted((owner[c], c) for c in range(columns) if owner[c] < rows and finite[owner[c]][c])


def best_pairs(left: np.ndarray, right: np.ndarray, gain: np.ndarray) -> np.ndarray:
    """Numbers of the pairs (left, right; whole gains of 0 or more) of a one-to-one choice with the largest sum: an auction.

    Memory is that of the pairs. Each end also has a partner of its own without gain, and these partners can have one
    another where the ends are a pair, so that all can be matched (twice the pairs). Whoever is free bids for its best
    partner as much as that is better than its second best, all at once; each takes its highest bid. Prices are kept
    from one size of the least raise to the next smaller one; with the last, less than one unit over all ends, the choice is best.
    """
    if not len(gain):
        return np.zeros(0, np.int64)
    (_, a), (_, b) = (np.unique(x, return_inverse=True) for x in (left, right))
    n, m = int(a.max()) + 1, int(b.max()) + 1
    bidder = np.concatenate([a, np.arange(n), n + np.arange(m), n + b])
    item = np.concatenate([b, m + np.arange(n), np.arange(m), m + a])
    value = np.concatenate([gain.astype(np.int64) * (n + m + 1), np.zeros(n + m + len(gain), np.int64)])
    pair = np.concatenate([np.arange(len(gain)), np.full(n + m + len(gain), -1)])
    order = np.argsort(bidder, kind="stable")
    item, value, pair = item[order], value[order], pair[order]
    first = np.searchsorted(bidder[order], np.arange(n + m + 1))
    price, least = np.zeros(n + m, np.int64), max(1, int(value.max()) // 4)
    while True:
        owner, has = np.full(n + m, -1), np.full(n + m, -1)  # an item's bidder, a bidder's offer
        free = np.arange(n + m)
        while len(free):
            size = first[free + 1] - first[free]
            begin = np.cumsum(size) - size
            edge = np.repeat(first[free] - begin, size) + np.arange(size.sum())
            profit = value[edge] - price[item[edge]]
            best = np.maximum.reduceat(profit, begin)
            is_best = profit == np.repeat(best, size)
            chosen = np.minimum.reduceat(np.where(is_best, np.arange(len(edge)), len(edge)), begin)
            profit[chosen] = np.iinfo(np.int64).min
            bid = price[item[edge[chosen]]] + best - np.maximum.reduceat(profit, begin) + least
            wanted = item[edge[chosen]]
            ranked = np.lexsort((bid, wanted))
            top = ranked[np.append(wanted[ranked][1:] != wanted[ranked][:-1], True)]
            at, winner = wanted[top], free[top]
            out = owner[at]
            price[at], owner[at], has[winner] = bid[top], winner, edge[chosen[top]]
            has[out[out >= 0]] = -1
            lost = np.ones(len(free), bool)
            lost[top] = False
            free = np.concatenate([free[lost], out[out >= 0]])
        if least == 1:
            return np.sort(pair[has[:n]][pair[has[:n]] >= 0])
        least = max(1, least // 5)
