"""Least-cost assignment by shortest augmenting paths."""

from __future__ import annotations

import numpy as np


def assign(cost: np.ndarray) -> np.ndarray:
    """The column of each row such that no column is taken twice and the sum of costs is least; n**3 steps for n rows.

    Rows whose cheapest columns differ take those. Among equal sums the first found is taken.
    """
    n = len(cost)
    cheapest = cost.argmin(axis=1)
    if len(np.unique(cheapest)) == n:
        return cheapest
    # Prices of rows and columns; owner of each column (n: a column that doesn't exist, from which paths start).
    row_price, column_price, owner = np.zeros(n), np.zeros(n), np.full(n + 1, -1)
    for row in range(n):
        owner[n], at = row, n
        reach, came, done = np.full(n, np.inf), np.full(n, n), np.zeros(n, bool)
        while owner[at] >= 0:
            if at < n:
                done[at] = True
            i = owner[at]
            step = cost[i] - row_price[i] - column_price
            better = ~done & (step < reach)
            reach[better], came[better] = step[better], at
            open_ = np.where(done, np.inf, reach)
            at = int(open_.argmin())
            least = open_[at]
            # Prices move so that the path stays free of charge.
            row_price[row] += least
            row_price[owner[:n][done]] += least
            column_price[done] -= least
            reach[~done] -= least
        while at != n:
            owner[at] = owner[came[at]]
            at = came[at]
    out = np.empty(n, int)
    out[owner[:n]] = np.arange(n)
    return out


def assign_many(costs: np.ndarray) -> np.ndarray:
    """assign() of each of many matrices (m, n, n), by the same steps for all at once."""
    m, n, _ = costs.shape
    out = costs.argmin(axis=2)
    hard = np.flatnonzero((np.diff(np.sort(out, axis=1), axis=1) == 0).any(axis=1))
    if len(hard):
        out[hard] = _paths(costs[hard])
    return out


def _paths(costs: np.ndarray) -> np.ndarray:
    m, n, _ = costs.shape
    row_price, column_price, owner = np.zeros((m, n)), np.zeros((m, n)), np.full((m, n + 1), -1)
    for row in range(n):
        owner[:, n] = row
        at, ended = np.full(m, n), np.full(m, n)
        reach, came, done = np.full((m, n), np.inf), np.full((m, n), n), np.zeros((m, n), bool)
        going = np.arange(m)
        while len(going):
            here = at[going]
            inside = here < n
            done[going[inside], here[inside]] = True
            i = owner[going, here]
            step = costs[going, i] - row_price[going, i][:, None] - column_price[going]
            closed = done[going]
            better = ~closed & (step < reach[going])
            reach[going] = np.where(better, step, reach[going])
            came[going] = np.where(better, here[:, None], came[going])
            open_ = np.where(closed, np.inf, reach[going])
            to = open_.argmin(axis=1)
            least = open_[np.arange(len(going)), to]
            row_price[going, row] += least
            which, column = np.nonzero(closed)
            row_price[going[which], owner[going[which], column]] += least[which]
            column_price[going] = np.where(closed, column_price[going] - least[:, None], column_price[going])
            reach[going] = np.where(closed, reach[going], reach[going] - least[:, None])
            at[going] = to
            free = owner[going, to] < 0
            ended[going[free]] = to[free]
            going = going[~free]
        back = np.flatnonzero(ended != n)
        while len(back):
            before = came[back, ended[back]]
            owner[back, ended[back]] = owner[back, before]
            ended[back] = before
            back = back[before != n]
    out = np.empty((m, n), int)
    np.put_along_axis(out, owner[:, :n], np.tile(np.arange(n), (m, 1)), axis=1)
    return out
