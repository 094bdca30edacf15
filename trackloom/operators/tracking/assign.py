"""Optimal one-to-one assignment."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, functions as F

from ..fold import ordered_fold

BLOCKED = 1e6
ACCEPT = 0.999


def _place(cost: np.ndarray) -> np.ndarray:
    """Column of each row of the cheapest full assignment; there are no fewer columns than rows.

    Rows come in one by one. A new row takes the free column at the end of the cheapest chain of swaps; chain costs are
    relaxed for all columns at once until none improves.
    """
    n, m = cost.shape
    holder = np.full(m, -1)
    for row in range(n):
        reach, before = cost[row].copy(), np.full(m, -1)
        held = np.flatnonzero(holder >= 0)
        while len(held):
            chain = (reach[held] - cost[holder[held], held])[:, None] + cost[holder[held]]
            k = chain.argmin(axis=0)
            cheaper = chain[k, np.arange(m)] < reach - 1e-9
            if not cheaper.any():
                break
            reach[cheaper] = chain[k, np.arange(m)][cheaper]
            before[cheaper] = held[k[cheaper]]
        col = int(np.where(holder < 0, reach, np.inf).argmin())
        while before[col] >= 0:
            holder[col] = holder[before[col]]
            col = before[col]
        holder[col] = row
    out = np.full(n, -1)
    out[holder[holder >= 0]] = np.flatnonzero(holder >= 0)
    return out


def solve(cost: list[list[float]]) -> list[int]:
    """Cheapest assignment of rows to columns; entry i is the column of row i or -1."""
    table = np.asarray(cost, dtype=float)
    if not table.size:
        return [-1] * len(cost)
    if table.shape[0] <= table.shape[1]:
        return _place(table).tolist()
    out = np.full(table.shape[0], -1)
    out[_place(table.T)] = np.arange(table.shape[1])
    return out.tolist()


def _components(r: np.ndarray, c: np.ndarray, n: int) -> np.ndarray:
    """A common label for the pairs that share rows or columns, directly or over others."""
    label = np.arange(n + int(c.max()) + 1)
    while True:
        low = np.minimum(label[r], label[n + c])
        new = label.copy()
        np.minimum.at(new, r, low)
        np.minimum.at(new, n + c, low)
        if (new == label).all():
            return label[r]
        label = new


def solve_pairs(row: np.ndarray, col: np.ndarray, cost: np.ndarray) -> np.ndarray:
    """Chosen positions among listed (row, column, cost) pairs; unlisted pairs are not allowed.

    Pairs that share no row or column, directly or over others, are settled apart from each other.
    """
    if not len(row):
        return np.zeros(0, int)
    r_ids, r = np.unique(row, return_inverse=True)
    _, c = np.unique(col, return_inverse=True)
    label, picks = _components(r, c, len(r_ids)), []
    for part in np.split(np.argsort(label, kind="stable"), np.cumsum(np.unique(label, return_counts=True)[1])[:-1]):
        if len(part) == 1:
            picks.append(int(part[0]))
            continue
        rows, i = np.unique(r[part], return_inverse=True)
        cols, j = np.unique(c[part], return_inverse=True)
        table, at = np.full((len(rows), len(cols)), BLOCKED), np.full((len(rows), len(cols)), -1)
        table[i, j], at[i, j] = cost[part], part
        if len(rows) > len(cols):
            table, at = table.T, at.T
        picks += [int(at[x, y]) for x, y in enumerate(_place(table)) if at[x, y] >= 0]
    return np.array(sorted(k for k in picks if cost[k] < ACCEPT), dtype=int)


def assign(costs: DataFrame, by: list[str], row: str, col: str, cost: str) -> DataFrame:
    """Cheapest assignment inside each group of allowed pairs (one row per pair).

    Pairs that are alone in both their row and column are settled in SQL columns; the others are
    folded group by group.
    """
    from pyspark.sql import Window as W
    alone = ((F.count("*").over(W.partitionBy(*by, row)) == 1) & (F.count("*").over(W.partitionBy(*by, col)) == 1))
    marked = costs.withColumn("_alone", alone)
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in costs.schema.fields)

    def solved(state) -> pd.DataFrame:
        rows = pd.concat(state)
        return rows.iloc[np.sort(solve_pairs(rows[row].to_numpy(), rows[col].to_numpy(), rows[cost].to_numpy()))]

    tangled = ordered_fold(marked.filter("NOT _alone").drop("_alone"), by, [row, col],
                           lambda s, part: ((s or []) + [part], None), schema, solved)
    return marked.filter(F.col("_alone") & (F.col(cost) < ACCEPT)).drop("_alone").unionByName(tangled)
