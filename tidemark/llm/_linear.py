"""Logistic regression on a bounded sample, by accelerated proximal steps."""

from __future__ import annotations

from functools import cached_property

import numpy as np

_BLOCK = 1 << 20


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


def joined(parts: list[np.ndarray], kind: type) -> np.ndarray:
    """The parts as one array; their list is emptied, so that none is held twice."""
    out = np.concatenate(parts) if parts else np.empty(0, kind)
    parts.clear()
    return out


class _Sums:
    """Weighted sums of entries by one of their two indices, which is sorted once for the many steps of a fit."""

    def __init__(self, by: np.ndarray, other: np.ndarray, value: np.ndarray | None, size: int):
        if (by[1:] < by[:-1]).any():
            order = np.argsort(by.astype(np.min_scalar_type(size)), kind="stable")  # narrow numbers sort by radix
            by, other, value = by[order], other[order], None if value is None else value[order]
        self.starts = np.flatnonzero(np.append(True, by[1:] != by[:-1])) if len(by) else np.empty(0, np.int64)
        self.at, self.other, self.size = by[self.starts], other.astype(np.intp), size
        self.value = None if value is None or (value == 1).all() else value

    def of(self, x: np.ndarray) -> np.ndarray:
        out = np.zeros(self.size)
        if len(self.at):
            part = x.take(self.other)
            if self.value is not None:
                part *= self.value
            out[self.at] = np.add.reduceat(part, self.starts)
        return out


class Rows:
    """A matrix whose first `width` columns are sparse, entries at (row, column), all 1 if value is None, and whose last ones are dense."""

    def __init__(self, row: np.ndarray, column: np.ndarray, value: np.ndarray | None, width: int, dense: np.ndarray):
        self.row, self.column, self.value, self.width, self.dense = row, column, value, width, dense
        self.shape = (len(dense), width + dense.shape[1])

    def dot(self, w: np.ndarray) -> np.ndarray:
        return self._by_row.of(w[: self.width]) + self.dense @ w[self.width :]

    def back(self, r: np.ndarray) -> np.ndarray:
        return np.append(self._by_column.of(r), self.dense.T @ r)

    @cached_property
    def _by_row(self) -> _Sums:
        return _Sums(self.row, self.column, self.value, self.shape[0])

    @cached_property
    def _by_column(self) -> _Sums:
        return _Sums(self.column, self.row, self.value, self.width)

    def squares(self) -> np.ndarray:
        """Mean square of each column."""
        return np.append(np.bincount(self.column, None if self.value is None else self.value**2, minlength=self.width), (self.dense**2).sum(0)) / max(self.shape[0], 1)

    def scaled(self, by: np.ndarray) -> Rows:
        value = by[self.column] if self.value is None else self.value * by[self.column]
        return Rows(self.row, self.column, value, self.width, self.dense * by[self.width :])

    def of(self, keep: np.ndarray, columns: np.ndarray | None = None) -> Rows:
        """Rows in the mask `keep`, and of the sparse columns those of a mask."""
        some = keep[self.row]
        if columns is not None:
            some &= columns[self.column]
        place = (np.cumsum(keep) - 1).astype(self.row.dtype)
        row, column = place[self.row[some]], self.column[some]
        if columns is not None:
            column = (np.cumsum(columns) - 1).astype(column.dtype)[column]
        return Rows(row, column, None if self.value is None else self.value[some], int(columns.sum()) if columns is not None else self.width, self.dense[keep])

    def counts(self, keep: np.ndarray, weight: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Of the rows in the mask `keep`, the entries of each sparse column and the sum of their rows' weights, a block of entries at a time."""
        times, sums = np.zeros(self.width, np.int64), np.zeros(self.width)
        for at in range(0, len(self.row), _BLOCK):
            row, column = self.row[at : at + _BLOCK], self.column[at : at + _BLOCK]
            some = keep[row]
            times += np.bincount(column[some], minlength=self.width)
            some &= weight[row] != 0
            sums += np.bincount(column[some], weight[row[some]], minlength=self.width)
        return times, sums


def logistic(x: Rows, y: np.ndarray, l1: float = 0.0, l2: float = 1e-4, steps: int = 300, weight: np.ndarray | None = None, still: float = 2e-3) -> np.ndarray:
    """Weights of the columns of x for labels y in [0, 1]; the last column is the constant and is not shrunk by l1. Ends once no weight moves by more than the share `still` of the largest."""
    n, size = x.shape
    w = np.zeros(size)
    if not n:
        return w
    weight = np.ones(n) if weight is None else weight
    top, norm = np.ones(size), 1.0
    for _ in range(20):
        top = x.back(weight * x.dot(top))
        norm = float(np.linalg.norm(top)) or 1.0
        top /= norm
    step = 1 / (0.3 * norm / n + l2)
    shrink = np.full(size, step * l1)
    shrink[-1] = 0
    z, t = w.copy(), 1.0
    for _ in range(steps):
        new = z - step * (x.back(weight * (sigmoid(x.dot(z)) - y)) / n + l2 * z)
        new = np.sign(new) * np.maximum(np.abs(new) - shrink, 0)
        u = (1 + (1 + 4 * t * t) ** 0.5) / 2
        moved = new - w
        if np.abs(moved).max() < still * max(1.0, np.abs(new).max()):
            return new
        z, w, t = new + (t - 1) / u * moved, new, u
    return w
