"""Ridge and logit of all folds from sums of products.

A row is (1, features, target). Ridge needs the sums of its products by fold alone: they are added up by date in one pass over the rows, and a
fold's are those of its training dates, so rows are never copied by fold.  Logit takes Newton steps: one aggregation a step holds gradients and
curvatures of all folds. What the driver holds and solves is one small square of numbers a fold.

Numbers are scaled by each fold's own mean and population deviation, 1 where there is none; categories are 0 or 1 for each value
the data have, and 0 for all others. The penalty is on scaled weights and not on the intercept. Numbers are moved by their
mean over all rows before they are multiplied, which keeps digits and changes no fit.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Design:
    """Expressions of the features over the data's columns; the first `numbers` of them are scaled."""

    features: list[Column]
    numbers: int

    @property
    def row(self) -> list[Column]:
        return [F.lit(1.0), *self.features]


def design(data: DataFrame, numbers: list[str], categorical: list[str]) -> Design:
    centre = data.agg(*[F.avg(c).alias(c) for c in numbers]).first()
    values = [(c, v) for c in categorical for (v,) in sorted(r for r in data.select(c).distinct().collect() if r[0] is not None)]  # forms and session buckets
    return Design([F.col(c).cast("double") - F.lit(centre[c] or 0.0) for c in numbers] + [F.coalesce((F.col(c) == v).cast("double"), F.lit(0.0)) for c, v in values], len(numbers))


def products(row: list[Column], weight: Column | None = None) -> list[Column]:
    """Sums of the products of all pairs of a row's entries."""
    return [F.sum(a * b if weight is None else a * b * weight).alias(f"s{i}_{j}") for i, a in enumerate(row) for j, b in enumerate(row) if i <= j]


def square(found, size: int) -> np.ndarray:
    out = np.zeros((size, size))
    for i in range(size):
        for j in range(i, size):
            out[i, j] = out[j, i] = found[f"s{i}_{j}"] or 0.0
    return out


def fold_squares(data: DataFrame, marks: DataFrame, row: list[Column]) -> dict[int, np.ndarray]:
    """Sums of products of each fold's training rows; marks are (fold, role, trade_date)."""
    by_date = data.groupBy("trade_date").agg(*products(row))
    names = [c for c in by_date.columns if c != "trade_date"]
    found = by_date.join(F.broadcast(marks.where("role = 'train'")), "trade_date").groupBy("fold").agg(*[F.sum(c).alias(c) for c in names]).collect()  # days x folds before, folds after
    return {r["fold"]: square(r, len(row)) for r in found}


@dataclass(frozen=True)
class Scale:
    """Means and deviations of a fold's features, those of categories being 0 and 1."""

    mean: np.ndarray
    sd: np.ndarray


def scale_of(sums: np.ndarray, p: int, numbers: int) -> Scale:
    mean, square_ = sums[0, 1 : p + 1] / sums[0, 0], np.diag(sums)[1 : p + 1] / sums[0, 0]
    spread, number = square_ - mean**2, np.arange(p) < numbers
    some = number & (spread > 1e-12 * square_)  # less is what rounding leaves of none
    return Scale(np.where(number, mean, 0.0), np.sqrt(np.where(some, spread, 1.0)))


def ridge(sums: np.ndarray, numbers: int, alpha: float) -> np.ndarray:
    """Intercept and weights of the features as they are, from sums of products of (1, features, y)."""
    n, p = sums[0, 0], len(sums) - 2
    scale = scale_of(sums, p, numbers)
    mean = sums[0, 1:] / n
    moved = sums[1:, 1:] - n * np.outer(mean, mean)
    w = np.linalg.solve(moved[:p, :p] / np.outer(scale.sd, scale.sd) + alpha * np.eye(p), moved[:p, p] / scale.sd) / scale.sd
    return np.append(mean[p] - mean[:p] @ w, w)


def fit_ridge(data: DataFrame, marks: DataFrame, x: Design, alpha: float) -> dict[int, np.ndarray]:
    squares = fold_squares(data, marks, [*x.row, F.col("y").cast("double")])
    return {f: ridge(s, x.numbers, alpha) for f, s in squares.items()}


def fit_logit(data: DataFrame, marks: DataFrame, x: Design, c: float, tolerance: float = 1e-10, steps: int = 100) -> dict[int, np.ndarray]:
    """Intercept and weights by fold for y > 0: Newton steps, halved while a step makes the objective worse."""
    p = len(x.features)
    scales = {f: scale_of(s, p, x.numbers) for f, s in fold_squares(data, marks, x.row).items()}
    if not scales:
        return {}
    train = data.select("trade_date", F.array(*x.features).alias("x"), (F.col("y") > 0).cast("double").alias("t")).join(F.broadcast(marks.where("role = 'train'").drop("role")), "trade_date")
    held = np.append(0.0, np.ones(p)) / c

    def raw(f: int, w: np.ndarray) -> np.ndarray:
        """Scaled weights as weights of the features as they are."""
        own = w[1:] / scales[f].sd
        return np.append(w[0] - scales[f].mean @ own, own)

    def at(weights: dict[int, np.ndarray]) -> dict[int, tuple[float, np.ndarray, np.ndarray]]:
        """Loss, gradient and curvature over the features as they are, then over scaled ones."""
        row = [F.lit(1.0), *[F.get("x", F.lit(i)) for i in range(p)]]
        table = F.broadcast(data.sparkSession.createDataFrame([(f, [float(v) for v in raw(f, w)]) for f, w in weights.items()], "fold int, w array<double>"))
        rows = train.join(table, "fold")
        z = F.get("w", F.lit(0))
        for i in range(p):
            z = z + F.get("x", F.lit(i)) * F.get("w", F.lit(i + 1))
        rows = rows.withColumn("z", z).withColumn("q", 1 / (1 + F.exp(-F.col("z"))))
        loss = F.greatest("z", F.lit(0.0)) + F.log1p(F.exp(-F.abs("z"))) - F.col("t") * F.col("z")
        found = rows.groupBy("fold").agg(F.sum(loss).alias("loss"), *[F.sum((F.col("q") - F.col("t")) * v).alias(f"g{i}") for i, v in enumerate(row)], *products(row, F.col("q") * (1 - F.col("q")))).collect()
        out = {}
        for r in found:
            scale, w = scales[r["fold"]], weights[r["fold"]]
            move = np.eye(p + 1)  # scaled features from (1, features)
            move[1:, 1:] /= scale.sd[:, None]
            move[1:, 0] = -scale.mean / scale.sd
            gradient = move @ np.array([r[f"g{i}"] for i in range(p + 1)]) + held * w
            out[r["fold"]] = r["loss"] + 0.5 * held @ w**2, gradient, move @ square(r, p + 1) @ move.T + np.diag(held)
        return out

    now = {f: np.zeros(p + 1) for f in scales}
    state, done = at(now), {}
    share = dict.fromkeys(now, 1.0)
    for _ in range(steps):
        ahead = {f: now[f] - share[f] * np.linalg.lstsq(state[f][2], state[f][1], rcond=None)[0] for f in now if f not in done}
        if not ahead:
            break
        for f, found in at(ahead).items():
            if found[0] > state[f][0] + 1e-9 * abs(state[f][0]) and share[f] > 1e-6:
                share[f] /= 2
                continue
            if np.abs(ahead[f] - now[f]).max() <= tolerance * max(1.0, np.abs(ahead[f]).max()):
                done[f] = True
            now[f], state[f], share[f] = ahead[f], found, 1.0
    return {f: raw(f, w) for f, w in now.items()}


def scored(test: DataFrame, weights: dict[int, np.ndarray], x: Design, name: str) -> DataFrame:
    """test (fold, ...) with intercept and weighted features of the row's fold added up as `name`."""
    table = test.sparkSession.createDataFrame([(f, [float(v) for v in w]) for f, w in weights.items()], "fold int, _w array<double>")
    total = F.get("_w", F.lit(0))
    for i, feature in enumerate(x.features):
        total = total + feature * F.get("_w", F.lit(i + 1))
    return test.join(F.broadcast(table), "fold").withColumn(name, total).drop("_w")  # a row a fold
