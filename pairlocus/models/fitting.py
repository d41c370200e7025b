"""Fits from many starts, and their uncertainties, as Spark jobs.

A table of starts (or of points of a derivative stencil) is dealt over tasks and each row is
fitted or evaluated there; rows need nothing of each other, so grids and replicates of any
number spread over the cluster. What a task runs is a small numerical helper.
"""

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Added to the objective where parameters aren't allowed. A fixed value.
PENALTY = 1e10


def nelder_mead(f: Callable, x0: np.ndarray, max_iter: int = 500, tol: float = 1e-8) -> tuple[np.ndarray, float, int, int]:
    """(x, f(x), iterations, calls) of the downhill simplex."""
    n = len(x0)
    points = np.tile(np.asarray(x0, float), (n + 1, 1))
    for i in range(n):
        points[i + 1, i] = points[i + 1, i] * 1.05 if points[i + 1, i] else 2.5e-4
    values, calls = np.array([f(p) for p in points]), n + 1
    for k in range(max_iter):
        order = np.argsort(values)
        points, values = points[order], values[order]
        if np.abs(values[1:] - values[0]).max() <= tol * (1 + abs(values[0])) and np.abs(points[1:] / np.where(points[0] == 0, 1, points[0]) - 1).max() <= 1e-6:
            return points[0], float(values[0]), k, calls
        center = points[:-1].mean(axis=0)
        reflected = 2 * center - points[-1]
        fr, calls = f(reflected), calls + 1
        if fr < values[0]:
            expanded = 3 * center - 2 * points[-1]
            fe, calls = f(expanded), calls + 1
            points[-1], values[-1] = (expanded, fe) if fe < fr else (reflected, fr)
        elif fr < values[-2]:
            points[-1], values[-1] = reflected, fr
        else:
            inner = (center + (reflected if fr < values[-1] else points[-1])) / 2
            fi, calls = f(inner), calls + 1
            if fi < min(fr, values[-1]):
                points[-1], values[-1] = inner, fi
            else:
                points[1:] = (points[1:] + points[0]) / 2
                values[1:] = [f(p) for p in points[1:]]
                calls += n
    best = int(np.argmin(values))
    return points[best], float(values[best]), max_iter, calls


def gradient_descent(f: Callable, x0: np.ndarray, max_iter: int = 500, lower=None, upper=None, tol: float = 1e-9) -> tuple[np.ndarray, float, int, int]:
    """Quasi-Newton (BFGS) on relative parameters, kept within bounds by projection."""
    scale = np.where(np.asarray(x0, float) == 0, 1.0, np.abs(x0))
    low = -np.inf if lower is None else np.asarray(lower) / scale
    high = np.inf if upper is None else np.asarray(upper) / scale
    calls = 0

    def value(z):
        nonlocal calls
        calls += 1
        return f(z * scale)

    def slope(z):
        steps = np.eye(len(z)) * 1e-5 * np.maximum(np.abs(z), 1e-3)
        return np.array([(value(z + s) - value(z - s)) / (2 * s.sum()) for s in steps])

    z = np.clip(np.asarray(x0, float) / scale, low, high)
    fz, g, inverse = value(z), slope(z), np.eye(len(z))
    for k in range(max_iter):
        step, t = -inverse @ g, 1.0
        if step @ g >= 0:
            step, inverse = -g, np.eye(len(z))
        while t > 1e-10:
            new = np.clip(z + t * step, low, high)
            fn = value(new)
            if fn < fz - 1e-6 * t * abs(step @ g):
                break
            t /= 2
        else:
            return z * scale, float(fz), k, calls
        gn = slope(new)
        s, y = new - z, gn - g
        if s @ y > 1e-14:
            rho = 1 / (s @ y)
            left = np.eye(len(z)) - rho * np.outer(s, y)
            inverse = left @ inverse @ left.T + rho * np.outer(s, s)
        done = abs(fz - fn) <= tol * (1 + abs(fz))
        z, fz, g = new, fn, gn
        if done:
            return z * scale, float(fz), k + 1, calls
    return z * scale, float(fz), max_iter, calls


def powell(f: Callable, x0: np.ndarray, max_iter: int = 100, tol: float = 1e-8) -> tuple[np.ndarray, float, int, int]:
    """Line searches along directions, of which the one that gained most is replaced."""
    x, calls = np.asarray(x0, float), 1
    fx = f(x)
    ways = np.diag(np.where(x == 0, 1e-3, np.abs(x) * 0.1))

    def along(x, fx, way):
        nonlocal calls
        best, at, step = fx, 0.0, 1.0
        while abs(step) > 1e-5:
            fn = f(x + (at + step) * way)
            calls += 1
            if fn < best:
                best, at, step = fn, at + step, step * 1.8
            else:
                step *= -0.45
        return x + at * way, best

    for k in range(max_iter):
        before, x_before, gains = fx, x, []
        for way in ways:
            x, fn = along(x, fx, way)
            gains.append(fx - fn)
            fx = fn
        if before - fx <= tol * (1 + abs(fx)):
            return x, float(fx), k + 1, calls
        way = x - x_before
        if np.abs(way).max() > 0:
            ways[int(np.argmax(gains))] = way
            x, fx = along(x, fx, way)
    return x, float(fx), max_iter, calls


METHODS = {"NelderMead": nelder_mead, "BFGS": gradient_descent, "LBFGSB": gradient_descent, "Powell": powell}


def penalised(objective: Callable, lower, upper, greater=()) -> Callable:
    """The objective, or PENALTY where a parameter is out of bounds or not the greater one."""

    def f(p):
        inside = all(a <= x <= b for a, x, b in zip(lower, p, upper, strict=True)) and all(p[i] > p[j] for i, j in greater)
        return objective(p) if inside else PENALTY

    return f


def fit_starts(starts: DataFrame, objective: Callable, method: str = "NelderMead", max_iter: int = 500) -> DataFrame:
    """``start, x, fopt, num_iter, func_calls`` of ``starts(start, x0)``: one fit a row."""
    if method not in METHODS:
        raise ValueError(f"no such method: {method}")
    minimise = METHODS[method]

    def run(batches):
        for batch in batches:
            out = [minimise(objective, np.array(x0), max_iter) for x0 in batch["x0"].to_pylist()]
            yield pa.RecordBatch.from_pydict(
                {
                    "start": batch["start"],
                    "x": pa.array([x.tolist() for x, *_ in out], pa.list_(pa.float64())),
                    "fopt": pa.array([o[1] for o in out], pa.float64()),
                    "num_iter": pa.array([o[2] for o in out], pa.int64()),
                    "func_calls": pa.array([o[3] for o in out], pa.int64()),
                }
            )

    n = starts.count()
    return starts.repartition(max(1, n)).mapInArrow(
        run, "start long, x array<double>, fopt double, num_iter long, func_calls long"
    )


def best_fit(fits: DataFrame, by: list[str] | None = None) -> DataFrame:
    return fits.groupBy(*(by or [])).agg(F.min_by(F.struct(*fits.columns), "fopt").alias("best")).select("best.*")


def evaluate(spark: SparkSession, points: list[list[float]], function: Callable) -> list[float]:
    """A function at some points (a stencil: few by its nature), one task each."""

    def run(batches):
        for batch in batches:
            yield pa.RecordBatch.from_pydict(
                {"n": batch["n"], "value": pa.array([float(function(np.array(x))) for x in batch["x"].to_pylist()], pa.float64())}
            )

    df = spark.createDataFrame(list(enumerate(points)), "n long, x array<double>").repartition(min(len(points), 64))
    rows = df.mapInArrow(run, "n long, value double").collect()
    return [r["value"] for r in sorted(rows, key=lambda r: r["n"])]


def stencil(p: np.ndarray, delta: float) -> list[np.ndarray]:
    """p, p +- each step, and for each pair of parameters the four corners."""
    steps = np.diag(p * delta)
    out = [p]
    for s in steps:
        out += [p + s, p - s]
    for i in range(len(p)):
        for j in range(i + 1, len(p)):
            out += [p + steps[i] + steps[j], p + steps[i] - steps[j], p - steps[i] + steps[j], p - steps[i] - steps[j]]
    return out


def derivatives(values: list[float], p: np.ndarray, delta: float) -> tuple[np.ndarray, np.ndarray]:
    """Gradient and Hessian by central differences of the values at ``stencil``."""
    n, h = len(p), p * delta
    up, down = np.array(values[1 : 2 * n + 1 : 2]), np.array(values[2 : 2 * n + 2 : 2])
    hessian = np.diag((up - 2 * values[0] + down) / h**2)
    at = 2 * n + 1
    for i in range(n):
        for j in range(i + 1, n):
            a, b, c, d = values[at : at + 4]
            hessian[i, j] = hessian[j, i] = (a - b - c + d) / (4 * h[i] * h[j])
            at += 4
    return (up - down) / (2 * h), hessian


def uncertainties(
    spark: SparkSession, p, likelihood: Callable, replicates: list | None = None, delta: float = 0.01, method: str = "GIM"
) -> np.ndarray:
    """Standard errors: by Fisher information, or Godambe's from gradients on replicates.

    ``likelihood(p, data)`` takes the replicate's data, None for the data itself.
    """
    p = np.asarray(p, float)
    _, hessian = derivatives(evaluate(spark, [x.tolist() for x in stencil(p, delta)], lambda x: likelihood(x, None)), p, delta)
    h = -hessian
    if method == "FIM":
        return np.sqrt(np.diag(np.linalg.inv(h)))
    steps = np.diag(p * delta)
    points = [(p + sign * s).tolist() + [float(k)] for k in range(len(replicates)) for s in steps for sign in (1, -1)]
    values = evaluate(spark, points, lambda x: likelihood(x[:-1], replicates[int(x[-1])]))
    grads = np.array(values).reshape(len(replicates), len(p), 2)
    grads = (grads[:, :, 0] - grads[:, :, 1]) / (2 * p * delta)
    j = grads.T @ grads / len(replicates)
    return np.sqrt(np.diag(np.linalg.inv(h @ np.linalg.inv(j) @ h)))


def logistic_fit(x: np.ndarray, y: np.ndarray, start, steps: int = 200) -> np.ndarray:
    """Levenberg-Marquardt for y = low + (high - low) / (1 + exp(k (x - x0)))."""

    def model(q):
        return q[0] + (q[1] - q[0]) / (1 + np.exp(np.clip(q[2] * (x - q[3]), -60, 60)))

    q, damp = np.asarray(start, float), 1e-3
    error = ((y - model(q)) ** 2).sum()
    for _ in range(steps):
        h = 1e-6 * np.maximum(np.abs(q), 1e-9)
        jac = np.column_stack([(model(q + np.eye(4)[i] * h[i]) - model(q - np.eye(4)[i] * h[i])) / (2 * h[i]) for i in range(4)])
        a = jac.T @ jac
        move = np.linalg.lstsq(a + damp * np.diag(np.diag(a) + 1e-300), jac.T @ (y - model(q)), rcond=None)[0]
        new = ((y - model(q + move)) ** 2).sum()
        if new < error:
            done = error - new <= 1e-14 * error
            q, error, damp = q + move, new, damp / 3
            if done:
                break
        else:
            damp *= 4
    return q


def estimate_rho_theta(mid_r: np.ndarray, h2: np.ndarray) -> dict[str, float]:
    """theta and rho from the fall of H2 with log10 r, fitted by a logistic curve."""
    x = np.log10(mid_r)
    q = logistic_fit(x, np.asarray(h2, float), [h2.min(), h2.max(), 2.0, float(np.median(x))])
    theta = float(np.sqrt(max(min(q[0], q[1]), 0)))
    return {"theta": theta, "rho_ne": float(1 / (4 * 10 ** q[3])), "ratio": float((max(q[0], q[1])) / max(min(q[0], q[1]), 1e-300))}
