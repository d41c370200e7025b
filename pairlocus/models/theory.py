"""Expected H and H2 of one population whose size changes in steps.

The moments (D^2, Dz, pi2, H) of two loci obey linear equations (Hill and Robertson 1968, Ohta
and Kimura 1971, Ragsdale and Gravel 2019); H2 = 4 D^2 + 2 Dz + 4 pi2. At equilibrium they give
Hudson's form 1 + (rho + 18) / (rho^2 + 13 rho + 18) for H2 over the squared theta.
"""

import numpy as np


def system(nu: float, theta: float, rho: float) -> tuple[np.ndarray, np.ndarray]:
    """Matrix and constant of the equations, time in units of 2N generations."""
    a = np.array(
        [
            [-3 / nu - rho, 1 / nu, 1 / nu, 0],
            [4 / nu, -5 / nu - rho / 2, 0, 0],
            [0, 1 / nu, -2 / nu, theta / 2],
            [0, 0, 0, -1 / nu],
        ]
    )
    return a, np.array([0.0, 0.0, 0.0, theta])


def exponential(a: np.ndarray) -> np.ndarray:
    """exp(a), by scaling and squaring of its series."""
    k = max(0, int(np.ceil(np.log2(max(np.abs(a).sum(axis=1).max(), 1e-300)))) + 4)
    x = a / 2.0**k
    term = out = np.eye(len(a))
    for n in range(1, 13):
        term = term @ x / n
        out = out + term
    for _ in range(k):
        out = out @ out
    return out


def moments(epochs: list[tuple[float, float]], u: float, r: float) -> tuple[float, float]:
    """(H, H2) now, of ``epochs`` (end time in generations, size) from the past on."""
    size = epochs[0][1]
    theta, rho = 4 * size * u, 4 * size * r
    a, c = system(1.0, theta, rho)
    y = np.linalg.solve(a, -c)
    start = epochs[0][0]
    for end, now in epochs[1:]:
        t = (start - end) / (2 * size)
        a, c = system(now / size, theta, rho)
        rest = np.linalg.solve(a, -c)
        y = rest + exponential(a * t) @ (y - rest)
        start = end
    return float(y[3]), float(4 * y[0] + 2 * y[1] + 4 * y[2])


def expected(epochs: list[tuple[float, float]], u: float, edges: list[float], rule: str = "trapezoid") -> np.ndarray:
    """H2 of each bin of r, then H."""
    edges = np.asarray(edges, float)
    middles = (edges[1:] + edges[:-1]) / 2
    at = np.array([moments(epochs, u, r)[1] for r in edges])
    if rule in ("none", "midpoint"):
        h2 = np.array([moments(epochs, u, r)[1] for r in middles])
    elif rule == "trapezoid":
        h2 = (at[1:] + at[:-1]) / 2
    elif rule == "simpson":
        h2 = (at[1:] + at[:-1]) / 6 + np.array([moments(epochs, u, r)[1] for r in middles]) * 2 / 3
    else:
        raise ValueError(f"no such rule: {rule}")
    return np.append(h2, moments(epochs, u, 0.0)[0])


def log_likelihood(x: np.ndarray, mu: np.ndarray, precisions: list[np.ndarray], one_locus: bool) -> float:
    """-(x - mu)' P (x - mu) summed over rows, the last row (H) only with ``one_locus``."""
    rows = len(x) if one_locus else len(x) - 1
    return float(-sum((x[i] - mu[i]) @ precisions[i] @ (x[i] - mu[i]) for i in range(rows)))
