"""Nyström features shared by the kernel classifiers."""

from __future__ import annotations

import numpy as np


def nystrom_map(landmarks: np.ndarray, floor: float = 1e-6) -> np.ndarray:
    """K_mm ** -1/2 of a landmark kernel matrix; directions with a share below
    ``floor`` of the largest eigenvalue are left out."""
    values, vectors = np.linalg.eigh((landmarks + landmarks.T) / 2)
    keep = values > floor * max(values.max(initial=0.0), 1e-12)
    return vectors[:, keep] / np.sqrt(values[keep])


def ridge(z: np.ndarray, targets: np.ndarray, strength: float) -> tuple[np.ndarray, np.ndarray]:
    """Weights and offsets of ridge regression, one column per target."""
    mean_z, mean_t = z.mean(0), targets.mean(0)
    a, b = z - mean_z, targets - mean_t
    weights = np.linalg.solve(a.T @ a + strength * np.eye(z.shape[1]), a.T @ b)
    return weights, mean_t - mean_z @ weights


def svm(z: np.ndarray, y: np.ndarray, cost: np.ndarray, steps: int = 30) -> tuple[np.ndarray, float]:
    """Linear SVM with squared hinge loss by Newton steps on the active set;
    ``y`` in (-1, 1), ``cost`` per row.  The offset is a nearly free column."""
    z = np.hstack([z, np.full((len(z), 1), 10.0)])
    w = np.zeros(z.shape[1])
    active = np.ones(len(z), bool)
    for _ in range(steps):
        za = z[active] * cost[active, None]
        new = np.linalg.solve(np.eye(z.shape[1]) + 2 * za.T @ z[active], 2 * za.T @ y[active])
        now = y * (z @ new) < 1
        w = new
        if (now == active).all() or not now.any():
            break
        active = now
    return w[:-1], float(10.0 * w[-1])


def logistic(x: np.ndarray, y: np.ndarray, weight: np.ndarray, decay: float = 1e-2, steps: int = 50) -> np.ndarray:
    """Weights (last: offset) of a regularised logistic regression."""
    x = np.hstack([x, np.ones((len(x), 1))])
    w, pull = np.zeros(x.shape[1]), decay * np.eye(x.shape[1])
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        hessian = (x * (weight * p * (1 - p))[:, None]).T @ x + pull
        step = np.linalg.solve(hessian, x.T @ (weight * (y - p)) - pull @ w)
        w = w + step
        if np.abs(step).max() < 1e-8:
            break
    return w
