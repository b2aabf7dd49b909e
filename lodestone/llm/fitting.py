"""Small fits on bounded samples."""

from __future__ import annotations

import numpy as np

NEWTON_STEPS = 40


def logistic(x: np.ndarray, y: np.ndarray, weight: np.ndarray, steps: int = NEWTON_STEPS, ridge: float = 1.0) -> np.ndarray:
    """Weights of a ridge logistic regression by Newton steps; the last is the intercept.

    A step is halved until the loss falls, so separable data settle too.
    """
    x = np.column_stack([x, np.ones(len(x))])
    hold = ridge * np.eye(x.shape[1])
    hold[-1, -1] = 1e-6

    def loss(beta: np.ndarray) -> float:
        z = x @ beta
        return float((weight * (np.logaddexp(0, z) - y * z)).sum() + beta @ hold @ beta / 2)

    beta = np.zeros(x.shape[1])
    now = loss(beta)
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(x @ beta, -30, 30)))
        slope = x.T @ (weight * (y - p)) - hold @ beta
        curve = (x * (weight * p * (1 - p))[:, None]).T @ x + hold
        step = np.linalg.solve(curve, slope)
        while loss(beta + step) > now and np.abs(step).max() > 1e-9:
            step = step / 2
        if np.abs(step).max() < 1e-7:
            break
        beta = beta + step
        now = loss(beta)
    return beta
