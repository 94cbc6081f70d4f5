"""Linear models trained on the driver from bounded, sampled feature matrices."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np


def sigmoid(z: np.ndarray) -> np.ndarray:
    return 1.0 / (1.0 + np.exp(-np.clip(z, -40, 40)))


@dataclass
class Linear:
    mean: np.ndarray
    scale: np.ndarray
    weight: np.ndarray
    bias: float

    def logit(self, x: np.ndarray) -> np.ndarray:
        return ((x - self.mean) / self.scale).clip(-8, 8) @ self.weight + self.bias

    def score(self, x: np.ndarray) -> np.ndarray:
        return sigmoid(self.logit(x))


class Adam:
    def __init__(self, size: int, rate: float):
        self.m, self.v, self.t, self.rate = np.zeros(size), np.zeros(size), 0, rate

    def step(self, gradient: np.ndarray) -> np.ndarray:
        self.t += 1
        self.m = 0.9 * self.m + 0.1 * gradient
        self.v = 0.999 * self.v + 0.001 * gradient**2
        return self.rate * (self.m / (1 - 0.9**self.t)) / (np.sqrt(self.v / (1 - 0.999**self.t)) + 1e-8)


def standard(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    spread = x.std(axis=0)
    return x.mean(axis=0), np.where(spread > 1e-6, spread, 1.0)


def fit_logistic(x: np.ndarray, target: np.ndarray, weight: np.ndarray | None = None, epochs: int = 60, batch: int = 512, rate: float = 0.02, l2: float = 1e-4, seed: int = 7) -> Linear:
    """Logistic regression on targets in [0, 1] (posteriors allowed)."""
    mean, scale = standard(x)
    z = ((x - mean) / scale).clip(-8, 8)
    share = np.ones(len(z)) if weight is None else weight / weight.mean()
    theta, opt, rng = np.zeros(z.shape[1] + 1), Adam(z.shape[1] + 1, rate), np.random.default_rng(seed)
    for epoch in range(epochs):
        opt.rate = rate * (1 - epoch / epochs) + 1e-4
        for rows in np.array_split(rng.permutation(len(z)), max(1, len(z) // batch)):
            error = (sigmoid(z[rows] @ theta[:-1] + theta[-1]) - target[rows]) * share[rows]
            theta -= opt.step(np.append(z[rows].T @ error / len(rows) + l2 * theta[:-1], error.mean()))
    return Linear(mean, scale, theta[:-1], float(theta[-1]))


def class_prior(positive: np.ndarray, unlabelled: np.ndarray, confidence: float = 0.1) -> float:
    """Share of positives among the unlabelled, from two samples of scores.

    Best-bin estimation: over thresholds, the least upper bound of (unlabelled
    share above) / (positive share above); a top bin free of negatives gives the
    prior itself.
    """
    cuts = np.unique(np.concatenate([positive, unlabelled]))
    p = 1 - np.searchsorted(np.sort(positive), cuts, side="left") / len(positive)
    u = 1 - np.searchsorted(np.sort(unlabelled), cuts, side="left") / len(unlabelled)
    slack = np.sqrt(np.log(4 / confidence) / (2 * len(positive))) + np.sqrt(np.log(4 / confidence) / (2 * len(unlabelled)))
    usable = p > 0
    best = np.argmin((u[usable] + slack) / p[usable])
    return float(np.clip(u[usable][best] / p[usable][best], 0.01, 0.99))


def fit_pu(positive: np.ndarray, unlabelled: np.ndarray, prior: float, epochs: int = 80, batch: int = 1024, rate: float = 0.02, l2: float = 1e-4, seed: int = 11) -> Linear:
    """Minimise the non-negative unbiased risk with the logistic loss.

    risk = prior E_P[l(+)] + max(0, E_U[l(-)] - prior E_P[l(-)]); where the second
    part falls below zero in a batch, its gradient is followed upwards instead.
    """
    mean, scale = standard(unlabelled)
    zp, zu = ((positive - mean) / scale).clip(-8, 8), ((unlabelled - mean) / scale).clip(-8, 8)
    theta, opt, rng = np.zeros(zp.shape[1] + 1), Adam(zp.shape[1] + 1, rate), np.random.default_rng(seed)
    steps = max(1, len(zu) // batch)
    for epoch in range(epochs):
        opt.rate = rate * (1 - epoch / epochs) + 1e-4
        p_rows, u_rows = np.array_split(rng.permutation(len(zp)), steps), np.array_split(rng.permutation(len(zu)), steps)
        for pi, ui in zip(p_rows, u_rows, strict=True):
            if not len(pi) or not len(ui):
                continue
            fp, fu = zp[pi] @ theta[:-1] + theta[-1], zu[ui] @ theta[:-1] + theta[-1]
            sp, su = sigmoid(fp), sigmoid(fu)
            negative = np.logaddexp(0, fu).mean() - prior * np.logaddexp(0, fp).mean()
            up = zu[ui].T @ su / len(ui) - prior * (zp[pi].T @ sp) / len(pi)
            up_bias = su.mean() - prior * sp.mean()
            if negative < 0:
                gradient, bias = -up, -up_bias
            else:
                gradient = up - prior * (zp[pi].T @ (1 - sp)) / len(pi)
                bias = up_bias - prior * (1 - sp).mean()
            theta -= opt.step(np.append(gradient + l2 * theta[:-1], bias))
    return Linear(mean, scale, theta[:-1], float(theta[-1]))
