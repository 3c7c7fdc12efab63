"""Small numpy models over sparse rows: logistic regression, calibration, cumulative-link ordinal regression."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np


@dataclass
class Sparse:
    """Rows as (row, column, value) triples in row order."""

    row: np.ndarray
    col: np.ndarray
    val: np.ndarray
    n: int

    @classmethod
    def of(cls, parts: list[tuple[bytes, bytes]]) -> Sparse:
        """parts: for each row the int32 columns and float32 values, as bytes."""
        cols = [np.frombuffer(c, np.int32) for c, _ in parts]
        vals = [np.frombuffer(v, np.float32) for _, v in parts]
        row = np.repeat(np.arange(len(parts)), [len(c) for c in cols])
        join = lambda xs, kind: np.concatenate(xs) if xs else np.zeros(0, kind)
        return cls(row, join(cols, np.int32), join(vals, np.float32), len(parts))

    def times(self, w: np.ndarray) -> np.ndarray:
        return np.bincount(self.row, self.val * w[self.col], self.n)

    def back(self, g: np.ndarray, width: int) -> np.ndarray:
        return np.bincount(self.col, self.val * g[self.row], width)

    def take(self, keep: np.ndarray) -> Sparse:
        new = np.cumsum(keep) - 1
        at = keep[self.row]
        return Sparse(new[self.row[at]], self.col[at], self.val[at], int(keep.sum()))


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -40, 40)))


class Adam:
    def __init__(self, shapes: list[int], rate: float):
        self.m, self.v = [np.zeros(s) for s in shapes], [np.zeros(s) for s in shapes]
        self.t, self.rate = 0, rate

    def step(self, params: list[np.ndarray], grads: list[np.ndarray]) -> None:
        self.t += 1
        for p, g, m, v in zip(params, grads, self.m, self.v, strict=True):
            m += 0.1 * (g - m)
            v += 0.001 * (g * g - v)
            p -= self.rate * (m / (1 - 0.9**self.t)) / (np.sqrt(v / (1 - 0.999**self.t)) + 1e-8)


def fit_logistic(x: Sparse, y: np.ndarray, width: int, *, rounds: int = 120, rate: float = 0.3, l2: float = 1e-5) -> tuple[np.ndarray, float]:
    """Full-batch logistic regression; classes count alike, so a rare class is not drowned."""
    w, b = np.zeros(width), np.zeros(1)
    share = y.mean() if len(y) else 0.5
    weight = np.where(y > 0, 0.5 / max(share, 1e-6), 0.5 / max(1 - share, 1e-6)) / max(len(y), 1)
    adam = Adam([width, 1], rate)
    for _ in range(rounds):
        g = (sigmoid(x.times(w) + b[0]) - y) * weight
        adam.step([w, b], [x.back(g, width) + l2 * w, np.array([g.sum()])])
    return w, float(b[0])


def fit_platt(margin: np.ndarray, y: np.ndarray) -> tuple[float, float]:
    """Probability calibration: p = sigmoid(a * margin + c), with smoothed targets."""
    pos, neg = float((y > 0).sum()), float((y <= 0).sum())
    t = np.where(y > 0, (pos + 1) / (pos + 2), 1 / (neg + 2))
    scale = float(np.std(margin)) or 1.0
    m, p = margin / scale, np.zeros(2)
    for _ in range(50):
        q = sigmoid(p[0] * m + p[1])
        g, h = q - t, q * (1 - q) + 1e-9
        grad = np.array([(g * m).sum() + 1e-3 * p[0], g.sum()])
        hess = np.array([[(h * m * m).sum() + 1e-3, (h * m).sum()], [(h * m).sum(), h.sum()]])
        p -= np.linalg.solve(hess + 1e-9 * np.eye(2), grad)
    return float(p[0] / scale), float(p[1])


def fit_ordinal(x: Sparse, y: np.ndarray, width: int, grades: int, *, rounds: int = 500, rate: float = 0.1, l2: float = 1e-5) -> tuple[np.ndarray, np.ndarray]:
    """Cumulative-link model P(grade <= j) = sigmoid(theta_j - w.x): one weight vector, ordered thresholds.

    The thresholds are theta_0 and positive steps, kept positive as exponentials.
    """
    w, raw = np.zeros(width), np.zeros(grades - 1)
    raw[0] = 1.0
    adam, n = Adam([width, grades - 1], rate), max(len(y), 1)

    def thresholds() -> np.ndarray:
        return raw[0] + np.concatenate([[0.0], np.cumsum(np.exp(raw[1:]))])

    for _ in range(rounds):
        theta = thresholds()
        edge = np.concatenate([[-1e3], theta, [1e3]])
        m = x.times(w)
        up, lo = sigmoid(edge[y + 1] - m), sigmoid(edge[y] - m)
        p = np.maximum(up - lo, 1e-9)
        du, dl = up * (1 - up) / p, lo * (1 - lo) / p
        g_theta = np.zeros(grades - 1)
        np.add.at(g_theta, y[y < grades - 1], -du[y < grades - 1] / n)
        np.add.at(g_theta, y[y > 0] - 1, dl[y > 0] / n)
        tail = np.cumsum(g_theta[::-1])[::-1]
        g_raw = np.concatenate([[tail[0]], tail[1:] * np.exp(raw[1:])])
        adam.step([w, raw], [x.back((du - dl) / n, width) + l2 * w, g_raw])
    return w, thresholds()
