"""The generative label model that the weakly supervised operators share, and a linear scorer for posterior labels."""

from __future__ import annotations

import numpy as np


def distinct_votes(votes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The distinct rows, how often each occurs, and where each row of votes is among them."""
    patterns, index, n = np.unique(votes, axis=0, return_inverse=True, return_counts=True)
    return patterns, n.astype(float), index.reshape(-1)


class LabelModel:
    """A latent label y in {0, 1} and voters who vote 1, -1 or 0 (abstain), independent given y but for correlations.

    Expectation-maximisation estimates P(vote | y) of every voter. Correlations are those of the voters' residuals given
    y; a voter counts 1 / (1 + the sum of its positive correlations with others), so that near copies of one voter
    together count about as one. The estimates and the discounts are found in turn.
    """

    def __init__(self, patterns: np.ndarray, n: np.ndarray, start: np.ndarray, prior: float | None = None, rounds: int = 3, steps: int = 50):
        """start: the first guess of P(y = 1) for each pattern. prior: P(y = 1) if it is known."""
        self.values = np.array([-1, 0, 1])
        hot = patterns[:, :, None] == self.values  # pattern, voter, vote
        q = np.clip(start.astype(float), 0.01, 0.99)
        self.discount = np.ones(patterns.shape[1])
        for _ in range(rounds):
            for _ in range(steps):
                self.prior = float(prior if prior is not None else np.clip((q @ n) / n.sum(), 1e-4, 1 - 1e-4))
                self.table = np.stack([self._votes(hot, n * (1 - q)), self._votes(hot, n * q)])
                new = self.posterior(patterns)
                if np.abs(new - q).max() < 1e-6:
                    break
                q = new
            self.correlations = self._correlations(patterns, n, q)
            self.discount = 1 / (1 + np.clip(self.correlations, 0, None).sum(axis=1))

    @staticmethod
    def _votes(hot: np.ndarray, weight: np.ndarray) -> np.ndarray:
        counts = np.einsum("pjv,p->jv", hot, weight) + 0.1
        return counts / counts.sum(axis=1, keepdims=True)

    def _correlations(self, patterns: np.ndarray, n: np.ndarray, q: np.ndarray) -> np.ndarray:
        mean = self.table @ self.values
        spread = np.zeros((patterns.shape[1],) * 2)
        for y, w in ((0, n * (1 - q)), (1, n * q)):
            r = patterns - mean[y]
            spread += (r * w[:, None]).T @ r
        sd = np.sqrt(np.maximum(np.diag(spread), 1e-9))
        out = spread / np.outer(sd, sd)
        np.fill_diagonal(out, 0)
        return np.where(np.abs(out) > 0.2, out, 0)

    def posterior(self, patterns: np.ndarray) -> np.ndarray:
        voters = np.arange(patterns.shape[1])
        ratio = np.log(self.table[1]) - np.log(self.table[0])
        z = np.log(self.prior / (1 - self.prior)) + ratio[voters, patterns.astype(int) + 1] @ self.discount
        return 1 / (1 + np.exp(-np.clip(z, -30, 30)))

    def accuracies(self) -> np.ndarray:
        """P(the vote is right | the voter votes)."""
        p = np.array([1 - self.prior, self.prior])
        right = p[0] * self.table[0][:, 0] + p[1] * self.table[1][:, 2]
        cast = (p[:, None, None] * self.table[:, :, [0, 2]]).sum(axis=(0, 2))
        return right / np.maximum(cast, 1e-12)


def train_linear(rows: list[np.ndarray], values: list[np.ndarray], target: np.ndarray, width: int, l2: float = 1e-3, steps: int = 300) -> tuple[np.ndarray, float]:
    """Weights and intercept of a logistic regression on sparse rows with soft targets, by AdaGrad on the whole sample."""
    at = np.repeat(np.arange(len(rows)), [len(r) for r in rows])
    col = np.concatenate(rows) if rows else np.zeros(0, int)
    val = np.concatenate(values) if values else np.zeros(0)
    w, b = np.zeros(width), 0.0
    seen, seen_b = np.full(width, 1e-8), 1e-8
    n = max(1, len(rows))
    for _ in range(steps):
        z = np.bincount(at, weights=w[col] * val, minlength=len(rows)) + b
        err = (1 / (1 + np.exp(-np.clip(z, -30, 30))) - target) / n
        g = np.bincount(col, weights=err[at] * val, minlength=width) + l2 * w / n
        gb = err.sum()
        seen, seen_b = seen + g * g, seen_b + gb * gb
        w, b = w - 0.5 * g / np.sqrt(seen), b - 0.5 * gb / np.sqrt(seen_b)
    return w, b
