"""Averaged perceptron over hashed features."""

from __future__ import annotations

import zlib

import numpy as np

#: Rows of the weight table that features are hashed to.
FEATURE_SPACE = 1 << 16


def feature_ids(names: list[str]) -> list[int]:
    return [zlib.crc32(n.encode("utf-8", "surrogatepass")) & (FEATURE_SPACE - 1) for n in names]


class AveragedPerceptron:
    """Multi-class perceptron whose weights are averaged over all training steps."""

    def __init__(self, classes: list[str]) -> None:
        self.classes = classes
        self.weights = np.zeros((FEATURE_SPACE, len(classes)), np.float32)
        #: Lead over the first class from which another class is taken.
        self.floor = 0.0

    def train(self, examples: list[tuple[list[int], int]], epochs: int, seed: int = 7) -> AveragedPerceptron:
        rng = np.random.default_rng(seed)
        total = np.zeros_like(self.weights)
        w, step = self.weights, 1
        for _ in range(epochs):
            wrong = 0
            for i in rng.permutation(len(examples)):
                ids, y = examples[i]
                guess = int(w[ids].sum(0).argmax())
                if guess != y:
                    wrong += 1
                    for f in ids:  # a feature may stand twice
                        w[f, y] += 1
                        w[f, guess] -= 1
                        total[f, y] += step
                        total[f, guess] -= step
                step += 1
            if not wrong:
                break
        self.weights = w - total / step
        return self

    def scores(self, ids: np.ndarray) -> np.ndarray:
        """Scores (n, classes) of n examples with the same number of features each."""
        return self.weights[ids].sum(1)

    def packed(self) -> tuple[list[str], np.ndarray, np.ndarray, float]:
        """Classes, the rows that are not zero, and the floor, to be broadcast."""
        rows = np.flatnonzero(self.weights.any(1))
        return self.classes, rows, self.weights[rows], self.floor

    @classmethod
    def unpacked(cls, packed: tuple[list[str], np.ndarray, np.ndarray, float]) -> AveragedPerceptron:
        out = cls(packed[0])
        out.weights[packed[1]] = packed[2]
        out.floor = packed[3]
        return out
