"""Mergeable quantile sketches of bounded size, and exact quantiles of many groups at once."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np


@dataclass(frozen=True)
class Sketch:
    """At most k order statistics of the values seen, each with the number of values it stands for.

    Up to k values it is exact. Each reduction to k points moves ranks by half a
    kth of the values at most; a merge reduces only what the two hold together.
    """

    values: np.ndarray
    weights: np.ndarray

    @property
    def n(self) -> float:
        return float(self.weights.sum())

    @staticmethod
    def of(values: np.ndarray, k: int) -> Sketch:
        return Sketch(np.sort(values), np.ones(len(values)))._reduced(k)

    def merge(self, other: Sketch, k: int) -> Sketch:
        if not len(other.values):
            return self
        values, weights = np.r_[self.values, other.values], np.r_[self.weights, other.weights]
        by = np.argsort(values, kind="stable")
        # reduced only when twice as large, so that few merges round anything
        return Sketch(values[by], weights[by])._reduced(k, 2 * k)

    def _reduced(self, k: int, beyond: int | None = None) -> Sketch:
        if len(self.values) <= (beyond or k):
            return self
        total = self.n
        at = np.searchsorted(np.cumsum(self.weights), (np.arange(k) + 0.5) * total / k)
        return Sketch(self.values[at], np.full(k, total / k))

    def quantile(self, p: float) -> float:
        """The least value with at least a share p of all values up to it; nan if there are none."""
        if not len(self.values):
            return np.nan
        at = np.searchsorted(np.cumsum(self.weights), p * self.n * (1 - 1e-12))
        return float(self.values[min(at, len(self.values) - 1)])


def ranked(group: np.ndarray, values: np.ndarray, groups: int, quantiles: tuple[float, ...]) -> tuple[np.ndarray, ...]:
    """Number of values and exact quantiles (as those of ``Sketch``) of each of so many groups."""
    ordered = values[np.lexsort((values, group))]
    n = np.bincount(group, minlength=groups)
    first = np.cumsum(n) - n
    out = [n.astype("float64")]
    for p in quantiles:
        x = np.full(groups, np.nan)
        some = n > 0
        x[some] = ordered[(first + np.maximum(np.ceil(n * p * (1 - 1e-12)).astype("int64"), 1) - 1)[some]]
        out.append(x)
    return tuple(out)
