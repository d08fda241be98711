"""Losses and penalties: small immutable values that describe a fit; none holds data.

Weights and targets are columns, so a loss also compiles to a Column and its value is one distributed aggregate.
"""

from __future__ import annotations

import math
from dataclasses import dataclass
from datetime import timedelta

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F


@dataclass(frozen=True)
class SquaredError:
    """Half the weighted mean of squared residuals."""

    label_horizon: timedelta | None = None
    name = "squared_error"

    def link(self, eta: Column) -> Column:
        return eta

    def mean(self, eta: np.ndarray) -> np.ndarray:
        return eta

    def loss_column(self, y: Column, eta: Column) -> Column:
        return F.lit(0.5) * (y - eta) * (y - eta)

    def value(self, y: np.ndarray, eta: np.ndarray, w: np.ndarray | None = None) -> float:
        w = checked_weights(y, w)
        return float(0.5 * (w * (y - eta) ** 2).sum() / w.sum())

    def gradient(self, y: np.ndarray, eta: np.ndarray, w: np.ndarray | None = None) -> np.ndarray:
        w = checked_weights(y, w)
        return w * (eta - y) / w.sum()

    def hessian(self, y: np.ndarray, eta: np.ndarray, w: np.ndarray | None = None) -> np.ndarray:
        w = checked_weights(y, w)
        return w / w.sum()


@dataclass(frozen=True)
class Logistic:
    """Weighted mean log loss of a binary or proportion target at log odds eta."""

    label_horizon: timedelta | None = None
    name = "logistic"

    def link(self, eta: Column) -> Column:
        small = F.exp(-F.abs(eta))
        return F.when(eta >= 0, F.lit(1.0) / (F.lit(1.0) + small)).otherwise(small / (F.lit(1.0) + small))

    def mean(self, eta: np.ndarray) -> np.ndarray:
        small = np.exp(-np.abs(eta))
        return np.where(eta >= 0, 1.0, small) / (1.0 + small)

    def loss_column(self, y: Column, eta: Column) -> Column:
        return F.greatest(eta, F.lit(0.0)) + F.log1p(F.exp(-F.abs(eta))) - y * eta

    def value(self, y: np.ndarray, eta: np.ndarray, w: np.ndarray | None = None) -> float:
        w = checked_weights(y, w)
        return float((w * (np.logaddexp(0, eta) - y * eta)).sum() / w.sum())

    def gradient(self, y: np.ndarray, eta: np.ndarray, w: np.ndarray | None = None) -> np.ndarray:
        w = checked_weights(y, w)
        return w * (self.mean(eta) - y) / w.sum()

    def hessian(self, y: np.ndarray, eta: np.ndarray, w: np.ndarray | None = None) -> np.ndarray:
        w, p = checked_weights(y, w), self.mean(eta)
        return w * p * (1 - p) / w.sum()


Loss = SquaredError | Logistic


def squared_error(label_horizon: timedelta | None = None) -> SquaredError:
    return SquaredError(label_horizon)


def logistic(label_horizon: timedelta | None = None) -> Logistic:
    return Logistic(label_horizon)


def checked_weights(y: np.ndarray, w: np.ndarray | None) -> np.ndarray:
    if w is None:
        return np.ones(len(y))
    w = np.asarray(w, float)
    if w.shape != np.shape(y):
        raise ValueError(f"{len(w)} weights for {len(y)} rows")
    if not np.isfinite(w).all() or (w < 0).any() or not (w > 0).any():
        raise ValueError("weights must be finite and not negative, and one at least positive")
    return w


@dataclass(frozen=True)
class Penalty:
    """l1 * sum|b| + l2 / 2 * sum b**2 as a sum of parts, each ("l1" or "l2", strength)."""

    parts: tuple[tuple[str, float], ...] = ()

    def __add__(self, other: Penalty) -> Penalty:
        if not isinstance(other, Penalty):
            raise TypeError(f"a penalty can't be added to {type(other).__name__}")
        return Penalty(self.parts + other.parts)

    def strength(self, kind: str) -> float:
        return sum(s for k, s in self.parts if k == kind)

    def count(self, kind: str) -> int:
        return sum(k == kind for k, _ in self.parts)

    @property
    def kind(self) -> str:
        """none, l1, l2, or mixed for any sum of parts."""
        return "none" if not self.parts else self.parts[0][0] if len(self.parts) == 1 else "mixed"

    def value(self, beta: np.ndarray) -> float:
        """Over all coefficients given, the intercept included if it is among them."""
        return float(self.strength("l1") * np.abs(beta).sum() + 0.5 * self.strength("l2") * (np.asarray(beta) ** 2).sum())

    def prox(self, beta: np.ndarray, step: float) -> np.ndarray:
        """The minimiser of step * penalty + half the squared distance."""
        shrunk = np.asarray(beta, float) / (1 + self.strength("l2") * step)
        return soft(shrunk, self.strength("l1") * step / (1 + self.strength("l2") * step))


def soft(x, cut):
    return np.sign(x) * np.maximum(np.abs(x) - cut, 0.0)


NoPenalty = Penalty()


def checked_strength(lam: float) -> float:
    lam = float(lam)
    if not math.isfinite(lam) or lam < 0:
        raise ValueError("a penalty's strength must be finite and not negative")
    return lam


def l1(lam: float) -> Penalty:
    return Penalty((("l1", checked_strength(lam)),))


def l2(lam: float) -> Penalty:
    return Penalty((("l2", checked_strength(lam)),))
