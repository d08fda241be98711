"""Terms: named features that compile to Column expressions.

A term is a frozen value. fit() reads what it needs from the training rows by aggregates (nothing for most terms) and
returns its state; columns() turns state into named Columns, so predicting is a projection of any DataFrame, batch or
streaming.
"""

from __future__ import annotations

import math
from collections.abc import Iterable
from dataclasses import dataclass
from itertools import combinations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from riskloom.functions.quantiles import quantiles
from riskloom.operators.binning import PACKED, BinningResult, index_of

Named = list[tuple[str, Column]]


class Term:
    """Base of all terms; a + b makes a TermSum."""

    def reads(self) -> tuple[str, ...]:
        return (self.col,)

    def fit(self, df: DataFrame, target: str | None = None, weights: str | None = None):
        return None

    def columns(self, state) -> Named:
        raise NotImplementedError

    def names(self, state) -> list[str]:
        return [n for n, _ in self.columns(state)]

    def width(self) -> int | None:
        """How many columns there are; None where that depends on the rows."""
        return len(self.names(None))

    #: DDL of what pack() makes of a state for a table with a row for each segment; None if columns() takes no state.
    packed: str | None = None

    def pack(self, state):
        return None

    def columns_of(self, packed: Column | None, width: int) -> list[Column]:
        """columns() of a state that is packed in a column; width: the number of columns."""
        return [c for _, c in self.columns(None)]

    def __add__(self, other):
        return TermSum(flat((self, other)))

    def __radd__(self, other):
        return TermSum(flat((other, self)))


@dataclass(frozen=True)
class TermSum(Term):
    terms: tuple[Term, ...]

    def __iter__(self):
        return iter(self.terms)


def flat(features) -> tuple[Term, ...]:
    """Names, terms, sums and lists of them as one tuple of terms."""
    if isinstance(features, str):
        return (Raw(features),)
    if isinstance(features, TermSum):
        return features.terms
    if isinstance(features, Term):
        return (features,)
    if isinstance(features, Iterable):
        return tuple(t for f in features for t in flat(f))
    raise TypeError(f"{type(features).__name__} is no feature")


@dataclass(frozen=True)
class Raw(Term):
    col: str

    def columns(self, state) -> Named:
        return [(self.col, F.col(self.col).cast("double"))]

    def names(self, state) -> list[str]:
        return [self.col]


@dataclass(frozen=True)
class Step(Term):
    """Indicators of the intervals (b_i, b_i+1]; the first is the reference."""

    col: str
    breakpoints: tuple[float, ...]

    def columns(self, state) -> Named:
        x, tops = F.col(self.col).cast("double"), [*self.breakpoints[1:], math.inf]
        return [(n, ((x > b) & (x <= top)).cast("double")) for n, b, top in zip(self.names(state), self.breakpoints, tops)]

    def names(self, state) -> list[str]:
        return [f"step({self.col})_bin{i + 1}" for i in range(len(self.breakpoints))]


@dataclass(frozen=True)
class Hinge(Term):
    col: str
    knot: float
    direction: str

    def columns(self, state) -> Named:
        x, t = F.col(self.col).cast("double"), F.lit(self.knot)
        return [(self.names(state)[0], F.greatest(F.lit(0.0), x - t if self.direction == "right" else t - x))]

    def names(self, state) -> list[str]:
        return [f"hinge({self.col}@{self.knot:g}:{self.direction})"]


@dataclass(frozen=True)
class Poly(Term):
    """Orthonormal polynomials over the training rows, each with a positive leading coefficient."""

    col: str
    degree: int

    def fit(self, df: DataFrame, target=None, weights=None) -> tuple[float, float, tuple[tuple[float, ...], ...]]:
        x = F.col(self.col).cast("double")
        mean, sd = df.agg(F.avg(x), F.stddev_pop(x)).first()
        finite(df, self.col)
        return self.settle(mean, sd, df.agg(*self.moments(F.lit(mean), F.lit(sd))).first() if sd else ())

    def moments(self, mean: Column, sd: Column) -> list[Column]:
        z = (F.col(self.col).cast("double") - mean) / sd
        return [F.sum(F.pow(z, F.lit(k))) for k in range(2 * self.degree + 1)]

    def settle(self, mean: float, sd: float, sums) -> tuple[float, float, tuple[tuple[float, ...], ...]]:
        if not sd:
            raise ValueError(f"poly({self.col}): the column is constant")
        moments = np.array([[sums[i + j] for j in range(self.degree + 1)] for i in range(self.degree + 1)])
        upper = np.linalg.cholesky(moments).T
        return float(mean), float(sd), tuple(map(tuple, np.linalg.inv(upper).T[1:].tolist()))

    def columns(self, state) -> Named:
        mean, sd, rows = state
        z = (F.col(self.col).cast("double") - F.lit(mean)) / F.lit(sd)
        return [(f"poly({self.col})_{k + 1}", horner(z, row)) for k, row in enumerate(rows)]

    def names(self, state) -> list[str]:
        return [f"poly({self.col})_{k + 1}" for k in range(self.degree)]

    packed = "array<double>"

    def pack(self, state) -> list[float]:
        return [state[0], state[1], *(c for row in state[2] for c in row)]

    def columns_of(self, packed: Column, width: int) -> list[Column]:
        n = self.degree + 1
        rows = [[packed[2 + n * k + i] for i in range(n)] for k in range(self.degree)]
        return [c for _, c in self.columns((packed[0], packed[1], rows))]


def horner(z: Column, coefficients) -> Column:
    """A polynomial with the lowest power first."""
    out = number(coefficients[-1])
    for c in reversed(coefficients[:-1]):
        out = out * z + number(c)
    return out


def number(x) -> Column:
    return x if isinstance(x, Column) else F.lit(float(x))


def finite(df: DataFrame, name: str) -> None:
    x = F.col(name).cast("double")
    if not df.filter(x.isNull() | F.isnan(x) | (F.abs(x) == math.inf)).isEmpty():
        raise ValueError(f"{name} has missing or infinite values")


def basis_at(knots: np.ndarray, degree: int, x: np.ndarray, span: int) -> np.ndarray:
    """The B-splines that live on knot interval `span`, as polynomials, at any x: rows for x, a column for each of degree + 1 splines."""
    out = np.ones((len(x), 1))
    for d in range(1, degree + 1):
        up = np.zeros((len(x), d + 1))
        for j in range(d):
            i = span - d + 1 + j
            low, high = knots[i], knots[i + d]
            share = (x - low) / (high - low)
            up[:, j + 1] += share * out[:, j]
            up[:, j] += (1 - share) * out[:, j]
        out = up
    return out


def spline_pieces(inner, degree: int) -> list[list]:
    """For each B-spline and knot interval the polynomial there, the lowest power first; None where it is 0."""
    inner, d = list(inner), degree
    knots = np.array([inner[0]] * d + inner + [inner[-1]] * d)
    n = len(inner) - 1 + d
    pieces = [[None] * (len(inner) - 1) for _ in range(n)]
    for i in range(len(inner) - 1):
        at = np.linspace(0, 1, d + 1)
        values = basis_at(knots, d, inner[i] + at * (inner[i + 1] - inner[i]), d + i)
        powers = np.linalg.solve(np.vander(at, increasing=True), values)
        for j in range(d + 1):
            pieces[i + j][i] = powers[:, j].tolist()
    return pieces


@dataclass(frozen=True)
class BSpline(Term):
    """B-spline basis without its first function; outside the training range the end polynomials go on."""

    col: str
    df: int
    degree: int = 3
    knots: tuple[float, ...] | None = None

    def fit(self, df: DataFrame, target=None, weights=None) -> tuple[float, ...]:
        """Boundary and interior knots, ascending."""
        finite(df, self.col)
        return spline_knots(df, self.col, self.knots, self.df - self.degree)

    def pieces(self, state) -> list[list]:
        return spline_pieces(state, self.degree)[1:]

    def columns(self, state) -> Named:
        x = F.col(self.col).cast("double")
        return [(f"bs({self.col})_{k}", piecewise(x, list(state), own)) for k, own in enumerate(self.pieces(state))]

    def names(self, state) -> list[str]:
        return [f"bs({self.col})_{k}" for k in range(self.df)]

    packed = "array<double>"

    def pack(self, state) -> list[float]:
        return [*state, *(c for own in self.pieces(state) for p in own if p is not None for c in p)]

    def columns_of(self, packed: Column, width: int) -> list[Column]:
        d = self.degree
        n = width - d + 2  # knots with both ends
        inner, at, pieces = [packed[i] for i in range(n)], n, []
        for k in range(1, width + 1):
            own = [None] * (n - 1)
            for i in range(max(0, k - d), min(n - 1, k + 1)):
                own[i] = [packed[at + j] for j in range(d + 1)]
                at += d + 1
            pieces.append(own)
        x = F.col(self.col).cast("double")
        return [piecewise(x, inner, own) for own in pieces]


def piecewise(x: Column, inner: list[float], pieces: list) -> Column:
    """The polynomial of the interval of x, in the share of the interval passed; 0 where a piece is None."""
    out = None
    for i in range(len(pieces) - 1, -1, -1):
        z = (x - F.lit(inner[i])) / F.lit(inner[i + 1] - inner[i])
        value = F.lit(0.0) if pieces[i] is None else horner(z, pieces[i])
        out = value if out is None else F.when(x < F.lit(inner[i + 1]), value).otherwise(out)
    return F.when(x.isNull(), F.lit(None).cast("double")).otherwise(out)


def spline_knots(df: DataFrame, name: str, given: tuple[float, ...] | None, n: int) -> tuple[float, ...]:
    x = F.col(name).cast("double")
    low, high = df.agg(F.min(x), F.max(x)).first()
    return increasing(name, low, list(given) if given is not None else quantiles(df, name, inner_shares(n)), high)


def inner_shares(n: int) -> list[float]:
    return [float(s) for s in np.linspace(0, 1, n + 2)[1:-1]]


def increasing(name: str, low: float, inner: list[float], high: float) -> tuple[float, ...]:
    out = [low, *inner, high]
    if low is None or any(a >= b for a, b in zip(out, out[1:])):
        raise ValueError(f"{name}: knots {out} don't increase; choose fewer")
    return tuple(map(float, out))


@dataclass(frozen=True)
class NaturalSpline(Term):
    """Natural cubic splines, linear outside the training range: df orthonormal combinations of B-splines, none along the constant."""

    col: str
    df: int
    knots: tuple[float, ...] | None = None

    def fit(self, df: DataFrame, target=None, weights=None) -> tuple[float, ...]:
        finite(df, self.col)
        return spline_knots(df, self.col, self.knots, self.df - 1)

    def basis(self, state) -> tuple[np.ndarray, np.ndarray]:
        """Polynomials (column, interval, power) inside the training range, and slopes (column, end) beyond its ends.

        Coefficients of cubic B-splines whose second derivative vanishes at both ends, orthonormal and orthogonal to
        those of the constant (all 1), which depends on the knots alone: no pass over the rows. Penalties on
        coefficients rely on this very basis."""
        knots = np.array(state)
        pieces = np.array([[[0.0] * 4 if p is None else p for p in own] for own in spline_pieces(state, 3)])
        first, last = knots[1] - knots[0], knots[-1] - knots[-2]
        bends = np.stack([2 * pieces[:, 0, 2] / first**2, (2 * pieces[:, -1, 2] + 6 * pieces[:, -1, 3]) / last**2])
        natural = np.linalg.svd(bends)[2][2:].T
        constant = natural.sum(0)
        off = np.linalg.qr(np.column_stack([constant / np.linalg.norm(constant), np.eye(len(constant))]))[0][:, 1:]
        own = np.einsum("sk,sip->kip", natural @ off, pieces)
        return own, np.stack([own[:, 0, 1] / first, own[:, -1, 1:] @ [1, 2, 3] / last], 1)

    def columns(self, state) -> Named:
        own, slopes = self.basis(state)
        return [(n, self.extended(list(state), p, e)) for n, p, e in zip(self.names(state), own.tolist(), slopes.tolist())]

    def extended(self, knots: list, pieces: list, slopes: list) -> Column:
        """The cubic of the interval of x; straight lines outside all of them."""
        low, high = pieces[0][0] - slopes[0], pieces[-1][0] + pieces[-1][1] + pieces[-1][2] + pieces[-1][3]
        return piecewise(F.col(self.col).cast("double"), [knots[0] - 1, *knots, knots[-1] + 1], [[low, slopes[0]], *pieces, [high, slopes[1]]])

    def names(self, state) -> list[str]:
        return [f"ns({self.col})_{k}" for k in range(self.df)]

    packed = "array<double>"

    def pack(self, state) -> list[float]:
        own, slopes = self.basis(state)
        return [*state, *np.concatenate([own.reshape(self.df, -1), slopes], 1).ravel().tolist()]

    def columns_of(self, packed: Column, width: int) -> list[Column]:
        knots, out = [packed[i] for i in range(width + 1)], []
        for at in range(width + 1, (width + 1) + width * (4 * width + 2), 4 * width + 2):
            out.append(self.extended(knots, [[packed[at + 4 * i + k] for k in range(4)] for i in range(width)], [packed[at + 4 * width], packed[at + 4 * width + 1]]))
        return out


@dataclass(frozen=True)
class Product(Term):
    """Products of the columns of its operands; with main effects and all lower orders unless only the highest is wanted."""

    terms: tuple[Term, ...]
    lower: bool

    def reads(self) -> tuple[str, ...]:
        return tuple(dict.fromkeys(c for t in self.terms for c in t.reads()))

    def fit(self, df: DataFrame, target=None, weights=None) -> tuple:
        return tuple(t.fit(df, target, weights) for t in self.terms)

    def columns(self, state) -> Named:
        return self.multiplied([t.columns(s) for t, s in zip(self.terms, state)], lambda x, y: x * y)

    def multiplied(self, parts: list[list[tuple]], times) -> list[tuple]:
        out: list[tuple] = []
        for order in range(1 if self.lower else len(parts), len(parts) + 1):
            for chosen in combinations(parts, order):
                made = chosen[0]
                for more in chosen[1:]:
                    made = [(f"{a}*{b}", times(x, y)) for a, x in made for b, y in more]
                out += made
        return out

    def names(self, state) -> list[str]:
        return [n for n, _ in self.multiplied([[(n, 0) for n in t.names(s)] for t, s in zip(self.terms, state)], lambda x, y: 0)]

    @property
    def packed(self) -> str | None:
        own = [f"p{i}: {t.packed}" for i, t in enumerate(self.terms) if t.packed]
        return f"struct<{', '.join(own)}>" if own else None

    def pack(self, state) -> tuple:
        return tuple(t.pack(s) for t, s in zip(self.terms, state) if t.packed)

    def columns_of(self, packed: Column | None, width: int) -> list[Column]:
        if packed is None:
            return [c for _, c in self.columns((None,) * len(self.terms))]
        sizes = self.widths(width)
        parts = [[("", c) for c in t.columns_of(packed[f"p{i}"] if t.packed else None, w)] for i, (t, w) in enumerate(zip(self.terms, sizes))]
        return [c for _, c in self.multiplied(parts, lambda x, y: x * y)]

    def widths(self, width: int) -> list[int]:
        """The operands' numbers of columns, of which one may differ between segments."""
        own = [t.width() for t in self.terms]
        if own.count(None) > 1:
            raise NotImplementedError("a product of several binned terms, each with bins of its own in every segment")
        if None in own:
            at, w = own.index(None), 1
            while len(self.multiplied([[("", 0)] * (w if i == at else n) for i, n in enumerate(own)], lambda x, y: 0)) < width:
                w += 1
            own[at] = w
        return own

    def width(self) -> int | None:
        own = [t.width() for t in self.terms]
        return None if None in own else len(self.multiplied([[("", 0)] * n for n in own], lambda x, y: 0))


@dataclass(frozen=True)
class Woe(Term):
    """Weight of evidence of the row's bin. fitted: bins made beforehand (fit_binnings); else each fit makes its own."""

    col: str
    bins: object
    fitted: BinningResult | None = None

    def fit(self, df: DataFrame, target=None, weights=None) -> BinningResult:
        return self.fitted or self.bins.fit(df, self.col, target, weights)

    def columns(self, state: BinningResult) -> Named:
        return [(self.col, state.woe_column(self.col))]

    def names(self, state) -> list[str]:
        return [self.col]

    packed = PACKED

    def pack(self, state: BinningResult) -> tuple:
        return state.packed()

    def columns_of(self, packed: Column, width: int) -> list[Column]:
        return [F.coalesce(F.get(packed["woe"], index_of(self.col, packed, self.most())), F.lit(0.0))]

    def most(self) -> int | None:
        """A bound on the number of edges; None for levels."""
        if self.fitted is None:
            return self.bins.most_edges()
        return None if self.fitted.edges is None else len(self.fitted.edges)


@dataclass(frozen=True)
class Binned(Woe):
    """Indicators of all bins but the first."""

    def columns(self, state: BinningResult) -> Named:
        return state.indicators(self.col)

    def names(self, state: BinningResult) -> list[str]:
        return state.indicator_names(self.col)

    def width(self) -> int | None:
        return self.fitted.n_bins - 1 if self.fitted else None

    def columns_of(self, packed: Column, width: int) -> list[Column]:
        at = F.coalesce(index_of(self.col, packed, self.most()), F.lit(0))
        return [(at == i + 1).cast("double") for i in range(width)]


def step(col: str, breakpoints) -> Step:
    b = tuple(map(float, breakpoints))
    if not b or any(x >= y for x, y in zip(b, b[1:])):
        raise ValueError("breakpoints must be strictly increasing, and one at least")
    return Step(col, b)


def hinge(col: str, knot: float, direction: str = "right") -> Hinge:
    if direction not in ("left", "right"):
        raise ValueError("direction is left or right")
    return Hinge(col, float(knot), direction)


def poly(col: str, degree: int) -> Poly:
    if degree < 1:
        raise ValueError("degree is 1 at least")
    return Poly(col, degree)


def bs(col: str, df: int, degree: int = 3, knots=None) -> BSpline:
    if knots is not None:
        df = len(tuple(knots)) + degree
    if df < degree + (knots is None):
        raise ValueError("df must be above the degree")
    return BSpline(col, df, degree, None if knots is None else tuple(map(float, knots)))


def ns(col: str, df: int, knots=None) -> NaturalSpline:
    if knots is not None:
        df = len(tuple(knots)) + 1
    if df < 2:
        raise ValueError("df is 2 at least")
    return NaturalSpline(col, df, None if knots is None else tuple(map(float, knots)))


smooth = ns


def product(operands, lower: bool) -> Product:
    terms = tuple(x for t in flat(operands) for x in (t.terms if isinstance(t, Product) and t.lower == lower else (t,)))
    if len(terms) < 2:
        raise ValueError("two operands at least are needed")
    return Product(terms, lower)


def interact(*operands) -> Product:
    return product(operands, True)


def cross(*operands) -> Product:
    return product(operands, False)


def woe(col: str, bins) -> Woe:
    return Woe(col, bins)


def binned(col: str, bins) -> Binned:
    return Binned(col, bins)
