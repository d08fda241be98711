"""Supervised binning: strategies, weight of evidence and the bin expression of a fitted result.

A fit is one grouped count of events and non-events by value or by fine bin; only counts reach the driver, where bins
are merged or split. The result compiles to a CASE expression, so binning a row never leaves the JVM.
"""

from __future__ import annotations

import math
from dataclasses import dataclass, field

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from riskloom.display import html_table
from riskloom.functions.quantiles import quantiles
from riskloom.functions.ranking import running

MISSING, RARE = "(Missing)", "RARE"


def missing(name: str) -> Column:
    return F.col(name).isNull() | F.isnan(F.col(name).cast("double"))


def bin_index(x: Column, edges: tuple[float, ...]) -> Column:
    """Which of the intervals (lo, hi] that interior edges make holds x; 0 is the first."""
    out = F.lit(len(edges))
    for i in range(len(edges) - 1, -1, -1):
        out = F.when(x <= float(edges[i]), i).otherwise(out)
    return out


def interval_labels(edges: tuple[float, ...]) -> list[str]:
    cuts = ["-inf", *(f"{e:.4g}" for e in edges), "inf"]
    return [f"({a}, {b}]" if b != "inf" else f"({a}, {b})" for a, b in zip(cuts, cuts[1:])]


def evidence(events: np.ndarray, others: np.ndarray) -> tuple[np.ndarray, float]:
    """Weight of evidence of each bin and the information value; half an event and non-event are added to every bin."""
    e, o = np.asarray(events, float) + 0.5, np.asarray(others, float) + 0.5
    pe, po = e / e.sum(), o / o.sum()
    return np.log(pe / po), float(((pe - po) * np.log(pe / po)).sum())


@dataclass(frozen=True)
class BinningResult:
    """Bins with their counts. edges: of a numeric column; levels: of a categorical one, each level's bin."""

    labels: tuple[str, ...]
    events: tuple[float, ...]
    others: tuple[float, ...]
    edges: tuple[float, ...] | None = None
    levels: tuple[tuple[str, int], ...] | None = None
    missing_bin: int | None = None
    rare_bin: int | None = None
    woe: tuple[float, ...] = field(default=(), compare=False)
    iv: float = field(default=0.0, compare=False)

    def __post_init__(self):
        woe, iv = evidence(np.array(self.events), np.array(self.others))
        object.__setattr__(self, "woe", tuple(woe.tolist()))
        object.__setattr__(self, "iv", iv)

    @property
    def n_bins(self) -> int:
        return len(self.labels)

    @property
    def n_total(self) -> float:
        return sum(self.events) + sum(self.others)

    @property
    def event_rate(self) -> tuple[float, ...]:
        return tuple(e / (e + o) if e + o else math.nan for e, o in zip(self.events, self.others))

    def index(self, name: str) -> Column:
        """The bin of a row; null where a category was never seen and no bin takes it."""
        if self.edges is not None:
            return F.when(missing(name), F.lit(0 if self.missing_bin is None else self.missing_bin)).otherwise(bin_index(F.col(name).cast("double"), self.edges))
        known = F.create_map(*[F.lit(x) for pair in self.levels for x in pair]) if self.levels else F.create_map().cast("map<string,int>")
        value = F.col(name).cast("string")
        return F.when(F.col(name).isNull(), F.lit(self.missing_bin).cast("int")).otherwise(F.coalesce(F.try_element_at(known, value), F.lit(self.rare_bin).cast("int")))

    def woe_column(self, name: str) -> Column:
        at = self.index(name)
        out = F.lit(0.0)
        for i, w in enumerate(self.woe):
            out = F.when(at == i, F.lit(w)).otherwise(out)
        return out

    def indicators(self, name: str) -> list[tuple[str, Column]]:
        at = F.coalesce(self.index(name), F.lit(0))
        return [(n, (at == i + 1).cast("double")) for i, n in enumerate(self.indicator_names(name))]

    def indicator_names(self, name: str) -> list[str]:
        if self.n_bins <= 1:
            raise ValueError(f"{name} has one bin only, which is the reference; no indicator is left")
        return [f"{name}__{label}" for label in self.labels[1:]]

    def packed(self) -> tuple:
        """The bins as a value of PACKED, for tables with a row for each segment."""
        return list(self.edges) if self.edges is not None else None, list(self.woe), dict(self.levels or ()), self.missing_bin, self.rare_bin

    def _repr_html_(self) -> str:
        return html_table(("bin", "n", "events", "event_rate", "woe"), zip(self.labels, (e + o for e, o in zip(self.events, self.others)), self.events, self.event_rate, self.woe))

    def table(self, spark) -> DataFrame:
        rows = [(i, label, float(e + o), float(e), r, w, float(self.iv)) for i, (label, e, o, r, w) in enumerate(zip(self.labels, self.events, self.others, self.event_rate, self.woe))]
        return spark.createDataFrame(rows, "bin int, label string, n double, n_events double, event_rate double, woe double, iv double")


#: Bins in a column.
PACKED = "struct<edges: array<double>, woe: array<double>, levels: map<string, int>, missing: int, rare: int>"


def index_of(name: str, packed: Column, most: int | None) -> Column:
    """BinningResult.index() of bins that are in a column: by levels if most is None, else by `most` edges at most."""
    if most is None:
        level = F.coalesce(F.try_element_at(packed["levels"], F.col(name).cast("string")), packed["rare"])
        return F.when(F.col(name).isNull(), packed["missing"]).otherwise(level)
    at = F.lit(0)
    for i in range(most):
        at = at + F.coalesce((F.col(name).cast("double") > F.get(packed["edges"], F.lit(i))).cast("int"), F.lit(0))
    return F.when(missing(name), F.coalesce(packed["missing"], F.lit(0))).otherwise(at)


def counts(df: DataFrame, key: Column, target: str, weights: str | None) -> list:
    """(key, rows, weighted events, weighted others), one for each key, in order."""
    w = F.col(weights).cast("double") if weights else F.lit(1.0)
    y = F.col(target).cast("double")
    return df.groupBy(key.alias("k")).agg(F.count("*").alias("n"), F.sum(w * y).alias("e"), F.sum(w * (1 - y)).alias("o")).orderBy("k").collect()


def result_of(edges: tuple[float, ...], rows: list) -> BinningResult:
    """Numeric bins with counts by bin index; index -1 holds missing values."""
    by = {r["k"]: r for r in rows}
    n = len(edges) + 1
    pick = lambda c: [float(by[i][c]) if i in by else 0.0 for i in range(n)] + ([float(by[-1][c])] if -1 in by else [])
    labels = interval_labels(edges) + ([MISSING] if -1 in by else [])
    return BinningResult(tuple(labels), tuple(pick("e")), tuple(pick("o")), edges=edges, missing_bin=n if -1 in by else None)


def fit_edges(df: DataFrame, name: str, target: str, edges: tuple[float, ...], weights: str | None) -> BinningResult:
    key = F.when(missing(name), F.lit(-1)).otherwise(bin_index(F.col(name).cast("double"), edges))
    return result_of(edges, counts(df, key, target, weights))


def merged(edges: list[float], e: list[float], o: list[float], n: list[float], at: int) -> None:
    """Joins bins at and at + 1 in place."""
    del edges[at]
    for x in (e, o, n):
        x[at] += x.pop(at + 1)


@dataclass(frozen=True)
class Manual:
    edges: tuple[float, ...]

    def most_edges(self) -> int:
        return len(self.edges)

    def fit(self, df: DataFrame, name: str, target: str, weights: str | None = None) -> BinningResult:
        return fit_edges(df, name, target, self.edges, weights)


@dataclass(frozen=True)
class Monotonic:
    """Fine quantile bins, merged until each is large enough and the event rate is monotone in the direction of higher information value."""

    min_bin_size: float = 0.05
    max_bins: int = 20

    def fit(self, df: DataFrame, name: str, target: str, weights: str | None = None) -> BinningResult:
        edges = sorted(set(quantiles(df, name, self.shares())))
        return self.settle(edges, fit_rows(df, name, target, edges, weights))

    def most_edges(self) -> int:
        return self.max_bins - 1

    def shares(self) -> list[float]:
        return [i / self.max_bins for i in range(1, self.max_bins)]

    def settle(self, edges: list[float], fine: dict) -> BinningResult:
        """The bins that fine ones merge into. fine: n, e, o by fine bin, -1 for missing values."""
        edges = list(edges)
        total = sum(r["n"] for r in fine.values())
        least = math.floor(self.min_bin_size * total)
        e, o, n = ([float(fine[i][c]) if i in fine else 0.0 for i in range(len(edges) + 1)] for c in ("e", "o", "n"))
        while len(n) > 1 and min(n) < least:
            small = n.index(min(n))
            left = small == len(n) - 1 or small > 0 and n[small - 1] <= n[small + 1]
            merged(edges, e, o, n, small - 1 if left else small)
        ways = [self.straighten(list(edges), list(e), list(o), list(n), sign) for sign in (1, -1)]
        best = ways[1] if evidence(*ways[1][1:])[1] > evidence(*ways[0][1:])[1] else ways[0]
        rows = [{"k": i, "e": a, "o": b} for i, (a, b) in enumerate(zip(*best[1:]))]
        return result_of(tuple(best[0]), rows + [{"k": -1, "e": r["e"], "o": r["o"]} for k, r in fine.items() if k == -1])

    @staticmethod
    def straighten(edges: list[float], e: list[float], o: list[float], n: list[float], sign: int) -> tuple[list[float], np.ndarray, np.ndarray]:
        while len(edges):
            rate = (np.array(e) + 0.5) / (np.array(e) + np.array(o) + 1)
            drop = -sign * np.diff(rate)
            if drop.max() <= 0:
                break
            merged(edges, e, o, n, int(drop.argmax()))
        return edges, np.array(e), np.array(o)


def fit_rows(df: DataFrame, name: str, target: str, edges: list[float], weights: str | None) -> dict:
    key = F.when(missing(name), F.lit(-1)).otherwise(bin_index(F.col(name).cast("double"), tuple(edges)))
    return {r["k"]: r for r in counts(df, key, target, weights)}


@dataclass(frozen=True)
class Tree:
    """Greedy best-first splits by Gini decrease between adjacent values. Columns of more than `fine_values` distinct values keep their running counts in Spark, where each node's best split is an aggregate, so what the driver gets is bounded."""

    max_leaves: int = 10
    min_samples_leaf: float = 0.05
    fine_values: int = 100_000

    def most_edges(self) -> int:
        return self.max_leaves - 1

    def fit(self, df: DataFrame, name: str, target: str, weights: str | None = None) -> BinningResult:
        present = df.filter(~missing(name))
        x = F.col(name).cast("double")
        distinct = present.agg(F.approx_count_distinct(x)).first()[0]
        cuts = self.far_cuts(present, x, target, weights) if distinct > self.fine_values else self.near_cuts(counts(present, x, target, weights))
        return fit_edges(df, name, target, tuple(sorted(cuts)), weights)

    def near_cuts(self, rows: list) -> list[float]:
        value, n, e, o = (np.array([float(r[c]) for r in rows]) for c in ("k", "n", "e", "o"))
        least = math.floor(self.min_samples_leaf * n.sum())
        n, e, w = (np.concatenate([[0.0], np.cumsum(c)]) for c in (n, e, e + o))
        leaves, cuts = [(self.best(0, len(value), n, e, w, least), 0, len(value))], []
        while len(leaves) < self.max_leaves:
            gains = [leaf[0][0] for leaf in leaves]
            at = int(np.argmax(gains))
            if not math.isfinite(gains[at]):
                break
            (_, cut), a, b = leaves.pop(at)
            cuts.append((value[cut - 1] + value[cut]) / 2)
            leaves[at:at] = [(self.best(i, j, n, e, w, least), i, j) for i, j in ((a, cut), (cut, b))]
        return cuts

    def far_cuts(self, present: DataFrame, x: Column, target: str, weights: str | None) -> list[float]:
        """The same splits over a table that stays in Spark: a node is the values above one row of it up to another."""
        w, y = F.col(weights).cast("double") if weights else F.lit(1.0), F.col(target).cast("double")
        steps = present.groupBy(x.alias("k")).agg(F.count("*").alias("c"), F.sum(w * y).alias("ec"), F.sum(w).alias("wc"))
        table = running(steps, "k", {"n": F.col("c"), "e": F.col("ec"), "w": F.col("wc")}).select("k", "n", "e", "w").persist()
        impurity = lambda ev, wt: F.when(wt > 0, 2 * ev * (wt - ev) / wt).otherwise(0.0)
        try:
            last = tuple(table.agg(F.max(F.struct("k", "n", "e", "w"))).first()[0])
            least = math.floor(self.min_samples_leaf * last[1])

            def best(a: tuple, b: tuple) -> tuple[float, tuple]:
                (_, n0, e0, w0), (_, n1, e1, w1) = a, b
                inside = table.filter((F.col("k") > F.lit(a[0]) if a is not first else F.lit(True)) & (F.col("k") < F.lit(b[0])) & (F.col("n") - n0 >= least) & (n1 - F.col("n") >= least))
                gain = impurity(F.lit(e1 - e0), F.lit(w1 - w0)) - impurity(F.col("e") - e0, F.col("w") - w0) - impurity(e1 - F.col("e"), w1 - F.col("w"))
                found = inside.agg(F.max(F.struct(gain.alias("gain"), (-F.col("k")).alias("minus"), "k", "n", "e", "w"))).first()[0]
                return (found.gain, (found.k, found.n, found.e, found.w)) if found else (-math.inf, ())

            first = (-math.inf, 0, 0.0, 0.0)
            leaves, cuts = [(best(first, last), first, last)], []
            while len(leaves) < self.max_leaves:
                gains = [leaf[0][0] for leaf in leaves]
                at = int(np.argmax(gains))
                if not math.isfinite(gains[at]):
                    break
                (_, cut), a, b = leaves.pop(at)
                cuts.append((cut[0] + table.filter(F.col("k") > F.lit(cut[0])).agg(F.min("k")).first()[0]) / 2)
                leaves[at:at] = [(best(i, j), i, j) for i, j in ((a, cut), (cut, b))]
            return cuts
        finally:
            table.unpersist()

    @staticmethod
    def best(a: int, b: int, n: np.ndarray, e: np.ndarray, w: np.ndarray, least: float) -> tuple[float, int]:
        """(Gini decrease, first value of the right side) of the best split of values a to b."""
        cut = np.arange(a + 1, b)
        cut = cut[(n[cut] - n[a] >= least) & (n[b] - n[cut] >= least)]
        if not len(cut):
            return -math.inf, -1
        impurity = lambda ev, wt: np.where(wt > 0, 2 * ev * (wt - ev) / np.where(wt > 0, wt, 1), 0.0)
        gain = impurity(e[b] - e[a], w[b] - w[a]) - impurity(e[cut] - e[a], w[cut] - w[a]) - impurity(e[b] - e[cut], w[b] - w[cut])
        at = int(gain.argmax())
        return float(gain[at]), int(cut[at])


@dataclass(frozen=True)
class Categorical:
    """A bin for each level by falling frequency (then by name); levels below a share of all rows share one bin, as do levels never seen, so the driver gets 1 / group_rare levels at most."""

    group_rare: float = 0.01

    def most_edges(self) -> None:
        return None

    def fit(self, df: DataFrame, name: str, target: str, weights: str | None = None) -> BinningResult:
        total = df.count()
        w = F.col(weights).cast("double") if weights else F.lit(1.0)
        y = F.col(target).cast("double")
        levels = df.groupBy(F.col(name).cast("string").alias("k")).agg(F.count("*").alias("n"), F.sum(w * y).alias("e"), F.sum(w * (1 - y)).alias("o"))
        kind = self.kind(F.lit(total))
        rows = levels.groupBy(kind.alias("kind"), F.when(kind == 0, F.col("k")).alias("k")).agg(*[F.sum(c).alias(c) for c in ("n", "e", "o")]).collect()
        return self.settle(rows)

    def kind(self, total: Column) -> Column:
        """0 for a level (of columns k, n) that has a bin of its own, 1 for a rare one, 2 for missing values."""
        return F.when(F.col("k").isNull(), 2).when(F.col("n") < F.lit(self.group_rare) * total, 1).otherwise(0)

    @staticmethod
    def settle(rows: list) -> BinningResult:
        kept = sorted((r for r in rows if r["kind"] == 0), key=lambda r: (-r["n"], r["k"]))
        rare, none = ([r for r in rows if r["kind"] == i] for i in (1, 2))
        bins = [(r["k"], r["e"], r["o"]) for r in kept] + [(RARE, r["e"], r["o"]) for r in rare] + [(MISSING, r["e"], r["o"]) for r in none]
        labels, events, others = zip(*bins) if bins else ((), (), ())
        return BinningResult(tuple(labels), tuple(map(float, events)), tuple(map(float, others)), levels=tuple((r["k"], i) for i, r in enumerate(kept)), missing_bin=len(bins) - 1 if none else None, rare_bin=len(kept) if rare else None)


def checked_edges(edges) -> tuple[float, ...]:
    out = tuple(float(e) for e in edges)
    if not all(map(math.isfinite, out)) or any(a >= b for a, b in zip(out, out[1:])):
        raise ValueError("edges must be finite and strictly increasing")
    return out


def manual(edges) -> Manual:
    return Manual(checked_edges(edges))


def monotonic(min_bin_size: float = 0.05, max_bins: int = 20) -> Monotonic:
    if not 0 < min_bin_size < 1 or max_bins < 2:
        raise ValueError("min_bin_size lies between 0 and 1, and max_bins is 2 at least")
    return Monotonic(min_bin_size, max_bins)


def tree_bins(max_leaves: int = 10, min_samples_leaf: float = 0.05) -> Tree:
    if max_leaves < 2 or not 0 < min_samples_leaf < 1:
        raise ValueError("max_leaves is 2 at least, and min_samples_leaf lies between 0 and 1")
    return Tree(max_leaves, min_samples_leaf)


def categorical(group_rare: float = 0.01) -> Categorical:
    if not 0 <= group_rare < 1:
        raise ValueError("group_rare lies between 0 and 1")
    return Categorical(group_rare)
