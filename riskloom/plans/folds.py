"""Folds of a splitter, fitted and measured together.

Squared-error fits whose terms learn nothing come from slices: rows are grouped by the set of folds that train on them,
a slice is factored once, and a fold's factor is the merger of its slices, so one pass serves all folds and any number
of penalties. Other fits treat folds as segments of one long frame (`solve_segments`): a logistic fit takes one pass for
each Newton step of all folds, and learned terms come from grouped passes. Known metrics are computed for all folds in
the same jobs; a metric of the user's own is called for each fold.
"""

from __future__ import annotations

import inspect
import math
from collections.abc import Callable
from dataclasses import dataclass, field
from functools import reduce

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from riskloom.functions import metrics as m
from riskloom.functions import ranking
from riskloom.plans.factor import Factor, design, factors, stack
from riskloom.plans.reports import grouped
from riskloom.plans.solve import SegmentedSolution, Solution, by_segment, fit_segments, packs, predict, prepare, solve, solve_segments
from riskloom.plans.splits import Splitter, stamp
from riskloom.spec import LinearSpec, SegmentedSpec
from riskloom.values import SquaredError

FOLD = "_fold"
#: Metrics that reports.grouped() has, and how they follow from its columns.
KNOWN: dict[Callable, Callable[[dict], float]] = {m.auc: lambda r: r["auc"], m.gini: lambda r: 2 * r["auc"] - 1, m.ks: lambda r: r["ks"], m.brier_score: lambda r: r["brier"], m.log_loss: lambda r: r["log_loss"]}
NEED_CLASSES = (m.auc, m.gini, m.ks)


def measured(metric: Callable, sol: Solution, df: DataFrame, weights: str | None) -> float:
    """Calls a metric, with weights if it takes them; its number, or its .value."""
    if weights is not None and "weights" in inspect.signature(metric).parameters:
        out = metric(sol, df, weights=weights)
    else:
        out = metric(sol, df)
    return float(getattr(out, "value", out))


def combined(parts: list[Factor]) -> Factor:
    """The factor of all rows of some factors."""
    r = stack(None, np.concatenate([f.r for f in parts])) if len(parts) > 1 else parts[0].r
    return Factor(sum(f.n for f in parts), r, sum(f.sw for f in parts), sum(f.sy for f in parts), min(f.least for f in parts), max(f.largest for f in parts))


@dataclass
class Folds:
    rows: DataFrame
    pairs: list[tuple[Column, Column]]
    time: Column
    slices: dict = field(default_factory=dict)  # factors by what they are made of

    @classmethod
    def of(cls, splitter: Splitter, df: DataFrame) -> Folds:
        return cls(splitter.rows(df), list(splitter.predicates(df)), stamp(splitter.time_col))

    def __len__(self) -> int:
        return len(self.pairs)

    def side(self, i: int, role: int) -> DataFrame:
        return self.rows.filter(self.pairs[i][role])

    def sizes(self) -> list[dict]:
        """n_train, n_valid, last_train, first_valid of each fold, in one pass."""
        if not self.pairs:
            return []
        figures = []
        for i, (train, valid) in enumerate(self.pairs):
            figures += [F.count_if(train).alias(f"n_train{i}"), F.max(F.when(train, self.time)).alias(f"last_train{i}"), F.count_if(valid).alias(f"n_valid{i}"), F.min(F.when(valid, self.time)).alias(f"first_valid{i}"), F.max(F.when(valid, self.time)).alias(f"last_valid{i}")]
        found = self.rows.agg(*figures).first().asDict()
        return [{k: found[f"{k}{i}"] for k in ("n_train", "last_train", "n_valid", "first_valid", "last_valid")} for i in range(len(self.pairs))]

    def long(self, role: int, columns: list[str]) -> DataFrame:
        """The rows of one side of all folds, with the fold's number."""
        inside = F.array(*[F.when(pair[role], F.lit(i)) for i, pair in enumerate(self.pairs)])
        return self.rows.select(*columns, F.explode(F.array_compact(inside)).alias(FOLD))

    def fit(self, spec: LinearSpec, weights: str | None) -> list[Solution]:
        """A fit to the train side of each fold; its assumptions aren't checked."""
        if not self.pairs:
            return []
        used = list(dict.fromkeys([spec.target, *spec.reads(), *([weights] if weights else [])]))
        if isinstance(spec.loss, SquaredError) and by_segment(spec.features) and not packs(spec.features):
            found = self.from_slices(spec, weights)
        elif by_segment(spec.features):
            found = solve_segments(SegmentedSpec(FOLD, spec), self.long(0, used), weights).solutions
        else:
            found = {str(i): solve(spec, self.side(i, 0).select(*used), weights=weights, on_violation="ignore") for i in range(len(self))}
        if empty := [i for i in range(len(self)) if str(i) not in found]:
            raise ValueError(f"fold {empty[0]} has no train rows")
        return [found[str(i)] for i in range(len(self))]

    def from_slices(self, spec: LinearSpec, weights: str | None) -> dict[str, Solution]:
        key = (spec.features, spec.target, weights)
        if key not in self.slices:
            states, columns = prepare(spec, self.rows, weights)
            member = F.concat(*[F.when(train, F.lit("1")).otherwise(F.lit("0")) for train, _ in self.pairs])
            trained = self.rows.filter(reduce(lambda a, b: a | b, [train for train, _ in self.pairs]))
            made = factors(design(trained, columns, spec.target, weights, member), len(columns))
            folds = {str(i): [f for mask, f in made.items() if mask[i] == "1"] for i in range(len(self))}
            self.slices[key] = [n for n, _ in columns], states, {i: combined(own) for i, own in folds.items() if own}
        names, states, first = self.slices[key]
        return fit_segments(spec, self.rows, len(names), lambda fold: (names, states), first)

    def measure(self, metrics: dict[str, Callable], fits: list[Solution], weights: str | None) -> list[dict[str, float]]:
        """The metrics of each fold's fit on its other side."""
        out: list[dict[str, float]] = [{} for _ in fits]
        known = {k: f for k, f in metrics.items() if f in KNOWN}
        if known and fits:
            frame = self.scored(fits, weights)
            figures = figures_of(frame, FOLD, known)
            for i in range(len(fits)):
                if i not in figures:
                    raise ValueError(f"fold {i} has no validation rows")
            for name, f in known.items():
                for i, row in enumerate(out):
                    row[name] = float(KNOWN[f](figures[i]))
        for name, f in metrics.items():
            if name not in known:
                for i, row in enumerate(out):
                    row[name] = measured(f, fits[i], self.side(i, 1), weights)
        return [{name: row[name] for name in metrics} for row in out]

    def scored(self, fits: list[Solution], weights: str | None) -> DataFrame:
        """_fold, y, s, w of the other sides of all folds."""
        spec = fits[0].spec
        used = list(dict.fromkeys([spec.target, *spec.reads(), *([weights] if weights else [])]))
        w = F.col(weights) if weights else None
        if by_segment(spec.features):
            keyed = SegmentedSolution(SegmentedSpec(FOLD, spec), {str(i): s for i, s in enumerate(fits)})
            rows = predict(keyed, self.long(1, used), "_score", warn_unseen=False)
            return ranking.scored(rows, F.col(spec.target), F.col("_score"), w, (FOLD,))
        sides = [ranking.scored(self.side(i, 1), F.col(spec.target), s.score(), w).withColumn(FOLD, F.lit(i)) for i, s in enumerate(fits)]
        return reduce(DataFrame.unionByName, sides)


def figures_of(frame: DataFrame, by: str, known: dict[str, Callable]) -> dict[object, dict]:
    """Figures of each group of a frame of y, s, w; raises for what a single metric raises for."""
    odd = lambda c: F.col(c).isNull() | F.isnan(c) | (F.abs(F.col(c)) == math.inf)
    bad = frame.groupBy(by).agg(F.count_if(odd("y") | odd("s") | odd("w") | (F.col("w") < 0)).alias("bad"))
    for r in bad.filter("bad > 0").limit(1).collect():
        raise ValueError(f"{r.bad} rows of {by.strip('_')} {r[by]} have a target, score or weight that is missing, infinite or negative")
    out = {r[by]: r.asDict() for r in grouped(frame, by).collect()}
    if any(f in NEED_CLASSES for f in known.values()) and any(r["auc"] is None for r in out.values()):
        raise ValueError("both classes must be present")
    return out
