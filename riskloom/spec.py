"""Model descriptions: immutable, checked when made, and free of data."""

from __future__ import annotations

from dataclasses import dataclass, replace

from pyspark.sql import DataFrame

from riskloom.display import html_table
from riskloom.operators.shared import learn
from riskloom.operators.terms import Term, Woe, flat
from riskloom.values import Loss, NoPenalty, Penalty, squared_error


@dataclass(frozen=True)
class LinearSpec:
    target: str
    features: tuple[Term, ...]
    loss: Loss
    penalty: Penalty
    intercept: bool = True

    def reads(self) -> list[str]:
        return list(dict.fromkeys(c for t in self.features for c in t.reads()))

    def _repr_html_(self) -> str:
        rows = [("target", self.target), ("loss", self.loss), ("penalty", self.penalty), ("intercept", self.intercept)]
        return html_table(("part", "value"), rows + [("term", t) for t in self.features])


@dataclass(frozen=True)
class SegmentedSpec:
    by: str
    base: LinearSpec

    def _repr_html_(self) -> str:
        return html_table(("part", "value"), [("segments", self.by)]) + self.base._repr_html_()


def linear(target: str, features, loss: Loss | None = None, penalty: Penalty | None = None, intercept: bool = True) -> LinearSpec:
    terms = flat(features)
    if not terms:
        raise ValueError("a model needs one feature at least")
    if not isinstance(target, str) or not target:
        raise ValueError("the target is a column's name")
    return LinearSpec(target, terms, loss or squared_error(), penalty or NoPenalty, intercept)


def segmented(by: str, base: LinearSpec) -> SegmentedSpec:
    if by == base.target or by in base.reads():
        raise ValueError(f"{by} can't be the segment and a part of the model")
    return SegmentedSpec(by, base)


def fit_binnings(spec: LinearSpec, df: DataFrame, weights: str | None = None) -> LinearSpec:
    """The spec with the bins of its own WoE and indicator terms fitted, all in the same passes; operands of products stay as they are."""
    open_terms = tuple(t for t in spec.features if isinstance(t, Woe) and t.fitted is None)
    bins = iter(learn(open_terms, df, spec.target, weights)[""]) if open_terms else iter(())
    return replace(spec, features=tuple(replace(t, fitted=next(bins)) if t in open_terms else t for t in spec.features))
