"""Held-out reports: one model, by segment, over time, and several models compared."""

from __future__ import annotations

import math
from dataclasses import dataclass, field
from functools import cached_property, reduce

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from riskloom.display import html_table
from riskloom.functions import metrics as m
from riskloom.functions import ranking
from riskloom.functions.quantiles import quantiles
from riskloom.plans.solve import Solution
from riskloom.plans.splits import Splitter, stamp


@dataclass(frozen=True)
class Performance:
    """Discrimination, calibration, stability and distribution of one model's scores."""

    n_obs: int
    n_events: int
    auc: float
    auc_ci: tuple[float, float] | None
    gini: float
    ks: float
    ks_at: float
    cohens_d: float
    brier: float
    log_loss: float
    ece: float
    slope: float
    intercept: float
    psi: float | None
    mean: float
    median: float
    least: float
    largest: float
    calibration: DataFrame = field(repr=False)
    lift: DataFrame = field(repr=False)
    rows: DataFrame = field(repr=False)
    ties: tuple[str, ...] = field(repr=False)

    @cached_property
    def gains(self) -> DataFrame:
        """A point for each row, so rows are put in order only when it is asked for."""
        return ranking.gains(self.rows, self.ties)

    def figures(self) -> dict[str, float]:
        return {k: v for k, v in vars(self).items() if isinstance(v, (int, float))}

    @property
    def psi_tag(self) -> str:
        return "" if self.psi is None else "low" if self.psi < 0.1 else "moderate" if self.psi < 0.25 else "high"

    def to_df(self, spark) -> DataFrame:
        return spark.createDataFrame([(k, float(v)) for k, v in self.figures().items()], "figure string, value double")

    def __str__(self) -> str:
        lines = [f"{k:<12}{v:>16.6g}" for k, v in self.figures().items()]
        return "\n".join([*lines, f"{'psi':<12}{self.psi_tag:>16}"] if self.psi is not None else lines)

    def _repr_html_(self) -> str:
        return html_table(("figure", "value"), self.figures().items())


def reference_scores(reference, sol: Solution) -> DataFrame:
    """Column s of a reference: rows to score, (solution, rows), or (rows, name of a score column)."""
    if isinstance(reference, DataFrame):
        return reference.select(sol.score().alias("s"))
    a, b = reference
    return b.select(a.score().alias("s")) if isinstance(a, Solution) else a.select(F.col(b).cast("double").alias("s"))


def performance(sol: Solution, df: DataFrame, *, weights: str | None = None, reference=None, n_bins: int = 10, n_deciles: int = 10, psi_bins: int = 10, auc_ci_level: float = 0.95, eps: float = 1e-12, ties: tuple[str, ...] = ()) -> Performance:
    return performance_of(m.frame_of(sol, df, weights, ties), None if reference is None else reference_scores(reference, sol), n_bins, n_deciles, psi_bins, auc_ci_level, eps, ties)


def performance_of(frame: DataFrame, reference: DataFrame | None = None, n_bins: int = 10, n_deciles: int = 10, psi_bins: int = 10, level: float = 0.95, eps: float = 1e-12, ties: tuple[str, ...] = ()) -> Performance:
    """All figures of a frame of y, s, w; the frame is stored while the jobs run."""
    frame = m.checked(frame).persist()
    try:
        w = F.col("w")
        flat = frame.agg(F.count("*").alias("n"), F.sum((F.col("y") == 1).cast("int")).alias("e"), (F.sum(w * m.brier_column()) / F.sum(w)).alias("brier"), (F.sum(w * m.log_loss_column(eps)) / F.sum(w)).alias("ll"), (F.sum(w * F.col("s")) / F.sum(w)).alias("mean"), F.min("s").alias("lo"), F.max("s").alias("hi"), (F.min("w") == F.max("w")).alias("even")).first()
        row = ranking.discrimination(frame).first()
        m.both_classes(row)
        ci = None
        if flat["even"]:
            area, cov = m.delong_of(frame.select("y", "s"), ("s",))
            ci = m.auc_interval(float(area[0]), float(cov[0, 0]), level)
        slope, intercept = m.calibration_fit(frame, eps)
        try:
            effect = m.cohens_d_of(frame).value
        except ValueError:
            effect = math.nan
        shift = None if reference is None else m.psi_of(reference, frame.select("s"), psi_bins).value
        return Performance(flat["n"], flat["e"], row["auc"], ci, row["gini"], row["ks"], row["ks_at"], effect, flat["brier"], flat["ll"], m.ece_of(frame, n_bins, ties).value, slope, intercept, shift, flat["mean"], quantiles(frame, "s", [0.5])[0], flat["lo"], flat["hi"], ranking.calibration_bins(frame, n_bins, ties), ranking.lift_bins(frame, n_deciles, ties), frame, ties)
    finally:
        frame.unpersist()


def sets(frame: DataFrame, by: str, total: bool, *more: str):
    """Groups of a column, and with total also all rows as one more group; TOTAL tells that from a null value."""
    own = [F.col(c) for c in (by, *more)]
    return frame.groupingSets([own, own[1:]], *own) if total else frame.groupBy(*own)


#: 1 in the row over all groups.
TOTAL = "_total"


def is_total(by: str, total: bool) -> Column:
    return (F.grouping(by).cast("int") if total else F.lit(0)).alias(TOTAL)


def grouped(frame: DataFrame, by: str, total: bool = False) -> DataFrame:
    """_total, n_obs, n_events, auc, ks, brier, log_loss, mean_p of each value of a column of a frame of y, s, w, and with total over all of them; all groups in the same jobs."""
    w = F.col("w")
    mean = lambda c: F.sum(w * c) / F.sum(w)
    flat = sets(frame, by, total).agg(is_total(by, total), F.count("*").alias("n_obs"), F.sum((F.col("y") == 1).cast("bigint")).alias("n_events"), mean(m.brier_column()).alias("brier"), mean(m.log_loss_column()).alias("log_loss"), mean(F.col("s")).alias("mean_p"))
    masses = sets(frame, by, total, "s").agg(is_total(by, total), *ranking.class_masses())
    ranks = ranking.discrimination_of(ranking.curve_of(masses, (TOTAL, by)), (TOTAL, by)).select(F.col(by).alias("_by"), F.col(TOTAL).alias("_of"), "auc", "ks")
    return flat.join(ranks, F.col(by).eqNullSafe(F.col("_by")) & (F.col(TOTAL) == F.col("_of")), "left").select(by, TOTAL, "n_obs", "n_events", "auc", "ks", "brier", "log_loss", "mean_p")


def shift_from(reference, sol: Solution, frame: DataFrame, by: str, psi_bins: int, total: bool = False) -> DataFrame:
    """by, _total and psi: the population stability index of each group's scores against the reference."""
    old = reference_scores(reference, sol)
    edges = m.psi_edges(old, psi_bins)
    at = reduce(lambda c, e: c + (F.col("s") >= F.lit(float(e))).cast("int"), edges, F.lit(0)).alias("bin")
    shares = {r.bin: r.n for r in old.groupBy(at).agg(F.count("*").alias("n")).collect()}
    n_old = sum(shares.values())
    bins = [max(shares.get(i, 0) / n_old, 1e-6) for i in range(len(edges) + 1)]
    counts = sets(frame.withColumn("bin", at), by, total).agg(is_total(by, total), F.count("*").alias("n"), *[F.sum((F.col("bin") == i).cast("int")).alias(f"b{i}") for i in range(len(bins))])
    part = lambda i: (F.greatest(F.col(f"b{i}") / F.col("n"), F.lit(1e-6)) - F.lit(bins[i])) * F.log(F.greatest(F.col(f"b{i}") / F.col("n"), F.lit(1e-6)) / F.lit(bins[i]))
    return counts.select(by, TOTAL, reduce(lambda a, b: a + b, [part(i) for i in range(len(bins))]).alias("psi"))


def performance_by_segment(sol: Solution, df: DataFrame, by: str, *, weights: str | None = None, strict: bool = True, reference=None, psi_bins: int = 10, aggregate: bool = False) -> DataFrame:
    """A row for each segment, with psi if there is a reference. A segment with one class raises if strict, else has null auc and ks. aggregate: a row over all segments comes with them, and is_total tells it from the row of null segments."""
    frame = m.frame_of(sol, df, weights, (by,))
    out = grouped(frame, by, aggregate)
    if reference is not None:
        shift = shift_from(reference, sol, frame, by, psi_bins, aggregate).withColumnsRenamed({by: "_by", TOTAL: "_of"})
        out = out.join(shift, F.col(by).eqNullSafe(F.col("_by")) & (F.col(TOTAL) == F.col("_of"))).drop("_by", "_of")
    if strict and (bad := [str(r[0]) for r in out.filter(f"auc is null and {TOTAL} = 0").select(by).limit(5).collect()]):
        raise ValueError(f"one class only in {', '.join(bad)}")
    return out.withColumn("is_total", F.col(TOTAL) == 1).drop(TOTAL) if aggregate else out.drop(TOTAL)


def report_by_segment(sol: Solution, df: DataFrame, by: str, **options) -> dict[object, Performance]:
    """A full report of each segment, for few segments: at most 100."""
    keys = [r[0] for r in df.select(by).distinct().limit(101).collect()]
    if len(keys) > 100:
        raise ValueError("over 100 segments; performance_by_segment has no such limit")
    return {k: performance(sol, df.filter(F.col(by).eqNullSafe(F.lit(k))), **options) for k in sorted(keys, key=str)}


def report_over_time(sol: Solution, df: DataFrame, splitter: Splitter, **options) -> dict[int, Performance]:
    """A full report of each validation window that has rows."""
    rows = windows(df, splitter)
    found = [r[0] for r in rows.select("window").distinct().orderBy("window").collect()]  # a row for each window
    return {k: performance(sol, rows.filter(F.col("window") == k).drop("window"), **options) for k in found}


def windows(df: DataFrame, splitter: Splitter) -> DataFrame:
    """The validation rows of a splitter with their window's number."""
    return splitter.assign(df).filter("role = 'valid'").drop("role").withColumnRenamed("fold", "window")


def performance_over_time(sol: Solution, df: DataFrame, splitter: Splitter, *, reference=None, weights: str | None = None, psi_bins: int = 10) -> DataFrame:
    """A row for each validation window with rows: window, middle of its observed span, figures, and psi with a reference."""
    rows = windows(df, splitter).withColumn("_t", stamp(splitter.time_col))
    frame = m.frame_of(sol, rows, weights, ("window", "_t"))
    span = frame.groupBy("window").agg(F.min("_t").alias("a"), F.max("_t").alias("b"))
    middle = F.timestamp_micros(((F.unix_micros("a") + F.unix_micros("b")) / 2).cast("bigint"))
    out = span.select("window", middle.alias("middle")).join(grouped(frame, "window").drop(TOTAL), "window")
    if reference is None:
        return out
    return out.join(shift_from(reference, sol, frame, "window", psi_bins).drop(TOTAL), "window")


@dataclass(frozen=True)
class Comparison:
    reports: dict[str, Performance]
    p_values: np.ndarray  # DeLong tests of all pairs, NaN on the diagonal

    def to_df(self, spark) -> DataFrame:
        return spark.createDataFrame([(n, k, float(v)) for n, r in self.reports.items() for k, v in r.figures().items()], "model string, figure string, value double")

    def __str__(self) -> str:
        names = list(self.reports)
        width = max(12, *map(len, names)) + 4
        lines = ["".join([f"{'':<12}", *(f"{n:>{width}}" for n in names)])]
        lines += ["".join([f"{k:<12}", *(f"{r.figures().get(k, math.nan):>{width}.6g}" for r in self.reports.values())]) for k in self.reports[names[0]].figures()]
        lines += ["".join([f"{'p ' + a:<12}", *(f"{p:>{width}.4g}" for p in row)]) for a, row in zip(names, self.p_values)]
        return "\n".join(lines)

    def _repr_html_(self) -> str:
        names = list(self.reports)
        figures = html_table(("figure", *names), [(k, *(r.figures().get(k, math.nan) for r in self.reports.values())) for k in self.reports[names[0]].figures()])
        return figures + html_table(("p", *names), [(n, *map(float, row)) for n, row in zip(names, self.p_values)])

    def p_values_df(self, spark) -> DataFrame:
        names = list(self.reports)
        return spark.createDataFrame([(a, b, float(self.p_values[i, j])) for i, a in enumerate(names) for j, b in enumerate(names) if i < j], "model_a string, model_b string, p_value double")


def compare(models: dict[str, Solution], df: DataFrame, *, weights: str | None = None) -> Comparison:
    """Reports of several models on the same rows and the tests between them (none with weights)."""
    if len(models) < 2 or len({s.spec.target for s in models.values()}) != 1:
        raise ValueError("two models at least, all with the same target")
    names, target = list(models), next(iter(models.values())).spec.target
    p = np.full((len(names), len(names)), np.nan)
    if weights is None:
        frame = df.select(F.col(target).cast("double").alias("y"), *[s.score().alias(f"s{i}") for i, s in enumerate(models.values())])
        area, cov = m.delong_of(frame, tuple(f"s{i}" for i in range(len(names))))
        for i in range(len(names)):
            for j in range(len(names)):
                if i != j:
                    p[i, j] = m.delong_from(area, cov, i, j).p_value
    return Comparison({n: performance(s, df, weights=weights) for n, s in models.items()}, p)
