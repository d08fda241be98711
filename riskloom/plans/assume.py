"""Assumption checks. Each is a value with a name, a severity and a stage; its figure comes from aggregates."""

from __future__ import annotations

import math
import warnings as warn
from collections.abc import Callable
from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from riskloom.display import html_table
from riskloom.functions.quantiles import quantiles
from riskloom.functions.special import chi2_tail, shapiro_wilk
from riskloom.operators.binning import BinningResult
from riskloom.plans.factor import dependent, design, factors
from riskloom.plans.solve import INTERCEPT, AssumptionError, Solution, outside
from riskloom.sources.store import discard, stored
from riskloom.values import Logistic, SquaredError

HARD, SOFT, INFO = "HARD", "SOFT", "INFO"


@dataclass(frozen=True)
class CheckResult:
    name: str
    severity: str
    passed: bool
    message: str
    figure: float | None = None

    def _repr_html_(self) -> str:
        return html_table(("check", "severity", "result", "message"), [(self.name, self.severity, "passed" if self.passed else "failed", self.message)])


@dataclass(frozen=True)
class Assumption:
    name: str
    severity: str
    check: Callable

    def __call__(self, *what) -> CheckResult:
        try:
            passed, message, figure = self.check(*what)
        except Exception as e:  # a check that can't run has not passed
            return CheckResult(self.name, self.severity, False, f"the check failed: {e}")
        return CheckResult(self.name, self.severity, bool(passed), message, None if figure is None else float(figure))


def full_rank(sol: Solution, df: DataFrame, w):
    names = list(sol.coefficients)
    bad = dependent(sol.factor.r[:, :-1] if INTERCEPT in names else sol.factor.r[:, 1:-1], sol.n_obs)
    return not bad, f"dependent columns: {', '.join(names[i] for i in bad) or 'none'}", len(bad)


def proportion_target(sol: Solution, df: DataFrame, w):
    f = sol.factor
    good, span = 0 <= f.least and f.largest <= 1, f"the target spans [{f.least:g}, {f.largest:g}]"
    return good, span if good else f"{span}; values outside 0 to 1: {outside(df, sol.spec.target)}", None


def no_separation(sol: Solution, df: DataFrame, w):
    largest = max((abs(v) for v in sol.slopes.values()), default=0.0)
    edge = df.agg(F.avg(((sol.score() < 1e-4) | (sol.score() > 1 - 1e-4)).cast("double"))).first()[0]
    return largest <= 1e3 and edge <= 0.95, f"largest slope {largest:.4g}, share of scores at 0 or 1 {edge:.3f}; if the classes can be separated, add a ridge penalty", largest


def class_balance(sol: Solution, df: DataFrame, w):
    mean = sol.factor.sy / sol.factor.sw
    return min(mean, 1 - mean) >= 0.01, f"event rate {mean:.4f}", mean


def link_adequacy(sol: Solution, df: DataFrame, w):
    """Hosmer-Lemeshow over the deciles (a, b] of the scores; equal edges count once."""
    rows = df.select(sol.score().alias("s"), F.col(sol.spec.target).cast("double").alias("y"))
    edges = sorted(set(quantiles(rows, "s", [i / 10 for i in range(11)])))[1:-1]
    at = F.lit(0)
    for e in edges:
        at = at + (F.col("s") > F.lit(e)).cast("int")
    stat, groups = 0.0, 0
    for r in rows.groupBy(at.alias("g")).agg(F.count("*").alias("n"), F.sum("y").alias("o"), F.sum("s").alias("e")).collect():
        groups += 1
        v = r.e * (1 - r.e / r.n)
        stat += (r.o - r.e) ** 2 / v if v > 0 else 0.0
    p = chi2_tail(stat, groups - 2) if groups > 2 else math.nan
    return not p < 0.05, f"chi-square {stat:.4g} over {groups} groups, p = {p:.4g}", stat


def comparable_scales(sol: Solution, df: DataFrame, w):
    gram, _, mx, _, _ = sol.factor.centred()
    sd = np.sqrt(np.maximum(np.diag(gram), 0) / sol.factor.r[0, 0] ** 2)
    sd = sd[sd > 1e-12 * np.maximum(1, np.abs(mx))]
    ratio = sd.max() / sd.min() if len(sd) else 1.0
    return ratio <= 100, f"standard deviations differ by a factor of {ratio:.4g}", ratio


def low_vif(sol: Solution, df: DataFrame, w):
    top = max(vif(sol).values(), default=1.0)
    return top <= 10, f"largest variance inflation {top:.4g}", top


def vif(sol: Solution) -> dict[str, float]:
    """Variance inflation of each column: the diagonal of the inverse correlation matrix."""
    gram = sol.factor.centred()[0]
    d = np.sqrt(np.diag(gram))
    return dict(zip(sol.slopes, map(float, np.diag(np.linalg.inv(gram / np.outer(d, d))))))


def breusch_pagan(sol: Solution, df: DataFrame) -> tuple[float, float]:
    """(n R squared of squared residuals on the design, its tail probability)."""
    squared = df.withColumn("_e2", F.pow(F.col(sol.spec.target).cast("double") - sol.eta(), F.lit(2.0)))
    f = factors(design(squared, sol.columns, "_e2", None), len(sol.columns))[""]
    rss, tss = f.r[-1, -1] ** 2, f.centred()[4]
    lm = f.n * (1 - rss / tss) if tss else 0.0
    return float(lm), chi2_tail(lm, len(sol.columns))


def homoscedastic(sol: Solution, df: DataFrame, w):
    lm, p = breusch_pagan(sol, df)
    return p >= 0.05, f"Breusch-Pagan {lm:.4g}, p = {p:.4g}", lm


def durbin_watson(sol: Solution, df: DataFrame, order_by: tuple[str, ...]) -> float:
    """Sum of squared first differences of the residuals in an order, over their sum of squares. Rows are range-partitioned by the order and written once; each range adds its own differences and the step from the range before it."""
    rows = df.select(*order_by, (F.col(sol.spec.target).cast("double") - sol.eta()).alias("_e"), F.monotonically_increasing_id().alias("_nth"))
    keys = [*order_by, "_nth"]
    rows = stored(rows.repartitionByRange(*keys).withColumn("_part", F.spark_partition_id()), "residuals")
    step = F.col("_e") - F.lag("_e").over(Window.partitionBy("_part").orderBy(*keys))
    at = F.struct(*keys)
    parts = rows.withColumn("_d", step * step).groupBy("_part").agg(F.sum("_d").alias("d"), F.sum(F.col("_e") * F.col("_e")).alias("s"), F.min_by("_e", at).alias("first"), F.max_by("_e", at).alias("last")).orderBy("_part").collect()  # a row for each partition
    discard(rows)
    total = sum(r.d or 0.0 for r in parts) + sum((b["first"] - a["last"]) ** 2 for a, b in zip(parts, parts[1:]))
    return total / sum(r.s for r in parts)


def anderson_darling(sol: Solution, df: DataFrame) -> float:
    """A squared of the standardised residuals with the small-sample factor; the sum over ranks is distributed."""
    from riskloom.functions.ranking import running

    e = df.select((F.col(sol.spec.target).cast("double") - sol.eta()).alias("e"))
    n, mean, sd = e.agg(F.count("*"), F.avg("e"), F.stddev_samp("e")).first()
    ranked = running(e.select(((F.col("e") - mean) / sd).alias("z")), "z", {"i": F.lit(1)})
    # Normal tail by the complementary error function's continued fraction is no built-in; a Mills-ratio polynomial is accurate to 1e-7.
    z = F.abs(F.col("z"))
    t = 1 / (1 + F.lit(0.2316419) * z)
    tail = F.exp(-z * z / 2) / F.lit(math.sqrt(2 * math.pi)) * t * (0.319381530 + t * (-0.356563782 + t * (1.781477937 + t * (-1.821255978 + t * 1.330274429))))
    tail = F.greatest(tail, F.lit(1e-300))
    low = F.when(F.col("z") < 0, tail).otherwise(1 - tail)
    high = F.when(F.col("z") < 0, 1 - tail).otherwise(tail)
    total = ranked.agg(F.sum((2 * F.col("i") - 1) * F.log(low) + (2 * (n - F.col("i")) + 1) * F.log(high))).first()[0]
    return (-n - total / n) * (1 + 4 / n - 25 / n**2)


#: Fewer residuals than these are gathered and judged by Shapiro-Wilk; more by Anderson-Darling, distributed.
GATHERED_RESIDUALS = 5000


def normal_residuals(sol: Solution, df: DataFrame, w):
    e = df.select((F.col(sol.spec.target).cast("double") - sol.eta()).alias("e")).limit(GATHERED_RESIDUALS).collect()
    if len(e) < GATHERED_RESIDUALS:
        stat, p = shapiro_wilk([r.e for r in e])
        return p > 0.05, f"Shapiro-Wilk {stat:.4f}, p = {p:.4g}", stat
    a = anderson_darling(sol, df)
    return a <= 0.752, f"Anderson-Darling {a:.4g} against 0.752 at 5 %", a


def supported(sol: Solution, df: DataFrame, train: DataFrame):
    """Largest share, over the columns, of rows outside the training range."""
    names = sol.spec.reads()
    numeric = [n for n in names if dict(train.dtypes)[n] not in ("string", "boolean")]
    ends = train.agg(*[g(F.col(n).cast("double")).alias(f"{k}{i}") for i, n in enumerate(numeric) for k, g in (("a", F.min), ("b", F.max))]).first()
    out = df.agg(*[F.avg(((F.col(n) < ends[f"a{i}"]) | (F.col(n) > ends[f"b{i}"])).cast("double")) for i, n in enumerate(numeric)]).first()
    worst = max(out) if numeric else 0.0
    return worst <= 0.05, f"share outside the training range {worst:.4f}", worst


def independence(order_by: tuple[str, ...]) -> Callable:
    """Durbin-Watson figures from 1.5 to 2.5 pass."""

    def check(sol: Solution, df: DataFrame, w):
        d = durbin_watson(sol, df, order_by)
        return 1.5 <= d <= 2.5, f"Durbin-Watson {d:.4g} in the order of {', '.join(order_by)}", d

    return check


def support(train: DataFrame) -> Callable:
    return lambda sol, df, w: supported(sol, df, train)


def events_in_bins(result: BinningResult):
    low = min(min(result.events), min(result.others))
    return low >= 1, f"fewest events or non-events in a bin: {low:g}", low


def bin_sizes(result: BinningResult):
    share = min((e + o) / result.n_total for e, o in zip(result.events, result.others))
    return share >= 0.05, f"smallest bin holds {share:.3f} of the rows", share


def monotone_rates(result: BinningResult):
    rates = [r for i, r in enumerate(result.event_rate) if i != result.missing_bin]
    up, down = all(a <= b for a, b in zip(rates, rates[1:])), all(a >= b for a, b in zip(rates, rates[1:]))
    return up or down, "event rates rise and fall" if not (up or down) else "event rates are monotone", None


def woe_signs(sol: Solution, df: DataFrame, w):
    from riskloom.operators.terms import Binned, Woe

    low = [t.col for t in sol.spec.features if isinstance(t, Woe) and not isinstance(t, Binned) and sol.coefficients[t.col] < 0]
    return not low, f"weights of evidence with a negative coefficient: {', '.join(low) or 'none'}", len(low)


def stable_coefficients(solutions: list[Solution]):
    b = np.array([list(s.slopes.values()) for s in solutions])
    spread = float((b.std(0, ddof=1) / np.maximum(np.abs(b.mean(0)), 1e-300)).max()) if len(b) > 1 else 0.0
    return spread <= 0.2, f"largest relative spread of a coefficient over folds {spread:.4g}", spread


def stable_metric(values: list[float]):
    spread = float(np.std(values, ddof=1) / abs(np.mean(values))) if len(values) > 1 else 0.0
    return spread <= 0.1, f"relative spread of the metric over folds {spread:.4g}", spread


def no_leakage(folds, gap):
    """folds: with last_train and first_valid; meant for splitters whose train rows all come first."""
    late = [f.fold for f in folds if f.last_train is not None and f.first_valid is not None and f.last_train + gap > f.first_valid]
    return not late, f"folds whose train rows reach into validation: {late or 'none'}", len(late)


def fold_checks(folds, gap, ordered: bool) -> tuple[CheckResult, ...]:
    """Checks of a cross-validation: stable coefficients and metrics, and no train rows within the gap before validation."""
    out = [Assumption("CoefficientStability", SOFT, stable_coefficients)([f.solution for f in folds])]
    names = folds[0].metrics if folds else ()
    out += [Assumption(f"PredictiveStability({n})", SOFT, stable_metric)([f.metrics[n] for f in folds]) for n in names]
    if ordered:
        out.append(Assumption("NoTemporalLeakage", HARD, no_leakage)(folds, gap))
    return tuple(out)


def catalogue(sol: Solution, classical: bool) -> list[tuple[Assumption, tuple]]:
    """The checks of a fit in order: loss, penalty, terms; equal ones once."""
    spec, out = sol.spec, [(Assumption("FullRankDesign", HARD, full_rank), ())]
    if isinstance(spec.loss, Logistic):
        out += [(Assumption(n, s, f), ()) for n, s, f in (("BinaryOrProportionTarget", HARD, proportion_target), ("NoPerfectSeparation", HARD, no_separation), ("ClassBalance", SOFT, class_balance))]
        if classical:
            out.append((Assumption("LinkAdequacy", INFO, link_adequacy), ()))
    elif isinstance(spec.loss, SquaredError) and classical:
        out += [(Assumption(n, INFO, f), ()) for n, f in (("ResidualNormality", normal_residuals), ("Homoscedasticity", homoscedastic), ("LowVIF", low_vif))]
    if spec.penalty.parts:
        out.append((Assumption("ComparableFeatureScales", SOFT, comparable_scales), ()))
    binned = [(t, s) for t, s in zip(spec.features, sol.states) if isinstance(s, BinningResult)]
    for t, s in binned:
        out += [(Assumption(f"{n}({t.col})", HARD, f), (s,)) for n, f in (("AtLeastOneEventPerBin", events_in_bins), ("MinimumBinSize", bin_sizes), ("MonotonicEventRate", monotone_rates))]
    if binned:
        out.append((Assumption("WoEMonotonicityPreserved", SOFT, woe_signs), ()))
    return out


def run_assumptions(sol: Solution, df: DataFrame, weights: str | None, on_violation: str = "raise", suppress: tuple = (), classical: bool = False, splitter=None) -> tuple[CheckResult, ...]:
    """Runs all checks: a failed HARD one raises, warns or is recorded; a failed SOFT one warns unless ignored."""
    if on_violation == "ignore" and not classical:
        quick = [(a, s) for a, s in catalogue(sol, False) if a.name not in ("NoPerfectSeparation",)]
    else:
        quick = catalogue(sol, classical)
    out = [a(*(s or (sol, df, weights))) for a, s in quick if a.name not in suppress and a.name.split("(")[0] not in suppress]
    if splitter is not None:
        from riskloom.plans.solve import solve

        fits = [solve(sol.spec, train, weights=weights, on_violation="ignore") for train, _ in splitter.split(df)]
        out.append(Assumption("CoefficientStability", SOFT, stable_coefficients)(fits))
    for r in out:
        if r.passed or on_violation == "ignore":
            continue
        if r.severity == HARD and on_violation == "raise":
            raise AssumptionError(f"{r.name}: {r.message}")
        if r.severity in (HARD, SOFT):
            warn.warn(f"{r.name}: {r.message}", stacklevel=3)
    return tuple(out)


@dataclass(frozen=True)
class AssumptionReport:
    results: tuple[CheckResult, ...]

    @property
    def passed(self) -> bool:
        return all(r.passed for r in self.results if r.severity == HARD)

    def to_df(self, spark) -> DataFrame:
        return spark.createDataFrame([(r.name, r.severity, r.passed, r.message, r.figure) for r in self.results], "name string, severity string, passed boolean, message string, figure double")

    def _repr_html_(self) -> str:
        return html_table(("check", "severity", "result", "message"), [(r.name, r.severity, "passed" if r.passed else "failed", r.message) for r in self.results])


def check_assumptions(sol: Solution, df: DataFrame, *, weights: str | None = None, classical_inference: bool = True, order_by: tuple[str, ...] = (), train: DataFrame | None = None) -> AssumptionReport:
    """All checks of a fit. order_by: columns of a row order, in which squared-error fits are also checked for Independence; train: the rows that the model learned from, whose ranges are compared with those of df."""
    results = run_assumptions(sol, df, weights, "ignore", (), classical_inference)
    if order_by and classical_inference and isinstance(sol.spec.loss, SquaredError):
        results += (Assumption("Independence", INFO, independence(order_by))(sol, df, weights),)
    if train is not None:
        results += (Assumption("SupportContainsPredictData", SOFT, support(train))(sol, df, weights),)
    return AssumptionReport(results)

