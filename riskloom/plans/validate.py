"""Cross-validation, tuning, penalty paths and bootstrap."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass, field, replace
from itertools import product

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from riskloom.display import html_table
from riskloom.plans.assume import fold_checks
from riskloom.plans.factor import Factor, blocks, design, factors
from riskloom.plans.folds import Folds, measured
from riskloom.plans.solve import INTERCEPT, SOLVERS, AssumptionError, Solution, check_target, coordinate, iterate, prepare, prox_update, solve, standardised
from riskloom.plans.splits import Splitter
from riskloom.sources.store import discard, stored
from riskloom.spec import LinearSpec
from riskloom.values import Logistic, l1, l2


def metric_name(metric: Callable) -> str:
    return getattr(metric, "name", None) or getattr(metric, "__name__", type(metric).__name__)


def named(metrics) -> dict[str, Callable]:
    if isinstance(metrics, dict):
        return dict(metrics)
    return {metric_name(m): m for m in ([metrics] if callable(metrics) else metrics)}


@dataclass(frozen=True)
class Fold:
    fold: int
    n_train: int
    n_valid: int
    last_train: object
    first_valid: object
    solution: Solution = field(repr=False)
    metrics: dict[str, float] = field(default_factory=dict)


@dataclass(frozen=True)
class CrossValidation:
    spec: LinearSpec
    folds: tuple[Fold, ...]
    assumptions: tuple = ()

    def _repr_html_(self) -> str:
        names = list(self.folds[0].metrics) if self.folds else []
        return html_table(("fold", "n_train", "n_valid", *names), [(f.fold, f.n_train, f.n_valid, *(f.metrics[n] for n in names)) for f in self.folds])

    def values(self, name: str) -> list[float]:
        return [f.metrics[name] for f in self.folds]

    def summary(self, spark) -> DataFrame:
        rows = [(f.fold, f.n_train, f.n_valid, name, float(v)) for f in self.folds for name, v in f.metrics.items()]
        return spark.createDataFrame(rows, "fold int, n_train bigint, n_valid bigint, metric string, value double")


class LeakageError(ValueError):
    pass


def cross_validate(spec: LinearSpec, df: DataFrame, splitter: Splitter, metrics, *, weights: str | None = None) -> CrossValidation:
    """Fits on the train side of each fold and measures on the other. Raises where train rows reach into the validation span or the gap is below the label's horizon."""
    horizon = spec.loss.label_horizon
    if horizon is not None and splitter.gap < horizon:
        raise LeakageError(f"the gap {splitter.gap} is below the label's horizon {horizon}")
    folds, out = Folds.of(splitter, df), []
    ahead = hasattr(splitter, "horizon")  # train rows end before the validation window
    sizes = folds.sizes()
    for i, x in enumerate(sizes):
        if ahead and x["n_train"] and x["n_valid"] and x["last_train"] + splitter.gap > x["first_valid"]:
            raise LeakageError(f"fold {i}: train rows reach {x['last_train']}, validation begins {x['first_valid']}")
    fits = folds.fit(spec, weights)
    for i, (x, sol, values) in enumerate(zip(sizes, fits, folds.measure(named(metrics), fits, weights))):
        out.append(Fold(i, x["n_train"], x["n_valid"], x["last_train"], x["first_valid"], sol, values))
    return CrossValidation(spec, tuple(out), fold_checks(tuple(out), splitter.gap, ahead))


@dataclass(frozen=True)
class CurvePoint:
    params: dict
    mean: float
    sd: float
    values: tuple[float, ...]


@dataclass(frozen=True)
class TuneResult:
    curve: tuple[CurvePoint, ...]
    chosen: int
    solution: Solution = field(repr=False)

    @property
    def params(self) -> dict:
        return self.curve[self.chosen].params

    def _repr_html_(self) -> str:
        return html_table(("params", "mean", "sd", "chosen"), [(p.params, p.mean, p.sd, i == self.chosen) for i, p in enumerate(self.curve)])

    def curve_df(self, spark) -> DataFrame:
        return spark.createDataFrame([(i, str(p.params), float(p.mean), float(p.sd), i == self.chosen) for i, p in enumerate(self.curve)], "point int, params string, metric_mean double, metric_sd double, chosen boolean")


def best_mean(curve, direction: str) -> int:
    means = [p.mean for p in curve]
    return means.index(max(means) if direction == "max" else min(means))


def one_se_rule(curve, direction: str) -> int:
    """The last point of the grid whose mean is within one standard deviation of the best."""
    best = curve[best_mean(curve, direction)]
    ok = [i for i, p in enumerate(curve) if (p.mean >= best.mean - best.sd if direction == "max" else p.mean <= best.mean + best.sd)]
    return max(ok)


def grid_points(grid) -> list[dict]:
    if isinstance(grid, dict):
        return [dict(zip(grid, values)) for values in product(*grid.values())]
    return [dict(g) for g in grid]


def tune(spec_fn: Callable, grid, df: DataFrame, splitter: Splitter, metric: Callable, *, weights: str | None = None, rule: Callable = best_mean, direction: str = "max") -> TuneResult:
    """Every point of the grid on every fold, then a fit to all rows. All folds of a point share their jobs; points that share features share the folds' factors, so only the first costs a pass for squared-error fits."""
    if direction not in ("max", "min"):
        raise ValueError("direction is max or min")
    points = grid_points(grid)
    if not points:
        raise ValueError("the grid is empty")
    folds, values = Folds.of(splitter, df), []
    level = folds.rows.storageLevel
    own = not (level.useMemory or level.useDisk)  # else the caller has persisted the rows
    if own:
        folds.rows.persist()
    try:
        for params in points:
            fits = folds.fit(spec_fn(**params), weights)
            values.append(tuple(x["metric"] for x in folds.measure({"metric": metric}, fits, weights)))
    finally:
        if own:
            folds.rows.unpersist()
    curve = tuple(CurvePoint(p, float(np.mean(v)), float(np.std(v, ddof=1)) if len(v) > 1 else 0.0, v) for p, v in zip(points, values))
    at = rule(curve, direction)
    return TuneResult(curve, at, solve(spec_fn(**points[at]), df, weights=weights, on_violation="ignore"))


@dataclass(frozen=True)
class NestedFold:
    fold: int
    params: dict
    value: float
    curve: tuple[CurvePoint, ...]


def nested_cv(spec_fn: Callable, grid, df: DataFrame, outer: Splitter, inner: Splitter, metric: Callable, *, weights: str | None = None, rule: Callable = best_mean, direction: str = "max") -> tuple[NestedFold, ...]:
    """Tunes within the train side of each outer fold and measures its refit on the other side."""
    out = []
    for i, (train, valid) in enumerate(outer.split(df)):
        r = tune(spec_fn, grid, train, inner, metric, weights=weights, rule=rule, direction=direction)
        out.append(NestedFold(i, r.params, measured(metric, r.solution, valid, weights), r.curve))
    return tuple(out)


def log_grid(low: float, high: float, n: int) -> np.ndarray:
    """n values from high down to low in equal ratios."""
    if not 0 < low < high or n < 2:
        raise ValueError("0 < low < high and two points at least")
    return np.geomspace(high, low, n)


@dataclass(frozen=True)
class Path:
    lambdas: np.ndarray
    coefficients: np.ndarray  # a row for each lambda, intercept first
    names: tuple[str, ...]

    def to_df(self, spark) -> DataFrame:
        rows = [(float(lam), n, float(b)) for lam, row in zip(self.lambdas, self.coefficients) for n, b in zip(self.names, row)]
        return spark.createDataFrame(rows, "lambda double, term string, coefficient double")

    def _repr_html_(self) -> str:
        return html_table(("lambda", *self.names), [(float(lam), *map(float, row)) for lam, row in zip(self.lambdas, self.coefficients)])


def mixing(spec: LinearSpec) -> float:
    """Share of L1 in the penalty's strength; 1 without a penalty."""
    one, two = spec.penalty.strength("l1"), spec.penalty.strength("l2")
    if two and not one:
        raise ValueError("a pure L2 penalty has no largest lambda")
    return 1.0 if not two else one / (one + two)


def lambda_max(spec: LinearSpec, df: DataFrame, weights: str | None = None) -> float:
    """The least lambda that leaves all slopes at 0: the largest standardised covariance with the target over the L1 share."""
    states, columns = prepare(spec, df, weights)
    f = factors(design(df, columns, spec.target, weights), len(columns))[""]
    return float(np.abs(standardised(f)[1]).max() / mixing(spec))


def lambda_path(spec: LinearSpec, df: DataFrame, n: int = 100, ratio: float = 1e-3, *, weights: str | None = None) -> Path:
    """Coefficients along lambdas from the largest down: one pass over the rows for squared error, a pass for each Newton step of a logistic fit; each lambda starts from the one before."""
    share = mixing(spec)
    states, columns = prepare(spec, df, weights)
    rows, logistic = design(df, columns, spec.target, weights), isinstance(spec.loss, Logistic)
    if logistic:
        rows = rows.persist()
    try:
        first = factors(rows, len(columns))
        f = first[""]
        if logistic:
            check_target(spec, f, rows)
        top = float(np.abs(standardised(f)[1]).max() / share)
        lambdas, out, start = log_grid(top * ratio, top, n), [], None
        for lam in lambdas:
            if logistic:
                own = replace(spec, penalty=l1(lam * share) + l2(lam * (1 - share)) if share < 1 else l1(lam))
                beta = iterate(rows, len(columns), first, prox_update(own), True, starts=None if start is None else {"": start})[""][0]
                start = beta
            else:
                beta, _, _, start = coordinate(f, lam * share, lam * (1 - share), start)
            out.append(beta)
    finally:
        if logistic:
            rows.unpersist()
    return Path(lambdas, np.array(out), (INTERCEPT, *[c for c, _ in columns]))


@dataclass(frozen=True)
class BootstrappedSolution:
    """A fit with the coefficients of its replicates (a row for each, columns as base.coefficients)."""

    base: Solution
    replicates: np.ndarray
    failures: int

    def coefficients_df(self, spark) -> DataFrame:
        rows = [(i, n, float(b)) for i, row in enumerate(self.replicates) for n, b in zip(self.base.coefficients, row)]
        return spark.createDataFrame(rows, "replicate int, term string, coefficient double")

    def _repr_html_(self) -> str:
        return html_table(("term", "estimate", "low", "high"), [(k, self.base.coefficients[k], a, b) for k, (a, b) in self.coefficient_ci().items()])

    def coefficient_ci(self, level: float = 0.95, method: str = "percentile") -> dict[str, tuple[float, float]]:
        if method != "percentile":
            raise NotImplementedError(f"no {method} intervals")
        lo, hi = np.quantile(self.replicates, [(1 - level) / 2, (1 + level) / 2], axis=0)
        return {n: (float(a), float(b)) for n, a, b in zip(self.base.coefficients, lo, hi)}

    def selection_frequency(self) -> dict[str, float]:
        """Share of replicates in which a coefficient isn't exactly 0; 1 without an L1 part."""
        share = (self.replicates != 0).mean(0) if self.base.spec.penalty.strength("l1") else np.ones(self.replicates.shape[1])
        return dict(zip(self.base.coefficients, map(float, share)))

    def prediction_ci(self, df: DataFrame, level: float = 0.95) -> DataFrame:
        """Adds eta_low and eta_high: quantiles of the linear predictor over the replicates; no frame is multiplied by them."""
        names = list(self.base.coefficients)
        columns = self.base.columns
        x = F.array(*([F.lit(1.0)] if names[0] == INTERCEPT else []), *[c for _, c in columns])
        held = df.sparkSession.sparkContext.broadcast(self.replicates.T)
        q = [(1 - level) / 2, (1 + level) / 2]

        @F.pandas_udf("struct<low:double,high:double>")
        def bounds(x):
            import pandas as pd

            eta = np.stack(x.to_numpy()) @ held.value if len(x) else np.zeros((0, 1))
            lo, hi = np.quantile(eta, q, axis=1) if len(x) else (np.zeros(0), np.zeros(0))
            return pd.DataFrame({"low": lo, "high": hi})

        return df.withColumn("_ci", bounds(x)).select(*df.columns, F.col("_ci.low").alias("eta_low"), F.col("_ci.high").alias("eta_high"))


def drawn(rng: np.random.Generator, left: np.ndarray, rows_left: int, k: int, times: np.ndarray | None = None) -> np.ndarray:
    """How often each of the next k rows is drawn, a row for each replicate; left (changed in place) draws remain for rows_left rows. times: how many equal rows each of fewer distinct rows stands for, k in all."""
    take = left.copy() if rows_left == k else rng.binomial(left, k / rows_left)
    left -= take
    if times is not None:
        return rng.multinomial(take, times / k)
    at = rng.integers(0, k, int(take.sum()))
    ends = np.cumsum(take)
    return np.stack([np.bincount(at[b - n : b], minlength=k) for n, b in zip(take, ends)])


def bootstrap(sol: Solution, df: DataFrame, n_boot: int = 500, *, stratify: str | None = None, method: str = "pairs", weights: str | None = None, splitter: Splitter | None = None, random_state: int = 0, batch: int = 64) -> BootstrappedSolution:
    """Refits to rows drawn with replacement: as many as there are, exactly, and exactly so in each stratum. All replicates share each pass over the rows: partitions get multinomial totals from the driver and draw their own rows. The design is written once, unshuffled where it has the session's shuffle partitions at least (else dealt round robin), so a lost partition is read again with the same rows in the same order, and draws stay as they were; equal rows of a block are drawn together. method="residual" keeps the rows of x and draws residuals (squared error); method="block" draws whole validation windows of a splitter."""
    if method == "block":
        return block_bootstrap(sol, df, n_boot, splitter, weights, random_state)
    if method not in ("pairs", "residual"):
        raise ValueError("method is pairs, residual or block")
    if method == "residual" and isinstance(sol.spec.loss, Logistic):
        raise ValueError("residuals are drawn for squared error only")
    p = len(sol.columns)
    rows = design(df, sol.columns, sol.spec.target, weights, F.col(stratify) if stratify else None)
    if method == "residual":
        rows = rows.withColumn("e", F.col("y") - sol_eta(sol))
    least = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    if rows.rdd.getNumPartitions() < least:
        rows = rows.repartition(least)  # round robin, whatever the rows hold
    held = stored(rows.withColumn("nth", F.monotonically_increasing_id()), "design")
    rows = held.persist()
    try:
        sizes = rows.groupBy(F.spark_partition_id().alias("part"), "grp").agg(F.count("*").alias("count"), F.min("nth").alias("first")).orderBy("grp", "first").collect()
        rng = np.random.default_rng(random_state)
        totals: dict[tuple[int, str], np.ndarray] = {}
        for g in sorted({r.grp or "" for r in sizes}):
            own = [r for r in sizes if (r.grp or "") == g]
            n = sum(r["count"] for r in own)
            draws = rng.multinomial(n, [r["count"] / n for r in own], n_boot)
            totals |= {(r.part, g): draws[:, i] for i, r in enumerate(own)}
        counts = {(r.part, r.grp or ""): r["count"] for r in sizes}
        firsts: dict[int, int] = {}  # the same files may be read in another order, so partitions are told apart by their first row
        for r in sizes:
            firsts[r.part] = min(firsts.get(r.part, r.first), r.first)
        first = factors(rows.withColumn("grp", F.lit("")), p)[""]
        centre, scale = first.centred()[2], standardised(first)[2]
        found: list = []
        for at in range(0, n_boot, batch):
            found += refit(sol, rows, p, centre, scale, {k: v[at : at + batch] for k, v in totals.items()}, counts, random_state + at, method, firsts)
    finally:
        rows.unpersist()
        discard(held)
    return gathered(sol, found)


def gathered(sol: Solution, found: list) -> BootstrappedSolution:
    names, n_boot = list(sol.coefficients), len(found)
    good = [b for b in found if b is not None and np.isfinite(b).all()]
    failures = n_boot - len(good)
    if not good:
        raise RuntimeError("no replicate could be fitted")
    if failures > max(1, 0.05 * n_boot):
        raise AssumptionError(f"{failures} of {n_boot} replicates failed")
    return BootstrappedSolution(sol, np.array(good)[:, : len(names)] if names[0] == INTERCEPT else np.array(good)[:, 1:], failures)


def block_bootstrap(sol: Solution, df: DataFrame, n_boot: int, splitter: Splitter | None, weights: str | None, random_state: int) -> BootstrappedSolution:
    """One pass gathers a factor for each window; replicates add the cross-products of windows drawn with replacement. Logistic replicates share passes in which the rows of a window count as often as it is drawn."""
    if splitter is None:
        raise ValueError("blocks need a splitter")
    rows = design(splitter.assign(df).filter("role = 'valid'"), sol.columns, sol.spec.target, weights, F.col("fold")).persist()
    try:
        windows = factors(rows, len(sol.columns))
        if len(windows) < 2:
            raise ValueError("two windows with rows at least")
        if isinstance(sol.spec.loss, Logistic):
            return logistic_blocks(sol, rows, windows, n_boot, random_state)
    finally:
        rows.unpersist()
    own = list(windows.values())
    rng, out = np.random.default_rng(random_state), []
    for _ in range(n_boot):
        chosen = [own[i] for i in rng.integers(0, len(own), len(own))]
        r = np.linalg.qr(np.concatenate([f.r for f in chosen]), mode="r")
        f = Factor(sum(c.n for c in chosen), r, sum(c.sw for c in chosen), sum(c.sy for c in chosen), 0.0, 1.0)
        beta = SOLVERS[type(sol.spec.loss), sol.spec.penalty.kind](sol.spec, rows, f.p, {"": f})[""][0]
        out.append(beta if sol.spec.intercept else beta[1:])
    return BootstrappedSolution(sol, np.array(out), 0)


def logistic_blocks(sol: Solution, rows: DataFrame, windows: dict[str, Factor], n_boot: int, random_state: int, batch: int = 64) -> BootstrappedSolution:
    rng = np.random.default_rng(random_state)
    times = rng.multinomial(len(windows), [1 / len(windows)] * len(windows), n_boot)
    pooled = factors(rows.withColumn("grp", F.lit("")), len(sol.columns))[""]
    centre, scale = pooled.centred()[2], standardised(pooled)[2]
    found: list = []
    for at in range(0, n_boot, batch):
        totals = {name: times[at : at + batch, i] for i, name in enumerate(sorted(windows))}
        found += refit(sol, rows, len(sol.columns), centre, scale, totals, {}, random_state + at, "block")
    return gathered(sol, found)


def distinct(x: np.ndarray, y: np.ndarray, w: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray | None]:
    """The distinct rows of a block and how many rows each stands for, where they are a quarter at most (as with binned columns); else the block and None."""
    rows = np.ascontiguousarray(np.column_stack([x, y, w]))
    keys = rows.view([("", f"V{rows.shape[1] * 8}")]).ravel()
    if len(np.unique(keys[:256])) * 2 > len(keys[:256]):
        return x, y, w, None
    _, first, times = np.unique(keys, return_index=True, return_counts=True)
    if 4 * len(first) > len(rows):
        return x, y, w, None
    return x[first], y[first], w[first], times


#: So many matrices are added in one task.
ADDED = 64


def summed(parts: DataFrame, n_parts: int) -> list[np.ndarray]:
    """The sum of g (doubles) of each replicate, by its number. parts: rep, lot (64 neighbouring partitions) and g; lots are added level by level until 64 at most are left, which the driver adds."""

    def total(t: pa.Table) -> pa.Table:
        g = sum(np.frombuffer(x) for x in t["g"].to_pylist())
        return pa.table({"rep": t["rep"][:1], "lot": pa.array([t["lot"][0].as_py() // ADDED], pa.int32()), "g": pa.array([g.tobytes()], pa.binary())})

    lots = -(-n_parts // ADDED)
    parts = parts.groupBy("rep", "lot").applyInArrow(total, PARTIAL)
    while lots > ADDED:
        lots = -(-lots // ADDED)
        parts = parts.groupBy("rep", "lot").applyInArrow(total, PARTIAL)
    out: dict[int, np.ndarray] = {}
    for r in parts.orderBy("rep", "lot").collect():
        out[r.rep] = out.get(r.rep, 0) + np.frombuffer(r.g)
    return [out[i] for i in sorted(out)]


PARTIAL = "rep int, lot int, g binary"


def partial(out: np.ndarray) -> pa.RecordBatch:
    """What one task has of each replicate."""
    from pyspark import TaskContext

    lot = TaskContext.get().partitionId() // ADDED
    n = len(out)
    return pa.record_batch([pa.array(np.arange(n), pa.int32()), pa.array([lot] * n, pa.int32()), pa.array([r.tobytes() for r in out], pa.binary())], ["rep", "lot", "g"])


def products(u: np.ndarray, z: np.ndarray) -> np.ndarray:
    """For each row of u, the sum of the outer products of the rows of z with its weights; in parts of bounded memory."""
    q = z.shape[1]
    out = np.zeros((len(u), q * q))
    for at in range(0, len(z), step := max(1, (1 << 22) // (q * q))):
        part = z[at : at + step]
        out += u[:, at : at + step] @ (part[:, :, None] * part[:, None, :]).reshape(len(part), -1)
    return out


def sol_eta(sol: Solution):
    return F.lit(float(sol.coefficients.get(INTERCEPT, 0.0))) + sum((F.element_at("x", i + 1) * F.lit(float(v)) for i, v in enumerate(sol.slopes.values())), F.lit(0.0))


def refit(sol: Solution, rows: DataFrame, p: int, centre: np.ndarray, scale: np.ndarray, totals: dict, counts: dict, seed: int, method: str, firsts: dict[int, int] | None = None) -> list[np.ndarray | None]:
    """Coefficients (intercept first) of some replicates; each pass gathers one Gram matrix for each of them."""
    from riskloom.plans.solve import working_logistic

    n_rep, n_parts = len(next(iter(totals.values()))), rows.rdd.getNumPartitions()
    spec, is_logistic = sol.spec, isinstance(sol.spec.loss, Logistic)
    start = np.zeros(p + 1)
    beta0 = np.array([sol.coefficients.get(INTERCEPT, 0.0), *sol.slopes.values()])
    start[1:] = beta0[1:] * scale
    start[0] = beta0[0] + beta0[1:] @ centre
    betas = np.repeat(start[None, :], n_rep, 0)

    def grams(betas: np.ndarray | None) -> np.ndarray:
        q = p + 2

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            from pyspark import TaskContext

            part = TaskContext.get().partitionId()
            rng = np.random.default_rng([seed, (firsts or {}).get(part, 0)])
            out, left, rows_left = np.zeros((n_rep, q * q + 1)), {}, {}
            for b in batches:
                for name, x, y, w in blocks(b, p):
                    key, k = (part, name or ""), len(x)
                    if method == "block":
                        c = np.repeat(totals[name][:, None], k, 1)
                    else:
                        left.setdefault(key, totals[key].copy())
                        rows_left.setdefault(key, counts[key])
                        x, y, w, times = distinct(x, y, w)
                        c = drawn(rng, left[key], rows_left[key], k, times)
                        rows_left[key] -= k
                        k = len(x)
                    z = np.concatenate([np.ones((k, 1)), (x - centre) / scale], 1)
                    out[:, -1] += c.sum(1)
                    if betas is None:
                        out[:, :-1] += products(c * w, np.concatenate([z, y[:, None]], 1))
                    else:
                        v, t = working_logistic(z @ betas.T, y[:, None])
                        v, t = v.T * c * w, t.T
                        gram = np.zeros((n_rep, q, q))
                        gram[:, :-1, :-1] = products(v, z).reshape(n_rep, q - 1, q - 1)
                        gram[:, :-1, -1] = gram[:, -1, :-1] = (v * t) @ z
                        gram[:, -1, -1] = (v * t * t).sum(1)
                        out[:, :-1] += gram.reshape(n_rep, -1)
            yield partial(out)

        return np.stack(summed(rows.mapInArrow(run, PARTIAL), n_parts))

    def factor_of(g: np.ndarray) -> Factor | None:
        gram, n = g[:-1].reshape(p + 2, p + 2), int(g[-1])
        try:
            r = np.linalg.cholesky(gram + 1e-14 * np.diag(np.diag(gram))).T
        except np.linalg.LinAlgError:
            return None
        return Factor(n, r, float(gram[0, 0]), 0.0, 0.0, 1.0)

    lam2, lam1 = spec.penalty.strength("l2"), spec.penalty.strength("l1")

    def one(f: Factor) -> np.ndarray:
        """A step in units of the global scales: slopes and the constant at the global centre."""
        if lam1:
            ratio = f.n / f.r[0, 0] ** 2 if is_logistic else 1.0
            return coordinate(f, lam1 * ratio, lam2 * ratio)[0]
        if lam2:
            gram, xy, mx, my, _ = f.centred()
            strength = (f.n if is_logistic else f.sw) * lam2
            slopes = np.linalg.solve(gram + strength * np.diag(1 / scale**2), xy)
            return np.concatenate([[my - mx @ slopes], slopes])
        return np.linalg.solve(f.r[:-1, :-1], f.r[:-1, -1])

    if method == "residual":
        return residual_refit(rows, p, n_rep, seed, one, factor_of, centre, scale, counts, firsts)
    live, out = np.ones(n_rep, bool), [None] * n_rep
    for _ in range(60 if is_logistic else 1):
        found = grams(betas if is_logistic else None)
        for i in np.flatnonzero(live):
            f = factor_of(found[i])
            if f is None:
                live[i] = False
                continue
            new = one(f)
            small = np.linalg.norm(new - betas[i]) / max(np.linalg.norm(betas[i]), 1.0) < 1e-8
            betas[i], out[i] = new, new
            live[i] = is_logistic and not small
        if not live.any():
            break
    return [None if b is None else np.concatenate([[b[0] - (b[1:] / scale) @ centre], b[1:] / scale]) for b in out]


#: So many residuals are broadcast; more are joined by their drawn ranks.
HELD_RESIDUALS = 1_000_000


def residual_refit(rows: DataFrame, p: int, n_rep: int, seed: int, one: Callable, factor_of: Callable, centre: np.ndarray, scale: np.ndarray, counts: dict, firsts: dict[int, int]) -> list[np.ndarray | None]:
    """Fixed rows of x; every row of every replicate draws one of all residuals, less their mean. Up to HELD_RESIDUALS residuals are broadcast; beyond, rows are joined to them by drawn ranks, a shuffle of rows times replicates."""
    mean, n = rows.agg(F.avg("e"), F.count("*")).first()
    q, held, source = p + 2, None, rows
    if n <= HELD_RESIDUALS:
        held = rows.sparkSession.sparkContext.broadcast(rows.select("nth", "e").toArrow().sort_by("nth")["e"].to_numpy())
    else:
        sizes, before, upto = dict.fromkeys(firsts, 0), [0] * (max(firsts) + 1), 0
        for (part, _), k in counts.items():
            sizes[part] += k
        for part in sorted(firsts, key=firsts.get):
            before[part], upto = upto, upto + sizes[part]
        offset = F.array(*[F.lit(v).cast("bigint") for v in before])
        rank = F.element_at(offset, F.spark_partition_id() + 1) + F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1))
        ranked = rows.withColumn("rank", rank)
        source = ranked.withColumn("rep", F.explode(F.sequence(F.lit(0), F.lit(n_rep - 1)))).withColumn("pick", F.pmod(F.xxhash64("rank", "rep", F.lit(seed)), F.lit(n)))
        source = source.drop("rank").join(ranked.select(F.col("rank").alias("pick"), F.col("e").alias("drawn")), "pick")

    def add(out: np.ndarray, z: np.ndarray, t: np.ndarray, w: np.ndarray) -> None:
        gram = np.zeros((len(t), q, q))
        gram[:, :-1, :-1] = (z * w[:, None]).T @ z
        gram[:, :-1, -1] = gram[:, -1, :-1] = (t * w) @ z
        gram[:, -1, -1] = (t * t * w).sum(1)
        out[:, :-1] += gram.reshape(len(t), -1)
        out[:, -1] += len(z)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        rng = np.random.default_rng([seed, 1, firsts.get(TaskContext.get().partitionId(), 0)])
        out = np.zeros((n_rep, q * q + 1))
        for b in batches:
            e = b["e"].to_numpy(zero_copy_only=False)
            for _, x, y, w in blocks(b.drop_columns(["grp"]).append_column("grp", pa.array([""] * b.num_rows)), p):
                z, base = np.concatenate([np.ones((len(x), 1)), (x - centre) / scale], 1), y - e - mean
                if held is not None:
                    add(out, z, base + held.value[rng.integers(0, n, (n_rep, len(x)))], w)
                    continue
                own, t = b["rep"].to_numpy(zero_copy_only=False), base + b["drawn"].to_numpy(zero_copy_only=False)
                for r in np.unique(own):
                    add(out[r : r + 1], z[own == r], t[None, own == r], w[own == r])
        yield partial(out)

    n_parts = max(rows.rdd.getNumPartitions(), int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    out = []
    for g in summed(source.mapInArrow(run, PARTIAL), n_parts):
        f = factor_of(g)
        b = None if f is None else one(f)
        out.append(None if b is None else np.concatenate([[b[0] - (b[1:] / scale) @ centre], b[1:] / scale]))
    return out


def over_time(metric: Callable, sol: Solution, df: DataFrame, splitter: Splitter, *, weights: str | None = None) -> list[tuple[object, float]]:
    """(middle of the observed span, value) of the metric in each validation window that has rows; a known metric's windows share all jobs."""
    folds = Folds.of(splitter, df)
    sizes = folds.sizes()
    there = [i for i, x in enumerate(sizes) if x["n_valid"]]
    folds.pairs = [folds.pairs[i] for i in there]
    values = folds.measure({"metric": metric}, [sol] * len(there), weights)
    return [(sizes[i]["first_valid"] + (sizes[i]["last_valid"] - sizes[i]["first_valid"]) / 2, x["metric"]) for i, x in zip(there, values)]
