"""Fitting: from a spec and rows to coefficients, and back to a prediction column."""

from __future__ import annotations

import warnings as warn
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field, replace
from functools import cached_property

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from riskloom.display import html_table
from riskloom.operators.shared import SEG, SENT_BYTES, joined, learn
from riskloom.operators.terms import Product, Term
from riskloom.plans.factor import Factor, compacted, dependent, design, factors, grouped_factors, merged
from riskloom.sources.store import stored
from riskloom.spec import LinearSpec, SegmentedSpec
from riskloom.values import Logistic, SquaredError, soft

INTERCEPT = "(Intercept)"


class AssumptionError(ValueError):
    pass


@dataclass(frozen=True)
class Solution:
    """A fit. coefficients: by column name, the intercept first; states: what the terms learned."""

    spec: LinearSpec
    coefficients: dict[str, float]
    std_errors: dict[str, float] | None
    states: tuple
    n_obs: int
    weight_sum: float
    converged: bool
    solver_info: dict
    assumptions: tuple = ()
    factor: Factor | None = field(default=None, repr=False, compare=False)

    @property
    def columns(self) -> list[tuple[str, Column]]:
        return [c for t, s in zip(self.spec.features, self.states) for c in t.columns(s)]

    @property
    def slopes(self) -> dict[str, float]:
        return {k: v for k, v in self.coefficients.items() if k != INTERCEPT}

    def eta(self) -> Column:
        """The linear predictor of a row."""
        out = F.lit(float(self.coefficients.get(INTERCEPT, 0.0)))
        for name, column in self.columns:
            out = out + F.lit(float(self.coefficients[name])) * column
        return out

    def score(self) -> Column:
        return self.spec.loss.link(self.eta())

    def _repr_html_(self) -> str:
        return html_table(("term", "estimate", "std_error"), [(k, v, (self.std_errors or {}).get(k, float("nan"))) for k, v in self.coefficients.items()])

    def coefficients_df(self, spark) -> DataFrame:
        se = self.std_errors or {}
        return spark.createDataFrame([(k, float(v), se.get(k)) for k, v in self.coefficients.items()], "term string, estimate double, std_error double")


@dataclass(frozen=True)
class SegmentedSolution:
    spec: SegmentedSpec
    solutions: dict[str, Solution]

    def __getitem__(self, segment) -> Solution:
        return self.solutions[str(segment)]

    def _repr_html_(self) -> str:
        return html_table(("segment", "term", "estimate"), [(s, k, v) for s, sol in sorted(self.solutions.items()) for k, v in sol.coefficients.items()])

    def coefficients_df(self, spark) -> DataFrame:
        return spark.createDataFrame([(s, k, float(v)) for s, sol in sorted(self.solutions.items()) for k, v in sol.coefficients.items()], "segment string, term string, estimate double")


class StoredSegments(SegmentedSolution):
    """Squared-error fits that tasks have solved: a stored table with a row for each segment. Solutions come to the driver only when asked for."""

    def __init__(self, spec: SegmentedSpec, table: DataFrame, n: int, names: list[str], states: tuple):
        for k, v in (("spec", spec), ("table", table), ("n", n), ("names", names), ("states", states)):
            object.__setattr__(self, k, v)

    @cached_property
    def solutions(self) -> dict[str, Solution]:
        first = {r.grp: factor_of(r) for r in self.table.select("grp", "n", "extra", "r").orderBy("grp").collect()}
        return fit_segments(self.spec.base, None, len(self.names), lambda seg: (self.names, self.states), first)

    def coefficients_df(self, spark) -> DataFrame:
        base = self.spec.base
        labels = F.array(*[F.lit(n) for n in ([INTERCEPT] if base.intercept else []) + self.names])
        beta = F.col("beta") if base.intercept else F.slice("beta", 2, len(self.names))
        each = F.inline(F.arrays_zip(labels.alias("term"), beta.alias("estimate")))
        return self.table.select(F.col("grp").alias("segment"), each).toDF("segment", "term", "estimate")


def factor_of(row) -> Factor:
    size = round((len(row.r) // 8) ** 0.5)
    return Factor(row.n, np.frombuffer(row.r).reshape(size, size), *map(float, np.frombuffer(row.extra)))


def solved_in_tasks(base: LinearSpec, rows: DataFrame, p: int) -> DataFrame:
    """grp, n, extra, r, beta (intercept first; null where the fit can't be made) of every segment, stored."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, own = None, []

        def row() -> tuple:
            n, extra, r = merged(own, p)
            f = Factor(n, r, *map(float, extra))
            good = f.sw > 0 and not dependent(r[:, :-1] if base.intercept else r[:, 1:-1], n)
            beta = SOLVERS[type(base.loss), base.penalty.kind](base, None, p, {key: f})[key][0] if good else None
            return key, n, extra.tobytes(), r.tobytes(), beta

        def made(out: list[tuple]) -> pa.RecordBatch:
            kinds = (pa.string(), pa.int64(), pa.binary(), pa.binary(), pa.list_(pa.float64()))
            return pa.record_batch([pa.array([x[i] for x in out], k) for i, k in enumerate(kinds)], ["grp", "n", "extra", "r", "beta"])

        for batch in batches:
            out = []
            for name, *part in zip(*(batch[c].to_pylist() for c in ("grp", "n", "extra", "r"))):
                if name != key:
                    out += [row()] if own else []
                    key, own = name, []
                own.append(tuple(part))
            yield made(out)
        yield made([row()] if own else [])

    parts = grouped_factors(rows, p).repartition("grp").sortWithinPartitions("grp")
    return stored(parts.mapInArrow(run, "grp string, n bigint, extra binary, r binary, beta array<double>"), "segments")


Raw = tuple[np.ndarray, np.ndarray | None, bool, dict]
#: (kind of loss, kind of penalty) -> solver of many groups at once
SOLVERS: dict[tuple[type, str], Callable] = {}


def register(loss: type, penalty: str):
    """Adds a solver for a loss and a kind of penalty: it gets (spec, rows, p, first factors) and returns, by group, (coefficients with intercept, standard errors or None, converged, info)."""

    def put(solver: Callable) -> Callable:
        if (loss, penalty) in SOLVERS:
            raise ValueError(f"{loss.__name__} with {penalty} has a solver already")
        SOLVERS[loss, penalty] = solver
        return solver

    return put


def linear_parts(f: Factor, intercept: bool) -> tuple[np.ndarray, np.ndarray]:
    """R and Q'z of the least-squares problem with or without the constant column."""
    if intercept:
        return f.r[:-1, :-1], f.r[:-1, -1]
    r = np.linalg.qr(f.r[:, 1:], mode="r")
    return r[: f.p, : f.p], r[: f.p, -1]


def with_zero(beta: np.ndarray, intercept: bool) -> np.ndarray:
    return beta if intercept else np.concatenate([[0.0], beta])


@register(SquaredError, "none")
def ols(spec: LinearSpec, rows: DataFrame, p: int, first: dict[str, Factor]) -> dict[str, Raw]:
    out = {}
    for name, f in first.items():
        r, q = linear_parts(f, spec.intercept)
        beta = np.linalg.solve(r, q)
        whole = f.r if spec.intercept else np.linalg.qr(f.r[:, 1:], mode="r")
        rss = float(whole[-1, -1] ** 2)
        df = f.n - len(beta)
        sigma2 = rss / df if df > 0 else np.nan
        inverse = np.linalg.inv(r)
        tss = f.centred()[4]
        info = {"solver": "qr", "sigma2": sigma2, "residual_std_error": float(np.sqrt(sigma2)), "rss": rss, "df_resid": df, "r_squared": 1 - rss / tss if tss else np.nan}
        out[name] = with_zero(beta, spec.intercept), np.sqrt(sigma2 * (inverse**2).sum(1)), True, info
    return out


@register(SquaredError, "l2")
def ridge(spec: LinearSpec, rows: DataFrame, p: int, first: dict[str, Factor]) -> dict[str, Raw]:
    out, lam = {}, spec.penalty.strength("l2")
    for name, f in first.items():
        if spec.intercept:
            gram, xy, mx, my, _ = f.centred()
            slopes = np.linalg.solve(gram + f.sw * lam * np.eye(p), xy)
            beta = np.concatenate([[my - mx @ slopes], slopes])
        else:
            gram = f.r[:, 1:].T @ f.r[:, 1:]
            beta = np.concatenate([[0.0], np.linalg.solve(gram[:-1, :-1] + f.sw * lam * np.eye(p), gram[:-1, -1])])
        out[name] = beta, None, True, {"solver": "ridge", "effective_lambda": f.sw * lam, "penalty_value": spec.penalty.value(beta)}
    return out


def descend(gram: np.ndarray, xy: np.ndarray, lam1: float, lam2: float, start: np.ndarray | None = None, tol: float = 1e-7, sweeps: int = 1000) -> tuple[np.ndarray, bool, int]:
    """Cyclic coordinate descent on b'Gb/2 - xy'b + penalties; columns with no variance stay at 0."""
    b = np.zeros(len(xy)) if start is None else start.copy()
    rest = xy - gram @ b
    for sweep in range(1, sweeps + 1):
        moved = 0.0
        for j, g in enumerate(np.diag(gram)):
            if g <= 0:
                continue
            new = float(soft(rest[j] + g * b[j], lam1)) / (g + lam2)
            if (d := new - b[j]) != 0.0:
                rest -= gram[:, j] * d
                b[j], moved = new, max(moved, abs(d))
        if moved < tol:
            return b, True, sweep
    return b, False, sweeps


def standardised(f: Factor) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, float]:
    """(correlation-like Gram, X'z, scales, means, mean of z), per unit of weight, x in population standard deviations."""
    gram, xy, mx, my, _ = f.centred()
    total = f.r[0, 0] ** 2
    scale = np.sqrt(np.maximum(np.diag(gram), 0) / total)
    flat = scale <= 1e-12 * np.maximum(1, np.abs(mx))
    scale = np.where(flat, 1.0, scale)
    gram = gram / total / np.outer(scale, scale)
    xy = xy / total / scale
    gram[flat, :] = gram[:, flat] = 0.0
    xy[flat] = 0.0
    return gram, xy, scale, mx, my


def coordinate(f: Factor, lam1: float, lam2: float, start: np.ndarray | None = None, intercept: bool = True, **how) -> tuple[np.ndarray, bool, int, np.ndarray]:
    gram, xy, scale, mx, my = standardised(f)
    b, done, sweeps = descend(gram, xy, lam1, lam2, start, **how)
    slopes = b / scale
    return np.concatenate([[my - mx @ slopes if intercept else 0.0], slopes]), done, sweeps, b


@register(SquaredError, "l1")
@register(SquaredError, "mixed")
def lasso(spec: LinearSpec, rows: DataFrame, p: int, first: dict[str, Factor]) -> dict[str, Raw]:
    pen = spec.penalty
    if pen.count("l1") > 1 or pen.count("l2") > 1:
        raise TypeError("a squared-error fit takes one L1 part and one L2 part at most")
    if not pen.count("l1"):
        raise ValueError("a sum without an L1 part; use l2() alone")
    out = {}
    for name, f in first.items():
        beta, done, sweeps, _ = coordinate(f, pen.strength("l1"), pen.strength("l2"), intercept=spec.intercept)
        if not spec.intercept:
            raise ValueError("coordinate descent centres the target; keep the intercept")
        out[name] = beta, None, done, {"solver": "coordinate", "sweeps": sweeps, "penalty_value": pen.value(beta)}
    return out


def working_logistic(eta: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    small = np.exp(-np.abs(eta))
    p = np.clip(np.where(eta >= 0, 1.0, small) / (1.0 + small), 1e-12, 1 - 1e-12)
    v = p * (1 - p)
    return v, eta + (y - p) / v


def iterate(rows: DataFrame, p: int, first: dict[str, Factor], update: Callable, intercept: bool, tol: float = 1e-8, most: int = 100, starts: dict[str, np.ndarray] | None = None) -> dict[str, tuple[np.ndarray, Factor, bool, int]]:
    """Newton-type steps for all groups at once; a group that has settled leaves the next jobs. starts: coefficients to begin with."""
    betas = dict(starts or {})
    for name, f in first.items():
        if name in betas:
            continue
        mean = min(max(f.sy / f.sw, 1e-12), 1 - 1e-12)
        betas[name] = np.concatenate([[np.log(mean / (1 - mean)) if intercept else 0.0], np.zeros(p)])
    out: dict[str, tuple] = {}
    for step in range(1, most + 1):
        now = {k: b for k, b in betas.items() if k not in out}
        if not now:
            break
        found = factors(rows, p, now, working_logistic)
        for name, f in found.items():
            new = update(f)
            small = np.linalg.norm(new - betas[name]) / max(np.linalg.norm(betas[name]), 1.0) < tol
            betas[name] = new
            if small or step == most or not np.isfinite(new).all():
                out[name] = new, f, bool(small), step
    return out


@register(Logistic, "none")
def irls(spec: LinearSpec, rows: DataFrame, p: int, first: dict[str, Factor]) -> dict[str, Raw]:
    def update(f: Factor) -> np.ndarray:
        r, q = linear_parts(f, spec.intercept)
        return with_zero(np.linalg.lstsq(r, q, rcond=None)[0], spec.intercept)

    out = {}
    for name, (beta, f, done, steps) in iterate(rows, p, first, update, spec.intercept).items():
        r = linear_parts(f, spec.intercept)[0]
        out[name] = beta, np.sqrt((np.linalg.pinv(r) ** 2).sum(1)), done, {"solver": "irls", "iterations": steps}
    return out


@register(Logistic, "l2")
def irls_ridge(spec: LinearSpec, rows: DataFrame, p: int, first: dict[str, Factor]) -> dict[str, Raw]:
    lam = spec.penalty.strength("l2")

    def update(f: Factor) -> np.ndarray:
        r, q = linear_parts(f, spec.intercept)
        extra = np.sqrt(f.n * lam) * np.eye(len(q))[int(spec.intercept) :]
        return with_zero(np.linalg.lstsq(np.concatenate([r, extra]), np.concatenate([q, np.zeros(len(extra))]), rcond=None)[0], spec.intercept)

    return {name: (beta, None, done, {"solver": "irls_ridge", "iterations": steps, "penalty_value": spec.penalty.value(beta)}) for name, (beta, _, done, steps) in iterate(rows, p, first, update, spec.intercept).items()}


@register(Logistic, "l1")
@register(Logistic, "mixed")
def prox_newton(spec: LinearSpec, rows: DataFrame, p: int, first: dict[str, Factor]) -> dict[str, Raw]:
    found = iterate(rows, p, first, prox_update(spec), True)
    return {name: (beta, None, done, {"solver": "prox_newton", "iterations": steps, "penalty_value": spec.penalty.value(beta)}) for name, (beta, _, done, steps) in found.items()}


def prox_update(spec: LinearSpec) -> Callable[[Factor], np.ndarray]:
    """The next coefficients: penalised working problems, solved by coordinate descent in units of the working standard deviations."""
    if not spec.intercept:
        raise ValueError("coordinate descent centres the working response; keep the intercept")

    def update(f: Factor) -> np.ndarray:
        ratio = f.n / f.r[0, 0] ** 2
        return coordinate(f, spec.penalty.strength("l1") * ratio, spec.penalty.strength("l2") * ratio, tol=1e-9, sweeps=2000)[0]

    return update


def check_target(spec: LinearSpec, f: Factor, rows: DataFrame, group: str = "") -> None:
    if isinstance(spec.loss, Logistic) and (f.least < 0 or f.largest > 1):
        raise AssumptionError(f"{spec.target} must lie in [0, 1] for a logistic loss; it spans [{f.least:g}, {f.largest:g}]; values outside 0 to 1: {outside(rows.filter(F.col("grp").eqNullSafe(F.lit(group))), "y")}")


def outside(df: DataFrame, target: str) -> str:
    """The five smallest values of a target that are no proportion."""
    y = F.col(target).cast("double")
    return ", ".join(f"{r[0]:g}" for r in df.filter((y < 0) | (y > 1)).select(y).distinct().orderBy(y).limit(5).collect())


def check_columns(spec: LinearSpec, df: DataFrame, weights: str | None) -> None:
    absent = [c for c in [spec.target, *spec.reads(), *([weights] if weights else [])] if c not in df.columns]
    if absent:
        raise KeyError(f"no column {', '.join(absent)}; there are {', '.join(df.columns)}")


def prepare(spec: LinearSpec, df: DataFrame, weights: str | None) -> tuple[tuple, list[tuple[str, Column]]]:
    check_columns(spec, df, weights)
    states = learn(spec.features, df, spec.target, weights)[""]
    columns = [c for t, s in zip(spec.features, states) for c in t.columns(s)]
    unlike([n for n, _ in columns])
    return states, columns


def unlike(names: list[str]) -> None:
    if len(set(names)) < len(names):
        raise ValueError(f"several columns are named {', '.join(sorted({n for n in names if names.count(n) > 1}))}")


def fit_groups(spec: LinearSpec, rows: DataFrame, names: list[str], states: tuple, first: dict[str, Factor] | None = None) -> dict[str, Solution]:
    """One fit for each group of design rows, all in the same jobs. names: of the design's columns."""
    return fit_segments(spec, rows, len(names), lambda group: (names, states), first)


def fit_segments(spec: LinearSpec, rows: DataFrame, p: int, of: Callable[[str], tuple[list[str], tuple]], first: dict[str, Factor] | None = None) -> dict[str, Solution]:
    """The same where groups have columns and states of their own. of: (names, states) of a group."""
    solver = SOLVERS.get((type(spec.loss), spec.penalty.kind))
    if solver is None:
        raise LookupError(f"no solver for {type(spec.loss).__name__} with {spec.penalty.kind}; there are {sorted((a.__name__, b) for a, b in SOLVERS)}")
    if first is None:
        first = factors(rows, p)
    for group, f in first.items():
        if f.sw <= 0:
            raise ValueError("weights must not be negative, and one at least positive")
        bad = dependent(f.r[:, :-1] if spec.intercept else f.r[:, 1:-1], f.n)
        if bad:
            labels = [INTERCEPT, *of(group)[0]] if spec.intercept else of(group)[0]
            where = f" in segment {group}" if group else ""
            raise AssumptionError(f"the design isn't of full rank{where}: {', '.join(labels[i] for i in bad)} depends on other columns")
        check_target(spec, f, rows, group)
    out = {}
    for group, (beta, se, done, info) in solver(spec, rows, p, first).items():
        names, states = of(group)
        labels = [INTERCEPT, *names] if spec.intercept else names
        values = beta if spec.intercept else beta[1:]
        out[group] = Solution(spec, dict(zip(labels, map(float, values))), None if se is None else dict(zip(labels, map(float, se))), states, first[group].n, first[group].sw, done, info, factor=first[group])
    return out


def solve(spec: LinearSpec | SegmentedSpec, df: DataFrame, *, weights: str | None = None, on_violation: str = "raise", suppress: tuple = (), classical_inference: bool = False, stability_splitter=None):
    """Fits a spec. weights: a column's name. on_violation: raise, warn or ignore for failed assumptions."""
    if not isinstance(df, DataFrame):
        raise TypeError("rows come as a Spark DataFrame")
    if on_violation not in ("raise", "warn", "ignore"):
        raise ValueError("on_violation is raise, warn or ignore")
    if isinstance(spec, SegmentedSpec):
        return solve_segments(spec, df, weights)
    from riskloom.plans.assume import run_assumptions

    states, columns = prepare(spec, df, weights)
    rows = design(df, columns, spec.target, weights)
    iterative = isinstance(spec.loss, Logistic)
    if iterative:
        rows = compacted(rows).persist()
    try:
        found = fit_groups(spec, rows, [n for n, _ in columns], states)
    finally:
        if iterative:
            rows.unpersist()
    if not found:
        raise ValueError("there are no rows")
    sol = found[""]
    return replace(sol, assumptions=run_assumptions(sol, df, weights, on_violation, suppress, classical_inference, stability_splitter))


def by_segment(terms: tuple) -> bool:
    """True if what the terms learn can differ between segments of the same job: all kinds but those whose fit() a user has written."""
    return all(by_segment(t.terms) if isinstance(t, Product) else t.packed is not None or type(t).fit is Term.fit for t in terms)


def solve_segments(spec: SegmentedSpec, df: DataFrame, weights: str | None) -> SegmentedSolution:
    """All segments share all jobs: what terms learn comes from grouped passes, and rows meet the states of their segment in a join. Segments whose bins give other numbers of columns are factored in jobs of their own, one for each number. Only terms with a fit() of the user's own are fitted segment by segment."""
    base, by = spec.base, F.col(spec.by)
    check_columns(base, df, weights)
    present = df.filter(by.isNotNull())
    found: dict[str, Solution] = {}
    if by_segment(base.features) and not packs(base.features):
        states, columns = prepare(base, present, weights)
        rows = design(present, columns, base.target, weights, by)
        if isinstance(base.loss, SquaredError) and (SquaredError, base.penalty.kind) in SOLVERS:
            table, names = solved_in_tasks(base, rows, len(columns)), [n for n, _ in columns]
            n = table.count()
            bad = table.filter("beta is null").orderBy("grp").limit(1).collect()
            if bad:
                fit_segments(base, rows, len(columns), lambda seg: (names, states), {bad[0].grp: factor_of(bad[0])})  # raises
            if not n:
                raise ValueError(f"{spec.by} has no segment")
            return StoredSegments(spec, table, n, names, states)
        rows = compacted(rows).persist()
        try:
            found = fit_groups(base, rows, [n for n, _ in columns], states)
        finally:
            rows.unpersist()
    elif by_segment(base.features):
        states = learn_segments(base, present, weights, by)
        named = {seg: [n for t, x in zip(base.features, own) for n in t.names(x)] for seg, own in states.items()}
        by_width: dict[tuple, list[str]] = {}
        for seg, own in states.items():
            by_width.setdefault(tuple(len(t.names(x)) for t, x in zip(base.features, own)), []).append(seg)
        for names in named.values():
            unlike(names)
        for widths, segments in sorted(by_width.items()):
            rows = segment_design(base, present, weights, by, widths, {seg: states[seg] for seg in segments}, len(by_width) > 1).persist()
            try:
                found |= fit_segments(base, rows, sum(widths), lambda seg: (named[seg], states[seg]))
            finally:
                rows.unpersist()
    else:
        names = sorted(str(r[0]) for r in present.select(by.cast("string")).distinct().collect())
        found = {n: solve(base, present.filter(by.cast("string") == n), weights=weights, on_violation="ignore") for n in names}
    if not found:
        raise ValueError(f"{spec.by} has no segment")
    return SegmentedSolution(spec, found)


def learn_segments(base: LinearSpec, present: DataFrame, weights: str | None, by: Column) -> dict[str, tuple]:
    try:
        return learn(base.features, present, base.target, weights, by)
    except ValueError as e:
        if "no rows" in str(e):
            raise ValueError("the segment column has no segment") from e
        raise


def packs(terms: tuple) -> list[tuple[int, Term]]:
    return [(i, t) for i, t in enumerate(terms) if t.packed]


def segment_design(base: LinearSpec, present: DataFrame, weights: str | None, by: Column, widths: tuple, states: dict[str, tuple], only: bool) -> DataFrame:
    """Design rows whose columns follow the states of their segment. only: the states are those of some segments."""
    rows, own = present, packs(base.features)
    if own or only:
        table = {seg: tuple(t.pack(x[i]) for i, t in own) or (0,) for seg, x in states.items()}
        rows = joined(present.withColumn(SEG, by.cast("string")), table, ", ".join(f"_s{i} {t.packed}" for i, t in own) or "_s int")
    return design(rows, columns_by_segment(base.features, widths), base.target, weights, by)


def columns_by_segment(terms: tuple, widths: tuple) -> list[tuple[str, Column]]:
    return [(f"{i}_{j}", c) for i, (t, w) in enumerate(zip(terms, widths)) for j, c in enumerate(t.columns_of(F.col(f"_s{i}") if t.packed else None, w))]


def predict(sol, df: DataFrame, name: str = "prediction", warn_unseen: bool = True) -> DataFrame:
    """The rows with a prediction column. Those of unseen segments get NaN, with a warning when df is no stream. Segments' coefficients are a table that is joined to the rows, so the plan doesn't grow with their number."""
    if isinstance(sol, Solution):
        return df.withColumn(name, sol.score())
    base, key = sol.spec.base, F.col(sol.spec.by).cast("string")
    if not by_segment(base.features):
        out = F.lit(float("nan"))
        for segment, own in sorted(sol.solutions.items()):
            out = F.when(key == segment, own.score()).otherwise(out)
        return df.withColumn(name, out)
    if isinstance(sol, StoredSegments):
        table = sol.table.select(F.col("grp").alias("_segment"), F.col("beta").alias("_beta"))
        return from_table(sol, df, name, warn_unseen, F.broadcast(table) if sol.n * (64 + 16 * (len(sol.names) + 1)) <= SENT_BYTES else table, tuple(len(t.names(x)) for t, x in zip(base.features, sol.states)))
    sizes = [[len(t.names(x)) for t, x in zip(base.features, own.states)] for own in sol.solutions.values()]
    widths = tuple(max(w) for w in zip(*sizes))
    own = packs(base.features)
    rows = []
    for (seg, fit), width in zip(sol.solutions.items(), sizes):
        values = list(fit.coefficients.values())
        beta = [values.pop(0)] if base.intercept else [0.0]
        for n, w in zip(width, widths):  # bins that other segments have and this one lacks
            beta += [values.pop(0) for _ in range(n)] + [0.0] * (w - n)
        rows.append((seg, beta, *(t.pack(fit.states[i]) for i, t in own)))
    kind = ", ".join(["_segment string", "_beta array<double>", *(f"_s{i} {t.packed}" for i, t in own)])
    table = df.sparkSession.createDataFrame(rows, kind)
    if sum(64 + 16 * len(r[1]) + 64 * len(own) * (1 + sum(widths)) for r in rows) <= SENT_BYTES:
        table = F.broadcast(table)
    return from_table(sol, df, name, warn_unseen, table, widths)


def from_table(sol: SegmentedSolution, df: DataFrame, name: str, warn_unseen: bool, table: DataFrame, widths: tuple) -> DataFrame:
    base, key = sol.spec.base, F.col(sol.spec.by).cast("string")
    keyed = df.withColumn("_key", key).join(table, F.col("_key") == F.col("_segment"), "left")
    if warn_unseen and not df.isStreaming:
        keys = df.groupBy(key.alias("_key")).count()
        unseen = keys.join(table.select("_segment"), F.col("_key") == F.col("_segment"), "left_anti").limit(20).collect()
        if unseen:
            warn.warn(f"{sum(r['count'] for r in unseen)} rows of unseen segments {sorted(str(r['_key']) for r in unseen)} get NaN", stacklevel=2)
    eta = F.col("_beta")[0]
    for j, (_, column) in enumerate(columns_by_segment(base.features, widths)):
        eta = eta + F.col("_beta")[j + 1] * column
    score = F.when(F.col("_segment").isNull(), F.lit(float("nan"))).otherwise(base.loss.link(eta))
    return keyed.select(*[keyed[c] for c in df.columns if c != name], score.alias(name))
