"""Inspection of fits: coefficient tables, binning tables, residual diagnostics and influence.

Leverages come from each row's design vector and the inverse of a small matrix held as literals; no matrix over rows is built, except by hat_matrix() for few rows.
"""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from riskloom.functions.special import normal_tail, t_tail
from riskloom.operators.binning import BinningResult
from riskloom.plans.solve import INTERCEPT, Solution
from riskloom.values import Logistic


def coefficients(sol: Solution, spark) -> DataFrame:
    """term, estimate, std_error, z, p_value: Student's t for least squares, normal otherwise, NaN for penalised fits."""
    rows = []
    for name, b in sol.coefficients.items():
        se = (sol.std_errors or {}).get(name, math.nan)
        z = b / se if se else math.nan
        p = math.nan if math.isnan(z) else normal_tail(z) if isinstance(sol.spec.loss, Logistic) else t_tail(z, sol.solver_info["df_resid"])
        rows.append((name, float(b), float(se), float(z), float(p)))
    return spark.createDataFrame(rows, "term string, estimate double, std_error double, z double, p_value double")


def binning_table(sol: Solution, spark) -> DataFrame:
    """term, bin, label, n, n_events, event_rate, woe, iv of every binned term."""
    out = None
    for term, state in zip(sol.spec.features, sol.states):
        if isinstance(state, BinningResult):
            t = state.table(spark).withColumn("term", F.lit(term.col))
            out = t if out is None else out.unionByName(t)
    if out is None:
        raise ValueError("no term of the model is binned")
    return out.select("term", "bin", "label", "n", "n_events", "event_rate", "woe", "iv")


def least_squares_only(sol: Solution) -> None:
    if isinstance(sol.spec.loss, Logistic) or sol.spec.penalty.kind not in ("none", "l2"):
        raise NotImplementedError("diagnostics need a least-squares or ridge fit")


def vector(sol: Solution) -> list[Column]:
    return ([F.lit(1.0)] if INTERCEPT in sol.coefficients else []) + [c for _, c in sol.columns]


def inverse(sol: Solution, penalised: bool = True) -> np.ndarray:
    """Inverse of X'X (+ n lambda on slopes) from the unweighted factor of the fit."""
    r = sol.factor.r[:-1, :-1]
    has = INTERCEPT in sol.coefficients
    gram = r.T @ r if has else (sol.factor.r[:, 1:-1].T @ sol.factor.r[:, 1:-1])
    lam = sol.spec.penalty.strength("l2") if penalised else 0.0
    keep = np.ones(len(gram))
    keep[0] = 0.0 if has else 1.0
    return np.linalg.inv(gram + sol.n_obs * lam * np.diag(keep))


def quadratic(x: list[Column], m: np.ndarray) -> Column:
    """x'Mx as an expression."""
    out = F.lit(0.0)
    for i in range(len(x)):
        inner = F.lit(float(m[i, i])) * x[i]
        for j in range(i + 1, len(x)):
            inner = inner + F.lit(float(2 * m[i, j])) * x[j]
        out = out + x[i] * inner
    return out


def with_vector(sol: Solution, df: DataFrame) -> tuple[DataFrame, list[Column]]:
    """Evaluates design columns once, so that expressions over pairs of them stay small."""
    made = {f"_x{i}": c for i, c in enumerate(vector(sol))}
    return df.withColumns(made), [F.col(c) for c in made]


def diagnostics(sol: Solution, df: DataFrame) -> DataFrame:
    """The rows with residual, leverage, cooks_distance and studentised residual."""
    least_squares_only(sol)
    rows, x = with_vector(sol, df)
    rows = rows.withColumn("residual", F.col(sol.spec.target).cast("double") - sol.eta()).withColumn("leverage", quadratic(x, inverse(sol)))
    p = len(x)
    n, rss = df.agg(F.count("*"), F.sum(F.pow(F.col(sol.spec.target).cast("double") - sol.eta(), F.lit(2.0)))).first()
    sigma2 = rss / (n - p)
    e, h = F.col("residual"), F.col("leverage")
    return rows.select(*df.columns, "residual", "leverage", (e * e * h / (F.lit(p * sigma2) * (1 - h) * (1 - h))).alias("cooks_distance"), (e / F.sqrt(F.lit(sigma2) * (1 - h))).alias("studentised"))


def influence(sol: Solution, df: DataFrame) -> DataFrame:
    """The rows with leverage, cooks_distance and dfbetas (a value for each coefficient), by the unpenalised inverse."""
    least_squares_only(sol)
    m = inverse(sol, False)
    rows, x = with_vector(sol, df)
    p = len(x)
    e = F.col(sol.spec.target).cast("double") - sol.eta()
    n, rss = df.agg(F.count("*"), F.sum(F.pow(e, F.lit(2.0)))).first()
    sigma2 = rss / (n - p)
    rows = rows.withColumn("_e", e).withColumn("leverage", quadratic(x, m))
    h, r = F.col("leverage"), F.col("_e")
    left_out = (F.lit(rss) - r * r / (1 - h)) / F.lit(n - p - 1)
    change = [sum((F.lit(float(m[j, i])) * x[i] for i in range(p)), F.lit(0.0)) * r / (1 - h) / F.sqrt(left_out * F.lit(float(m[j, j]))) for j in range(p)]
    return rows.select(*df.columns, "leverage", (r * r * h / (F.lit(p * sigma2) * (1 - h) * (1 - h))).alias("cooks_distance"), F.array(*change).alias("dfbetas"))


def hat_matrix(sol: Solution, df: DataFrame, order_by: str, most: int = 2000) -> DataFrame:
    """(i, j, h) over all pairs of few rows, numbered by a column; refused for more than `most` rows, as pairs grow with the square."""
    least_squares_only(sol)
    n = df.limit(most + 1).count()
    if n > most:
        raise ValueError(f"more than {most} rows; use diagnostics() for leverages")
    rows = sorted(df.select(F.col(order_by).alias("k"), F.array(*vector(sol)).alias("x")).collect(), key=lambda r: r.k)
    x = np.array([r.x for r in rows])
    h = x @ inverse(sol) @ x.T
    return df.sparkSession.createDataFrame([(i, j, float(h[i, j])) for i in range(n) for j in range(n)], "i int, j int, h double")
