"""Held-out metrics. Each takes (solution, rows, weights=a column's name); each *_of takes a frame of y, s, w."""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from riskloom.display import html_table
from riskloom.functions import ranking
from riskloom.functions.quantiles import quantiles
from riskloom.functions.special import normal_quantile, normal_tail
from riskloom.plans.solve import Solution
from riskloom.sources.store import discard, stored


@dataclass(frozen=True)
class Metric:
    """A number with its name; `at` tells where it is attained, if anywhere."""

    name: str
    value: float
    at: float | None = None

    def __float__(self) -> float:
        return self.value

    def to_df(self, spark) -> DataFrame:
        return spark.createDataFrame([(self.name, self.value)], "metric string, value double")

    def _repr_html_(self) -> str:
        return html_table(("metric", "value", "at"), [(self.name, self.value, "" if self.at is None else self.at)])


def frame_of(sol: Solution, df: DataFrame, weights: str | None = None, keep: tuple[str, ...] = ()) -> DataFrame:
    return ranking.scored(df, F.col(sol.spec.target), sol.score(), F.col(weights) if weights else None, keep)


def checked(frame: DataFrame) -> DataFrame:
    """Raises for missing or infinite targets, scores and weights."""
    bad = lambda c: F.col(c).isNull() | F.isnan(c) | (F.abs(F.col(c)) == math.inf)
    n, odd = frame.agg(F.count("*"), F.sum((bad("y") | bad("s") | bad("w") | (F.col("w") < 0)).cast("int"))).first()
    if not n or odd:
        raise ValueError("there are no rows" if not n else f"{odd} rows have a target, score or weight that is missing, infinite or negative")
    return frame


def both_classes(row) -> None:
    if row is None or row["auc"] is None:
        raise ValueError("both classes must be present")


def auc_of(frame: DataFrame) -> Metric:
    row = ranking.discrimination(checked(frame)).first()
    both_classes(row)
    return Metric("auc", row["auc"])


def ks_of(frame: DataFrame) -> Metric:
    row = ranking.discrimination(checked(frame)).first()
    both_classes(row)
    return Metric("ks", row["ks"], row["ks_at"])


def auc(sol: Solution, df: DataFrame, *, weights: str | None = None) -> Metric:
    return auc_of(frame_of(sol, df, weights))


def gini(sol: Solution, df: DataFrame, *, weights: str | None = None) -> Metric:
    return Metric("gini", 2 * auc(sol, df, weights=weights).value - 1)


def ks(sol: Solution, df: DataFrame, *, weights: str | None = None) -> Metric:
    return ks_of(frame_of(sol, df, weights))


def effect_columns(uniform: bool) -> list:
    """mean and variance of the scores of each class; the divisor is the class's weight less one."""
    out = []
    for label, hit in (("1", F.col("y") == 1), ("0", F.col("y") != 1)):
        w = F.when(hit, F.col("w"))
        mean = F.sum(w * F.col("s")) / F.sum(w)
        out += [F.sum(w).alias(f"w{label}"), mean.alias(f"m{label}")]
    return out


def cohens_d_of(frame: DataFrame) -> Metric:
    w1, m1, w0, m0 = checked(frame).agg(*effect_columns(True)).first()
    if not w1 or not w0 or w1 < 2 or w0 < 2:
        raise ValueError("each class needs a weight of two at least")
    spread = frame.agg(F.sum(F.when(F.col("y") == 1, F.col("w") * F.pow(F.col("s") - m1, F.lit(2))).otherwise(F.col("w") * F.pow(F.col("s") - m0, F.lit(2))))).first()[0]
    sd = math.sqrt(spread / (w1 + w0 - 2))
    if not sd:
        raise ValueError("the scores don't vary within the classes")
    return Metric("cohens_d", (m1 - m0) / sd)


def cohens_d(sol: Solution, df: DataFrame, *, weights: str | None = None) -> Metric:
    return cohens_d_of(frame_of(sol, df, weights))


def mean_of(frame: DataFrame, column) -> float:
    return checked(frame).agg(F.sum(F.col("w") * column) / F.sum("w")).first()[0]


def brier_column():
    return F.pow(F.col("y") - F.col("s"), F.lit(2.0))


def log_loss_column(eps: float = 1e-12):
    if not 0 < eps < 0.5:
        raise ValueError("eps lies between 0 and 0.5")
    p = F.least(F.greatest(F.col("s"), F.lit(eps)), F.lit(1 - eps))
    return -(F.col("y") * F.log(p) + (1 - F.col("y")) * F.log(1 - p))


def brier_score(sol: Solution, df: DataFrame, *, weights: str | None = None) -> Metric:
    return Metric("brier_score", mean_of(frame_of(sol, df, weights), brier_column()))


def log_loss(sol: Solution, df: DataFrame, *, weights: str | None = None, eps: float = 1e-12) -> Metric:
    return Metric("log_loss", mean_of(frame_of(sol, df, weights), log_loss_column(eps)))


def calibration_curve(sol: Solution, df: DataFrame, *, weights: str | None = None, n_bins: int = 10, ties: tuple[str, ...] = ()) -> DataFrame:
    """bin, predicted, observed, n. Tied scores are split by the columns in ties."""
    return ranking.calibration_bins(frame_of(sol, df, weights, ties), n_bins, ties)


def ece_of(frame: DataFrame, n_bins: int = 10, ties: tuple[str, ...] = ()) -> Metric:
    bins = ranking.calibration_bins(checked(frame), n_bins, ties).filter("n > 0")
    return Metric("ece", bins.agg(F.sum(F.col("n") * F.abs(F.col("observed") - F.col("predicted"))) / F.sum("n")).first()[0])


def ece(sol: Solution, df: DataFrame, *, weights: str | None = None, n_bins: int = 10, ties: tuple[str, ...] = ()) -> Metric:
    return ece_of(frame_of(sol, df, weights, ties), n_bins, ties)


def calibration_fit(frame: DataFrame, eps: float = 1e-12, tol: float = 1e-10) -> tuple[float, float]:
    """(slope, intercept) of a logistic regression of y on the log odds of s: Newton steps, each one aggregate."""
    p = F.least(F.greatest(F.col("s"), F.lit(eps)), F.lit(1 - eps))
    rows = checked(frame).select("y", "w", F.log(p / (1 - p)).alias("x"))
    rows = stored(rows.groupBy("x").agg(F.sum("w").alias("w"), F.sum(F.col("w") * F.col("y")).alias("e")), "log-odds")  # the steps read distinct scores only
    a, b, move, least = 0.0, 0.0, np.zeros(2), math.inf
    for _ in range(60):
        eta = F.lit(a) + F.lit(b) * F.col("x")
        m = 1 / (1 + F.exp(-eta))
        v, r = F.col("w") * m * (1 - m), F.col("e") - F.col("w") * m
        x, loss = F.col("x"), F.col("w") * (F.greatest(eta, F.lit(0.0)) + F.log1p(F.exp(-F.abs(eta)))) - F.col("e") * eta
        h = rows.agg(F.sum(v), F.sum(v * x), F.sum(v * x * x), F.sum(r), F.sum(r * x), F.sum(loss)).first()
        if not h[5] <= least + 1e-12 * abs(least):  # the step was too long
            move = move / 2
            a, b = a - float(move[0]), b - float(move[1])
            continue
        least = h[5]
        move = np.linalg.lstsq(np.array([[h[0], h[1]], [h[1], h[2]]]), np.array([h[3], h[4]]), rcond=None)[0]
        if np.abs(move).max() < tol:
            break
        a, b = a + float(move[0]), b + float(move[1])
    discard(rows)
    return b, a


def calibration_slope_intercept(sol: Solution, df: DataFrame, *, weights: str | None = None) -> tuple[float, float]:
    return calibration_fit(frame_of(sol, df, weights))


def lift_table(sol: Solution, df: DataFrame, *, weights: str | None = None, n_deciles: int = 10, ties: tuple[str, ...] = ()) -> DataFrame:
    return ranking.lift_bins(frame_of(sol, df, weights, ties), n_deciles, ties)


def cumulative_gains(sol: Solution, df: DataFrame, *, weights: str | None = None, ties: tuple[str, ...] = ()) -> DataFrame:
    return ranking.gains(frame_of(sol, df, weights, ties), ties)


def psi_edges(reference: DataFrame, bins: int | list[float]) -> list[float]:
    """Interior edges: equal-frequency quantiles, equal ones moved up by one float; of given edges the inner ones."""
    if not isinstance(bins, int):
        return [float(e) for e in list(bins)[1:-1]]
    if bins < 2:
        raise ValueError("two bins at least")
    cuts = quantiles(reference, "s", [i / bins for i in range(1, bins)])
    for i in range(1, len(cuts)):
        if cuts[i] <= cuts[i - 1]:
            cuts[i] = float(np.nextafter(cuts[i - 1], np.inf))
    return cuts


def psi_of(reference: DataFrame, current: DataFrame, bins: int | list[float] = 10, eps: float = 1e-6) -> Metric:
    """Population stability index of the column s of two frames, whose rows weigh w, or 1 where they have no w. Edges don't depend on weights."""
    if not 0 < eps < 1:
        raise ValueError("eps lies between 0 and 1")
    reference, current = (f if "w" in f.columns else f.withColumn("w", F.lit(1.0)) for f in (reference, current))
    return Metric("psi", ranking.stability(reference, current, psi_edges(reference, bins), eps).agg(F.sum("part")).first()[0])


def psi(reference: DataFrame, current: DataFrame, column: str = "prediction", *, bins: int | list[float] = 10, weights_reference: str | None = None, weights_current: str | None = None, eps: float = 1e-6) -> Metric:
    """bins: a number of equal-frequency bins of the reference, or edges; weights: names of columns; eps: the least share of a bin."""
    frames = []
    for rows, weights in ((reference, weights_reference), (current, weights_current)):
        frame = rows.select(F.col(column).cast("double").alias("s"), (F.col(weights).cast("double") if weights else F.lit(1.0)).alias("w"))
        if weights and not frame.filter(F.col("w").isNull() | F.isnan("w") | (F.col("w") < 0) | (F.col("w") == math.inf)).isEmpty():
            raise ValueError(f"{weights} holds weights that are missing, infinite or negative")
        frames.append(frame)
    return psi_of(*frames, bins, eps)


def weighted_quantile(df: DataFrame, column: str, weights: str, q: float) -> float:
    """Linear between the mid-points of weight steps: (running weight - w / 2) / all weight."""
    frame = df.select(F.col(column).cast("double").alias("s"), F.col(weights).cast("double").alias("w"))
    steps = ranking.running(frame.groupBy("s").agg(F.sum("w").alias("w")), "s", {"cw": F.col("w")})
    total = frame.agg(F.sum("w")).first()[0]
    at = (F.col("cw") - F.col("w") / 2) / total
    low = steps.select("s", at.alias("at")).filter(F.col("at") <= q).agg(F.max(F.struct("at", "s"))).first()[0]
    high = steps.select("s", at.alias("at")).filter(F.col("at") >= q).agg(F.min(F.struct("at", "s"))).first()[0]
    if low is None or high is None:
        return (low or high)["s"]
    return low["s"] if high["at"] == low["at"] else low["s"] + (high["s"] - low["s"]) * (q - low["at"]) / (high["at"] - low["at"])


def placements(counts: DataFrame, score: str) -> DataFrame:
    """For each value of a score: below, the share of other rows under it (ties half), and above, the share of events over it. counts: y, scores, c."""
    curve = ranking.rank_curve(counts.select("y", F.col(score).alias("s"), F.col("c").cast("double").alias("w")))
    below = (F.col("cn") - F.col("n") / 2) / F.col("all_cn")
    above = (F.col("all_cp") - F.col("cp") + F.col("p") / 2) / F.col("all_cp")
    return curve.select(F.col("s").alias(score), below.alias("below"), above.alias("above"))


def delong_of(frame: DataFrame, scores: tuple[str, ...]) -> tuple[np.ndarray, np.ndarray]:
    """AUCs of several score columns of one frame (y and the scores) and their covariance matrix. The frame is read once: rows are counted by y and scores, and each score's placements join these counts."""
    counts = stored(frame.groupBy("y", *scores).agg(F.count("*").alias("c")), "score-counts")
    rows = counts
    for i, s in enumerate(scores):
        v = F.when(F.col("y") == 1, F.col("below")).otherwise(F.col("above")) - 0.5
        rows = rows.join(placements(counts, s), s).withColumn(f"v{i}", v).drop("below", "above")
    c = F.col("c")
    pairs = [(i, j) for i in range(len(scores)) for j in range(i, len(scores))]
    sums = [F.sum(c * F.col(f"v{i}")).alias(f"m{i}") for i in range(len(scores))] + [F.sum(c * F.col(f"v{i}") * F.col(f"v{j}")).alias(f"c{i}_{j}") for i, j in pairs]
    found = {r["y"]: r for r in rows.groupBy("y").agg(F.sum("c").alias("n"), *sums).collect()}
    if set(found) != {0.0, 1.0}:
        raise ValueError("both classes must be present")
    area = np.array([0.5 + found[1.0][f"m{i}"] / found[1.0]["n"] for i in range(len(scores))])
    cov = np.zeros((len(scores), len(scores)))
    for i, j in pairs:
        for r in found.values():
            n = r["n"]
            cov[i, j] += (r[f"c{i}_{j}"] - r[f"m{i}"] * r[f"m{j}"] / n) / (n - 1) / n if n > 1 else 0.0
        cov[j, i] = cov[i, j]
    return area, cov


@dataclass(frozen=True)
class DeLong:
    auc_a: float
    auc_b: float
    z: float
    p_value: float

    def _repr_html_(self) -> str:
        return html_table(("AUC a", "AUC b", "z", "p"), [(self.auc_a, self.auc_b, self.z, self.p_value)])


def delong_from(area: np.ndarray, cov: np.ndarray, a: int = 0, b: int = 1) -> DeLong:
    var = cov[a, a] + cov[b, b] - 2 * cov[a, b]
    z = float((area[a] - area[b]) / math.sqrt(var)) if var > 1e-300 else 0.0
    return DeLong(float(area[a]), float(area[b]), z, normal_tail(z))


def delong_test(sol_a: Solution, sol_b: Solution, df: DataFrame, *, weights: str | None = None) -> DeLong:
    if sol_a.spec.target != sol_b.spec.target:
        raise ValueError("both models must have the same target")
    if weights and df.select(weights).distinct().limit(2).count() > 1:
        raise NotImplementedError("the test takes no unequal weights")
    frame = df.select(F.col(sol_a.spec.target).cast("double").alias("y"), sol_a.score().alias("a"), sol_b.score().alias("b"))
    return delong_from(*delong_of(frame, ("a", "b")))


def auc_interval(area: float, var: float, level: float = 0.95) -> tuple[float, float]:
    z = normal_quantile(0.5 + level / 2)
    return max(0.0, area - z * math.sqrt(var)), min(1.0, area + z * math.sqrt(var))
