"""Full reports of all values of a key (segments, validation windows) in shared jobs: one frame of key, figure, value.

All rank figures (AUC and its interval, KS, spread within classes, median) are read off one table of masses by key and
score with running sums. Bins of equal mass are cut within keys. Calibration slopes and intercepts are Newton steps of all
keys at once: a step is one grouped aggregate over distinct scores, and the keys' coefficients stay in Spark, so neither
the number of jobs nor what the driver holds grows with the number of keys. A null key is a key.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from riskloom.functions import metrics as m
from riskloom.functions import ranking
from riskloom.functions.special import normal_quantile
from riskloom.plans.reports import shift_from, windows
from riskloom.plans.solve import Solution
from riskloom.plans.splits import Splitter
from riskloom.sources.store import discard, stored

KEY = "key"
FIGURES = ("n_obs", "n_events", "auc", "auc_low", "auc_high", "gini", "ks", "ks_at", "cohens_d", "brier", "log_loss", "ece", "slope", "intercept", "psi", "mean", "median", "least", "largest")


def joined(left: DataFrame, right: DataFrame, how: str = "left") -> DataFrame:
    right = right.withColumnRenamed(KEY, "_key")
    return left.join(right, F.col(KEY).eqNullSafe(F.col("_key")), how).drop("_key")


def flat_figures(frame: DataFrame, eps: float) -> DataFrame:
    w, one = F.col("w"), F.col("y") == 1
    mean = lambda c: F.try_divide(F.sum(w * c), F.sum(w))
    of = lambda hit, tag: [F.sum(F.when(hit, w)).alias(f"w{tag}"), F.try_divide(F.sum(F.when(hit, w) * F.col("s")), F.sum(F.when(hit, w))).alias(f"m{tag}")]
    return frame.groupBy(KEY).agg(F.count("*").alias("n_obs"), F.count_if(one).alias("n_events"), mean(m.brier_column()).alias("brier"), mean(m.log_loss_column(eps)).alias("log_loss"), mean(F.col("s")).alias("mean"), F.min("s").alias("least"), F.max("s").alias("largest"), F.min("w").alias("w_least"), (F.min("w") == F.max("w")).alias("even"), *of(one, 1), *of(~one, 0))


def rank_figures(curve: DataFrame, flat: DataFrame, level: float) -> DataFrame:
    """auc, its interval, gini, ks, ks_at, cohens_d, median of each key; null where a class is missing."""
    rows = joined(curve, flat.select(KEY, "m1", "m0", "w1", "w0", "w_least", "even"))
    p, n, cp, cn, events, others = (F.col(c) for c in ("p", "n", "cp", "cn", "all_cp", "all_cn"))
    share = F.try_divide  # null where a class is missing
    below, above = share(cn - n / 2, others) - 0.5, share(events - cp + p / 2, events) - 0.5
    gap = F.abs(share(cp, events) - share(cn, others))
    place = (F.col("all_cc") - 1) / 2
    end = lambda k: F.min(F.when(F.col("cc") > k, F.col("s")))
    both = (F.first("all_cp") > 0) & (F.first("all_cn") > 0)
    sums = rows.groupBy(KEY).agg(
        both.alias("both"),
        F.max(F.struct(gap.alias("gap"), (-F.col("s")).alias("minus"))).alias("top"),
        *[F.first(c).alias(c) for c in ("w1", "w0", "w_least", "even", "all_cp", "all_cn")],
        F.sum(p * F.pow(F.col("s") - F.col("m1"), F.lit(2)) + n * F.pow(F.col("s") - F.col("m0"), F.lit(2))).alias("spread"),
        *[F.sum(c).alias(k) for k, c in (("a1", p * below), ("a2", p * below * below), ("b1", n * above), ("b2", n * above * above))],
        ((end(F.floor(place)) + end(F.ceil(place))) / 2).alias("median"),
        F.first("m1").alias("m1"),
        F.first("m0").alias("m0"),
    )
    count = lambda c: share(F.col(c), F.col("w_least"))  # noqa: E731  rows of a class; all weights are equal where this is used
    part = lambda one, two, size: F.when(size > 1, share(share(count(two) - share(F.pow(count(one), F.lit(2)), size), size - 1), size)).otherwise(0.0)
    auc = 0.5 + share(F.col("a1"), F.col("all_cp"))
    reach = F.lit(normal_quantile(0.5 + level / 2)) * F.sqrt(F.greatest(part("a1", "a2", count("all_cp")) + part("b1", "b2", count("all_cn")), F.lit(0.0)))
    sd = F.sqrt(share(F.col("spread"), F.col("w1") + F.col("w0") - 2))
    told = lambda c, more=F.lit(True): F.when(F.col("both") & more, c)
    effect = (F.col("w1") >= 2) & (F.col("w0") >= 2) & (sd > 0)
    return sums.select(KEY, told(auc).alias("auc"), told(F.greatest(auc - reach, F.lit(0.0)), F.col("even")).alias("auc_low"), told(F.least(auc + reach, F.lit(1.0)), F.col("even")).alias("auc_high"), told(2 * auc - 1).alias("gini"), told(F.col("top.gap")).alias("ks"), told(-F.col("top.minus")).alias("ks_at"), told(share(F.col("m1") - F.col("m0"), sd), effect).alias("cohens_d"), "median")


def slopes(curve: DataFrame, eps: float, tol: float = 1e-10, most: int = 60) -> DataFrame:
    """slope, intercept of each key: logistic regressions of y on the log odds of s. A step that raises the loss is halved; keys leave the steps as they settle; those that lack a class have none."""
    clipped = F.least(F.greatest(F.col("s"), F.lit(eps)), F.lit(1 - eps))
    odds = stored(curve.groupBy(KEY, F.log(clipped / (1 - clipped)).alias("x")).agg(F.sum(F.col("p") + F.col("n")).alias("w"), F.sum("p").alias("e")), "log-odds")
    zero = F.lit(0.0)
    both = odds.groupBy(KEY).agg(F.sum("e").alias("e"), F.sum(F.col("w") - F.col("e")).alias("o")).filter("e > 0 and o > 0")
    state = stored(both.select(KEY, *[zero.alias(c) for c in ("a", "b", "da", "db")], F.lit(math.inf).alias("low"), F.lit(False).alias("done")), "newton")
    held = [KEY, "a", "b", "da", "db", "low"]
    for _ in range(most):
        rows = odds.join(state.filter("not done").withColumnRenamed(KEY, "_key"), F.col(KEY).eqNullSafe(F.col("_key"))).drop("_key")
        x, eta = F.col("x"), F.col("a") + F.col("b") * F.col("x")
        p = 1 / (1 + F.exp(-eta))
        v, r = F.col("w") * p * (1 - p), F.col("e") - F.col("w") * p
        loss = F.col("w") * (F.greatest(eta, zero) + F.log1p(F.exp(-F.abs(eta)))) - F.col("e") * eta
        sums = rows.groupBy(*held).agg(F.sum(v).alias("h0"), F.sum(v * x).alias("h1"), F.sum(v * x * x).alias("h2"), F.sum(r).alias("g0"), F.sum(r * x).alias("g1"), F.sum(loss).alias("loss"))
        after = stored(state.filter("done").unionByName(stepped(sums, tol)), "newton")
        discard(state)
        state = after
        if state.filter("not done").isEmpty():
            break
    discard(odds)
    return state.select(KEY, F.col("b").alias("slope"), F.col("a").alias("intercept"))


def stepped(sums: DataFrame, tol: float) -> DataFrame:
    h0, h1, h2, g0, g1 = (F.col(c) for c in ("h0", "h1", "h2", "g0", "g1"))
    det = h0 * h2 - h1 * h1
    flat = det <= 1e-13 * h0 * h2  # one score only: the shortest step
    at = F.coalesce(F.try_divide(h1, h0), F.lit(0.0))
    short = F.coalesce(F.try_divide(g0, h0 * (1 + at * at)), F.lit(0.0))
    step_a, step_b = F.when(flat, short).otherwise(F.try_divide(g0 * h2 - g1 * h1, det)), F.when(flat, short * at).otherwise(F.try_divide(g1 * h0 - g0 * h1, det))
    good = F.col("loss") <= F.col("low") + F.when(F.col("low") == math.inf, 0.0).otherwise(1e-12 * F.abs(F.col("low")))
    rows = sums.withColumns({"good": good, "sa": F.when(good, step_a).otherwise(F.col("da") / 2), "sb": F.when(good, step_b).otherwise(F.col("db") / 2)})
    settled = F.col("good") & (F.greatest(F.abs("sa"), F.abs("sb")) < tol)
    sign = F.when(settled, 0.0).when(F.col("good"), 1.0).otherwise(-1.0)
    return rows.select(KEY, (F.col("a") + sign * F.col("sa")).alias("a"), (F.col("b") + sign * F.col("sb")).alias("b"), F.col("sa").alias("da"), F.col("sb").alias("db"), F.when(F.col("good"), F.col("loss")).otherwise(F.col("low")).alias("low"), settled.alias("done"))


def figures_of_keys(frame: DataFrame, shift: DataFrame | None = None, n_bins: int = 10, level: float = 0.95, eps: float = 1e-12, ties: tuple[str, ...] = ()) -> DataFrame:
    """key, figure, value of a frame of key, y, s, w. A key that lacks a class has no rank figures, slope or intercept; uneven weights give no interval."""
    m.checked(frame)
    flat = stored(flat_figures(frame, eps), "flat-figures")
    masses = frame.groupBy(KEY, "s").agg(*ranking.class_masses(), F.count("*").alias("c"))
    ranked = ranking.running(masses, "s", {"cp": F.col("p"), "cn": F.col("n"), "cc": F.col("c")}, (KEY,), whole=True)
    curve = stored(ranked, "curve")
    ranking.release(ranked)
    error = F.try_divide(F.sum(F.col("n") * F.abs(F.col("observed") - F.col("predicted"))), F.sum("n"))
    bins = ranking.calibration_bins(frame, n_bins, ties, (KEY,)).groupBy(KEY).agg(error.alias("ece"))
    out = joined(joined(joined(flat, rank_figures(curve, flat, level)), bins), slopes(curve, eps))
    out = joined(out, shift) if shift is not None else out.withColumn("psi", F.lit(None).cast("double"))
    pairs = ", ".join(f"'{c}', cast({c} AS double)" for c in FIGURES)
    return out.select(KEY, F.expr(f"stack({len(FIGURES)}, {pairs}) AS (figure, value)")).filter("value is not null")


def frame_by(sol: Solution, df: DataFrame, key: Column, weights: str | None, ties: tuple[str, ...]) -> DataFrame:
    return m.frame_of(sol, df.withColumn(KEY, key), weights, tuple(dict.fromkeys((KEY, *ties))))


def figures_by_segment(sol: Solution, df: DataFrame, by: str, *, weights: str | None = None, reference=None, n_bins: int = 10, psi_bins: int = 10, auc_ci_level: float = 0.95, eps: float = 1e-12, ties: tuple[str, ...] = ()) -> DataFrame:
    """The figures of performance() for each value of a column, however many: key, figure, value."""
    frame = frame_by(sol, df, F.col(by), weights, ties)
    shift = None if reference is None else shift_from(reference, sol, frame, KEY, psi_bins).select(KEY, "psi")
    return figures_of_keys(frame, shift, n_bins, auc_ci_level, eps, ties)


def figures_over_time(sol: Solution, df: DataFrame, splitter: Splitter, **options) -> DataFrame:
    """The same for each validation window that has rows; key is the window's number."""
    return figures_by_segment(sol, windows(df, splitter), "window", **options)
