"""Folds that share jobs give what fits and metrics of each fold give."""

from datetime import timedelta

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

import riskloom as rl
from riskloom.plans.folds import Folds
from tests.test_shared import jobs_of


@pytest.fixture(scope="module")
def df(spark):
    rng = np.random.default_rng(11)
    n = 1500
    data = pd.DataFrame({"x": rng.normal(size=n), "z": rng.uniform(0, 5, n), "w": rng.integers(1, 4, n).astype(float), "t": pd.Timestamp("2020-01-01") + pd.to_timedelta(rng.integers(0, 1000, n), "D")})
    data["y"] = (rng.random(n) < 1 / (1 + np.exp(-data.x))).astype(int)
    data["v"] = 2 * data.x - data.z + rng.normal(size=n)
    out = spark.createDataFrame(data).persist()
    out.count()
    return out


def mean_error(sol, df):
    return df.agg(F.avg(F.abs(F.col(sol.spec.target) - sol.score()))).first()[0]


SPECS = [
    (rl.linear("v", ["x", "z"]), {"error": mean_error}),
    (rl.linear("v", ["x", rl.hinge("z", 2.0)], penalty=rl.l2(0.1)), {"error": mean_error}),
    (rl.linear("v", ["x", rl.poly("z", 2)]), {"error": mean_error}),
    (rl.linear("y", ["x", rl.woe("z", rl.monotonic(max_bins=4))], loss=rl.logistic()), {"auc": rl.auc, "ks": rl.ks, "gini": rl.gini, "brier": rl.brier_score, "loss": rl.log_loss, "d": rl.cohens_d}),
]


@pytest.mark.parametrize("i", range(len(SPECS)))
@pytest.mark.parametrize("weights", [None, "w"])
def test_same_as_fold_by_fold(df, i, weights):
    spec, metrics = SPECS[i]
    splitter = rl.expanding_window("t", 2, "200 days", "5 days", "300 days") if i % 2 else rl.purged_kfold("t", 3, "5 days", ("x",))
    cv = rl.cross_validate(spec, df, splitter, metrics, weights=weights)
    pairs = list(splitter.split(df))
    assert len(cv.folds) == len(pairs)
    for fold, (train, valid) in zip(cv.folds, pairs):
        own = rl.solve(spec, train, weights=weights, on_violation="ignore")
        assert (fold.n_train, fold.n_valid) == (train.count(), valid.count())
        assert list(own.coefficients) == list(fold.solution.coefficients)
        assert np.allclose(list(own.coefficients.values()), list(fold.solution.coefficients.values()), rtol=1e-7, atol=1e-9)
        for name, f in metrics.items():
            want = f(own, valid, weights=weights) if weights and f is not mean_error else f(own, valid)
            assert fold.metrics[name] == pytest.approx(float(want), rel=1e-7)
    assert list(cv.folds[0].metrics) == list(metrics)


def test_jobs_do_not_depend_on_the_number_of_folds(df):
    for spec in (rl.linear("v", ["x", "z"]), rl.linear("y", [rl.poly("x", 1), "z"], loss=rl.logistic())):
        few, many = (jobs_of(df.sparkSession, lambda n=n: rl.cross_validate(spec, df, rl.expanding_window("t", n, "60 days", min_train="300 days"), {"loss": rl.log_loss, "auc": rl.auc} if spec.target == "y" else {}))[0] for n in (2, 10))
        assert many <= few + (2 if spec.target == "y" else 0)  # a Newton step more of the slowest fold
    grid = rl.expanding_window("t", 3, "100 days", min_train="300 days")
    one, five = (jobs_of(df.sparkSession, lambda g=g: rl.tune(lambda lam: rl.linear("v", ["x", "z"], penalty=rl.l1(lam)), {"lam": g}, df, grid, lambda sol, rows: sol.coefficients["x"]))[0] for g in ([0.1], [0.1, 0.2, 0.3, 0.4, 0.5]))
    assert one == five


def test_windows_of_a_metric(df):
    sol = rl.solve(rl.linear("y", "x", loss=rl.logistic()), df, on_violation="ignore")
    splitter = rl.rolling_window("t", "200 days", "150 days", gap="5 days")
    got = rl.over_time(rl.auc, sol, df, splitter, weights="w")
    want = [(v.agg(F.min("t"), F.max("t")).first(), float(rl.auc(sol, v, weights="w"))) for _, v in splitter.split(df)]
    assert len(got) == len(want) > 2
    for (at, value), ((lo, hi), v) in zip(got, want):
        assert at == lo + (hi - lo) / 2 and value == pytest.approx(v)
    assert rl.over_time(mean_error, sol, df, splitter)[0][1] > 0


def test_slices_and_errors(df):
    folds = Folds.of(rl.expanding_window("t", 4, "100 days", min_train="300 days"), df)
    folds.fit(rl.linear("v", "x"), None)
    (names, _, made), = folds.slices.values()
    assert names == ["x"] and [made[str(i)].n for i in range(4)] == [s["n_train"] for s in folds.sizes()]
    with pytest.raises(ValueError, match="train rows"):
        rl.cross_validate(rl.linear("v", "x"), df.filter("t > '2021-01-01'").unionByName(df.filter("t > '2021-01-01'").limit(1).withColumn("t", F.lit("2020-01-01").cast("timestamp"))), rl.purged_kfold("t", 2, timedelta(days=2000)), {})
    with pytest.raises(ValueError, match="missing, infinite"):
        rl.cross_validate(rl.linear("v", "x"), df.withColumn("v", F.when(F.col("t") < "2021-06-01", F.col("v"))), rl.expanding_window("t", 1, "900 days", min_train="300 days"), {"b": rl.brier_score})
    one = df.withColumn("y", F.when(F.col("t") > "2021-03-01", 1).otherwise(F.col("y")))
    with pytest.raises(ValueError, match="both classes"):
        rl.cross_validate(rl.linear("y", "x", loss=rl.logistic()), one, rl.expanding_window("t", 1, "300 days", min_train="500 days"), rl.auc)
    assert rl.cross_validate(rl.linear("v", "x"), df.limit(0), rl.expanding_window("t", 1, "30 days"), {}).folds == ()
