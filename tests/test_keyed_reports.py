"""Reports of many keys in shared jobs against the report of each."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

import riskloom as rl
from tests.test_shared import jobs_of


@pytest.fixture(scope="module")
def made(spark):
    rng = np.random.default_rng(3)
    n = 1200
    data = pd.DataFrame({"x": rng.normal(size=n).round(1), "w": rng.integers(1, 4, n).astype(float), "id": np.arange(n), "t": pd.Timestamp("2021-01-01") + pd.to_timedelta(np.arange(n) // 3, "D")})
    data["seg"] = rng.choice(["a", "b", ""], n)
    data["y"] = (rng.random(n) < 1 / (1 + np.exp(-data.x))).astype(int)
    df = spark.createDataFrame(data).withColumn("seg", F.expr("nullif(seg, '')")).persist()
    return rl.solve(rl.linear("y", "x", loss=rl.logistic()), df, on_violation="ignore"), df


def flat(report):
    out = report.figures()
    if report.auc_ci:
        out |= {"auc_low": report.auc_ci[0], "auc_high": report.auc_ci[1]}
    return {k: v for k, v in out.items() if not np.isnan(v)}


@pytest.mark.parametrize("weights", [None, "w"])
def test_same_as_the_report_of_each_segment(made, weights):
    sol, df = made
    rows = rl.figures_by_segment(sol, df, "seg", weights=weights, reference=df, ties=("id",)).collect()
    for seg in ("a", None) if weights is None else (None,):
        want = flat(rl.performance(sol, df.filter(F.col("seg").eqNullSafe(F.lit(seg))), weights=weights, reference=df, ties=("id",)))
        got = {r.figure: r.value for r in rows if r.key == seg}
        assert set(got) == set(want)
        for k, v in want.items():
            assert got[k] == pytest.approx(v, rel=1e-6, abs=1e-9), (seg, k)


def test_windows_and_keys_of_one_class(made):
    sol, df = made
    splitter = rl.rolling_window("t", "100 days", "100 days")
    got = rl.figures_over_time(sol, df, splitter, ties=("id",)).groupBy("key").pivot("figure").agg(F.first("value")).orderBy("key").collect()
    frames = [v for _, v in splitter.split(df)]
    assert len(got) == len(frames) > 1 and [r.n_obs for r in got] == [v.count() for v in frames]
    assert got[1].slope == pytest.approx(rl.performance(sol, frames[1], ties=("id",)).slope)
    single = df.withColumn("seg", F.when(F.col("y") == 1, "events").otherwise(F.col("seg")))
    found = {r.figure for r in rl.figures_by_segment(sol, single, "seg").filter("key = 'events'").collect()}
    assert {"n_obs", "brier", "ece", "median"} <= found and not found & {"auc", "ks", "slope", "cohens_d"}
    with pytest.raises(ValueError):
        rl.figures_by_segment(sol, df.limit(0), "seg")


def test_many_keys_take_as_many_jobs(made):
    sol, df = made
    few, many = (jobs_of(df.sparkSession, lambda n=n: rl.figures_by_segment(sol, df.withColumn("k", F.col("id") % n), "k").count())[0] for n in (2, 60))
    assert many <= few + 20  # Newton steps of the slowest key
