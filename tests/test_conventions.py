"""Conventions that penalised fits and reports rely on: the natural basis, normality of few residuals, empty bins."""

import math
from statistics import NormalDist

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

import riskloom as rl
from riskloom.functions import ranking
from riskloom.functions.metrics import DeLong, Metric
from riskloom.functions.special import shapiro_wilk
from riskloom.plans import assume, validate

KNOTS = [-1.0, 0.5, 2.0]


def cubic_splines(inner, x):
    """All cubic B-splines at x by their recursion over the padded knots."""
    t = np.array([inner[0]] * 3 + list(inner) + [inner[-1]] * 3)
    out = [(t[i] <= x) & ((x < t[i + 1]) | ((x == t[-1]) & (t[i + 1] == t[-1]) & (t[i] < t[i + 1]))) for i in range(len(t) - 1)]
    out = np.array(out, float)
    for d in range(1, 4):
        up = []
        for i in range(len(t) - 1 - d):
            left = (x - t[i]) / (t[i + d] - t[i]) * out[i] if t[i + d] > t[i] else 0.0
            right = (t[i + d + 1] - x) / (t[i + d + 1] - t[i + 1]) * out[i + 1] if t[i + d + 1] > t[i + 1] else 0.0
            up.append(left + right + 0 * x)
        out = np.array(up)
    return out.T


def natural_space(inner):
    """Orthonormal coefficients without bends at the ends (by second differences) and without the constant."""
    h = (inner[-1] - inner[0]) * 1e-3
    at = lambda a: cubic_splines(inner, np.array([a - h, a, a + h]))
    # A cubic's second derivative at an end, continued from two inner points, as it is linear on an interval.
    bend = lambda a: np.array([1, -2, 1]) @ at(a)
    ends = [2 * bend(inner[0] + h) - bend(inner[0] + 2 * h), 2 * bend(inner[-1] - h) - bend(inner[-1] - 2 * h)]
    fixed = np.vstack([np.array(ends) / h**2, np.ones(len(inner) + 2)])
    return np.linalg.svd(fixed)[2][3:].T


def sample(spark, n=400):
    rng = np.random.default_rng(5)
    x = rng.normal(size=n) * 2
    data = pd.DataFrame({"x": x, "y": np.sin(x) + 0.1 * rng.normal(size=n)})
    return data, spark.createDataFrame(data)


def test_ridge_on_natural_splines_is_that_of_the_orthonormal_basis(spark):
    data, df = sample(spark)
    sol = rl.solve(rl.linear("y", [rl.ns("x", 4, knots=KNOTS)], penalty=rl.l2(0.05)), df)
    inner = [data.x.min(), *KNOTS, data.x.max()]
    basis = cubic_splines(inner, data.x.to_numpy()) @ natural_space(inner)
    z = np.column_stack([np.ones(len(data)), basis])
    want = z @ np.linalg.solve(z.T @ z + 0.05 * len(z) * np.diag([0, 1, 1, 1, 1]), z.T @ data.y)
    got = np.array([r.prediction for r in rl.predict(sol, df).orderBy("x").collect()])
    assert np.allclose(got, want[np.argsort(data.x.to_numpy())], atol=1e-6)


def test_natural_splines_are_straight_outside_and_keep_missing_values(spark):
    _, df = sample(spark)
    term = rl.ns("x", 4, knots=KNOTS)
    state = term.fit(df)
    low, high = state[0], state[-1]
    at = [low - 3, low - 2, low - 1, low, low + 1e-4, high - 1e-4, high, high + 1, high + 2, high + 3]
    points = spark.createDataFrame([(i, float(v)) for i, v in enumerate(at)] + [(98, None), (99, float("nan"))], "i int, x double")
    packed = F.array(*[F.lit(v) for v in term.pack(state)])
    for columns in ([c for _, c in term.columns(state)], term.columns_of(packed, 4)):
        rows = points.select("i", *[c.alias(f"c{k}") for k, c in enumerate(columns)]).orderBy("i").collect()
        v = np.array([r[1:] for r in rows[:10]])
        assert np.allclose(v[1] - v[0], v[2] - v[1]) and np.allclose(v[3] - v[2], v[2] - v[1])
        assert np.allclose(v[8] - v[7], v[7] - v[6]) and np.allclose(v[9] - v[8], v[8] - v[7])
        assert np.allclose((v[4] - v[3]) / 1e-4, v[3] - v[2], atol=1e-3) and np.allclose((v[6] - v[5]) / 1e-4, v[7] - v[6], atol=1e-3)
        assert all(c is None for c in rows[10][1:]) and all(math.isnan(c) for c in rows[11][1:])


def test_shapiro_wilk_against_published_figures():
    men = [148, 154, 158, 160, 161, 162, 166, 170, 182, 195, 236]  # Shapiro and Wilk's example of weights
    assert shapiro_wilk(men) == (pytest.approx(0.78881, abs=1e-5), pytest.approx(0.006704, abs=1e-6))
    stops = [2, 10, 4, 22, 16, 10, 18, 26, 34, 17, 28, 14, 20, 24, 28, 26, 34, 34, 46, 26, 36, 60, 80, 20, 26, 54, 32, 40, 32, 40, 50, 42, 56, 76, 84, 36, 46, 68, 32, 48, 52, 56, 64, 66, 54, 70, 92, 93, 120, 85]
    assert shapiro_wilk(stops) == (pytest.approx(0.95144, abs=1e-5), pytest.approx(0.0391, abs=1e-4))
    assert shapiro_wilk([1.0, 2.0, 3.0]) == (pytest.approx(1.0), pytest.approx(1.0, abs=1e-6))
    assert shapiro_wilk([2.0] * 9) == (1.0, 1.0)
    with pytest.raises(ValueError):
        shapiro_wilk([1.0, 2.0])


def test_few_residuals_go_to_shapiro_wilk_and_many_to_anderson_darling(spark):
    rng = np.random.default_rng(2)
    for n, name in ((500, "Shapiro-Wilk"), (6000, "Anderson-Darling")):
        even = rng.permutation([NormalDist().inv_cdf((i + 0.5) / n) for i in range(n)])  # normal by construction
        df = spark.createDataFrame(pd.DataFrame({"x": rng.normal(size=n)}).assign(good=lambda d: d.x + even, bad=lambda d: d.x + rng.exponential(size=n)))
        for y, passed in (("good", True), ("bad", False)):
            sol = rl.solve(rl.linear(y, "x"), df)
            got, message, _ = assume.normal_residuals(sol, df, None)
            assert got == passed and message.startswith(name)


def test_empty_calibration_bins_have_rows(spark):
    f = spark.createDataFrame([(1.0, 0.2, 1.0), (0.0, 0.1, 9.0)], "y double, s double, w double")
    rows = ranking.calibration_bins(f, 5).orderBy("bin").collect()
    assert [(r.bin, r.n) for r in rows] == [(0, 9.0), (1, 0.0), (2, 0.0), (3, 0.0), (4, 1.0)]
    assert all(math.isnan(rows[i].predicted) and math.isnan(rows[i].observed) for i in (1, 2, 3)) and rows[4].observed == 1.0


def test_message_lists_values_outside_a_proportion(spark):
    df = spark.createDataFrame([(float(i % 9) - 1, float(i)) for i in range(90)], "y double, x double")
    with pytest.raises(rl.AssumptionError, match=r"values outside 0 to 1: -1, 2, 3, 4, 5$"):
        rl.solve(rl.linear("y", "x", loss=rl.logistic()), df)


def test_layouts(spark):
    _, df = sample(spark)
    spec = rl.linear("y", "x", penalty=rl.l1(1))
    assert "penalty" in spec._repr_html_() and "segments" in rl.segmented("s", spec)._repr_html_()
    assert "lambda" in rl.lambda_path(spec, df, 3)._repr_html_()
    assert "0.25" in Metric("auc", 0.25)._repr_html_() and "0.75" in DeLong(0.75, 0.5, 1.0, 0.3)._repr_html_()
    assert "failed" in assume.CheckResult("a", "SOFT", False, "no")._repr_html_()


def test_bootstrap_writes_the_design_once_unshuffled(spark, tmp_path):
    _, df = sample(spark)
    sol = rl.solve(rl.linear("y", "x"), df)
    seen = []
    real = validate.stored

    def watched(frame, name):
        seen.append(frame._jdf.queryExecution().executedPlan().toString())
        return real(frame, name)

    before = spark.conf.get("riskloom.local.dir", None)
    spark.conf.set("riskloom.local.dir", "file://" + str(tmp_path))
    try:
        with pytest.MonkeyPatch.context() as patch:
            patch.setattr(validate, "stored", watched)
            rl.bootstrap(sol, df.repartition(5).sortWithinPartitions("x").persist(), 50)
    finally:
        if before is None:
            spark.conf.unset("riskloom.local.dir")
        else:
            spark.conf.set("riskloom.local.dir", before)
    assert len(seen) == 1 and not list(tmp_path.iterdir())
    assert "Exchange" not in seen[0].split("InMemoryRelation")[0]


def test_draws_of_equal_rows_count_all_rows_and_spread_like_single_draws():
    rng = np.random.default_rng(4)
    x, y = np.repeat([[1.0], [2.0], [3.0]], [10, 60, 30], 0), np.zeros(100)
    few, _, _, times = validate.distinct(x, y, np.ones(100))
    assert sorted(zip(few[:, 0], times)) == [(1, 10), (2, 60), (3, 30)]
    left = np.full(4000, 200)
    c = validate.drawn(rng, left, 200, 100, times)
    own = c[:, few[:, 0] == 2][:, 0]
    assert (left + c.sum(1) == 200).all()
    assert own.mean() == pytest.approx(60, abs=0.5) and own.var() == pytest.approx(200 * 0.3 * 0.7, rel=0.1)
    assert validate.distinct(rng.normal(size=(100, 2)), y, y)[3] is None


def test_sums_of_replicates_by_levels(spark):
    values = np.arange(5000)
    parts = spark.createDataFrame([(int(r), int(i) // 64, np.array([float(i), r]).tobytes()) for i in values for r in range(2)], validate.PARTIAL)
    got = validate.summed(parts, 5000)
    assert [g.tolist() for g in got] == [[values.sum(), 0.0], [values.sum(), 5000.0]]
