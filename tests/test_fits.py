import warnings

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

import riskloom as rl
from riskloom.plans import validate
from riskloom.plans.factor import dependent
from riskloom.plans.validate import lambda_max


def frame(spark, n=800, seed=0, binary=False, p=3):
    rng = np.random.default_rng(seed)
    x = rng.normal(size=(n, p))
    beta = np.array([1.2, -0.8, 0.0, 0.3, 0.0, 0.0])[:p]
    eta = 0.4 + x @ beta
    y = (rng.uniform(size=n) < 1 / (1 + np.exp(-eta))).astype(float) if binary else eta + rng.normal(size=n)
    data = pd.DataFrame(x, columns=[f"x{i}" for i in range(p)]).assign(y=y, w=rng.integers(1, 4, n).astype(float), seg=np.where(np.arange(n) % 2, "a", "b"), t=pd.date_range("2020-01-01", periods=n, freq="D"))
    return data, spark.createDataFrame(data)


NAMES = ["x0", "x1", "x2"]


def design(data):
    return np.column_stack([np.ones(len(data)), data[NAMES]])


def values(sol):
    return np.array(list(sol.coefficients.values()))


def test_least_squares_and_weights(spark):
    data, df = frame(spark)
    x = design(data)
    for w in (None, "w"):
        root = np.sqrt(data.w.to_numpy() if w else np.ones(len(data)))[:, None]
        want, *_ = np.linalg.lstsq(x * root, data.y * root[:, 0], rcond=None)
        sol = rl.solve(rl.linear("y", NAMES), df, weights=w)
        assert np.abs(values(sol) - want).max() < 1e-10
        rss = (root[:, 0] ** 2 * (data.y - x @ want) ** 2).sum()
        se = np.sqrt(rss / (len(x) - 4) * np.diag(np.linalg.inv((x * root).T @ (x * root))))
        assert np.allclose(list(sol.std_errors.values()), se, rtol=1e-8)
    no = rl.solve(rl.linear("y", NAMES, intercept=False), df)
    assert np.allclose(values(no), np.linalg.lstsq(x[:, 1:], data.y, rcond=None)[0])


def test_ridge_shrinks_slopes_only(spark):
    data, df = frame(spark)
    x, lam = design(data), 0.3
    want = np.linalg.solve(x.T @ x + len(x) * lam * np.diag([0, 1, 1, 1]), x.T @ data.y)
    assert np.allclose(values(rl.solve(rl.linear("y", NAMES, penalty=rl.l2(lam)), df)), want, atol=1e-10)


def subgradient_holds(x, y, beta, l1, l2, scale, tol):
    grad = x.T @ (y - x @ beta) / len(y) / scale - l2 * beta * scale
    active = beta != 0
    assert np.abs(grad[active] - l1 * np.sign(beta[active])).max(initial=0) < tol
    assert (np.abs(grad[~active]) <= l1 + tol).all()


def test_lasso_and_elastic_net_are_optimal(spark):
    data, df = frame(spark, p=6)
    names = [f"x{i}" for i in range(6)]
    x, y = data[names].to_numpy(), data.y.to_numpy()
    xc, yc, scale = x - x.mean(0), y - y.mean(), x.std(0)
    for l1, l2 in ((0.1, 0.0), (0.05, 0.2)):
        sol = rl.solve(rl.linear("y", names, penalty=rl.l1(l1) + rl.l2(l2) if l2 else rl.l1(l1)), df)
        subgradient_holds(xc, yc, values(sol)[1:], l1, l2, scale, 1e-5)
    with pytest.raises(TypeError):
        rl.solve(rl.linear("y", names, penalty=rl.l1(1) + rl.l1(1)), df)


def test_path_begins_at_zero_and_follows_single_fits(spark):
    _, df = frame(spark)
    spec = rl.linear("y", NAMES, penalty=rl.l1(1))
    path = rl.lambda_path(spec, df, 8, 0.01)
    assert path.lambdas[0] == pytest.approx(lambda_max(spec, df)) and np.abs(path.coefficients[0, 1:]).max() < 1e-12
    one = rl.solve(rl.linear("y", NAMES, penalty=rl.l1(float(path.lambdas[4]))), df)
    assert np.allclose(path.coefficients[4], values(one), atol=1e-6)
    with pytest.raises(ValueError):
        rl.lambda_path(rl.linear("y", NAMES, penalty=rl.l2(1)), df)


def newton(x, y, w, ridge=0.0):
    beta = np.zeros(x.shape[1])
    pen = ridge * np.diag([0, *np.ones(x.shape[1] - 1)])
    for _ in range(40):
        p = 1 / (1 + np.exp(-x @ beta))
        h = (x * (w * p * (1 - p))[:, None]).T @ x + pen
        beta = beta + np.linalg.solve(h, x.T @ (w * (y - p)) - pen @ beta)
    return beta, np.sqrt(np.diag(np.linalg.inv(h)))


def test_logistic_and_its_ridge(spark):
    data, df = frame(spark, binary=True)
    x, y = design(data), data.y.to_numpy()
    for w in (None, "w"):
        weights = data.w.to_numpy() if w else np.ones(len(y))
        want, se = newton(x, y, weights)
        sol = rl.solve(rl.linear("y", NAMES, loss=rl.logistic()), df, weights=w)
        assert np.allclose(values(sol), want, atol=1e-8) and np.allclose(list(sol.std_errors.values()), se, rtol=1e-5)
    ridge = rl.solve(rl.linear("y", NAMES, loss=rl.logistic(), penalty=rl.l2(0.05)), df)
    assert np.allclose(values(ridge), newton(x, y, np.ones(len(y)), 0.05 * len(y))[0], atol=1e-7)


def test_logistic_lasso_selects(spark):
    _, df = frame(spark, 3000, binary=True, p=6)
    sol = rl.solve(rl.linear("y", [f"x{i}" for i in range(6)], loss=rl.logistic(), penalty=rl.l1(0.05)), df)
    b = values(sol)[1:]
    assert sol.converged and b[0] > 0.3 and b[1] < -0.2 and (b[[2, 4, 5]] == 0).all()


def test_rejects_what_cannot_be_fitted(spark):
    data, df = frame(spark, 60, binary=True)
    with pytest.raises(rl.AssumptionError, match="x0|twice"):
        rl.solve(rl.linear("y", ["x0", "twice"]), df.withColumn("twice", 2 * F.col("x0")))
    with pytest.raises(rl.AssumptionError, match="ridge"):
        rl.solve(rl.linear("z", "x0", loss=rl.logistic()), df.withColumn("z", (F.col("x0") > 0).cast("int")))
    with pytest.raises(rl.AssumptionError):
        rl.solve(rl.linear("z", "x0", loss=rl.logistic()), df.withColumn("z", F.lit(3.0)))
    with pytest.raises(KeyError):
        rl.solve(rl.linear("y", "absent"), df)
    with pytest.raises(ValueError):
        rl.solve(rl.linear("y", ["x0", rl.interact("x0", "x1")]), df)
    with pytest.raises(Exception, match="missing or infinite"):
        rl.solve(rl.linear("y", "n"), df.withColumn("n", F.when(F.col("x0") > 0, F.col("x0"))))
    with pytest.raises(TypeError):
        rl.solve(rl.linear("y", "x0"), data)


def test_segments(spark):
    data, df = frame(spark)
    sol = rl.solve(rl.segmented("seg", rl.linear("y", NAMES)), df)
    for s in "ab":
        own = rl.solve(rl.linear("y", NAMES), df.filter(F.col("seg") == s))
        assert np.allclose(values(sol[s]), values(own), atol=1e-9)
    logit = rl.solve(rl.segmented("seg", rl.linear("z", NAMES, loss=rl.logistic())), df.withColumn("z", (F.col("y") > 0.4).cast("int")))
    assert all(s.converged for s in logit.solutions.values())
    binned = rl.solve(rl.segmented("seg", rl.linear("z", rl.woe("x0", rl.manual([0.0])))), df.withColumn("z", (F.col("y") > 0.4).cast("int")))
    assert binned["a"].states[0] != binned["b"].states[0]
    unseen = df.limit(4).withColumn("seg", F.lit("zz"))
    with warnings.catch_warnings(record=True) as caught:
        warnings.simplefilter("always")
        assert all(np.isnan(r.prediction) for r in rl.predict(sol, unseen).collect())
    assert any("zz" in str(c.message) for c in caught)


def test_terms_predict_and_stream(spark, tmp_path):
    from riskloom.streaming.scoring import score_stream

    data, df = frame(spark)
    spec = rl.linear("y", [rl.poly("x0", 2), rl.bs("x1", 5), rl.ns("x2", 3), rl.step("w", [1.5, 2.5])])
    sol = rl.solve(spec, df)
    q = np.linalg.qr(np.column_stack([np.ones(len(data)), data.x0 - data.x0.mean(), (data.x0 - data.x0.mean()) ** 2]))[0][:, 1:]
    got = np.array(df.select(*[c for _, c in sol.columns[:2]]).collect())
    assert np.allclose(np.abs(got), np.abs(q), atol=1e-8)
    basis = np.array(df.select(*[c for _, c in sol.columns[2:7]]).collect())
    assert (basis >= -1e-12).all() and (basis.sum(1) <= 1 + 1e-9).all()
    out = df.select(*[c for _, c in rl.ns("x2", 3).columns(sol.states[2])])
    far = df.limit(3).select(F.lit(100.0).alias("x2")).union(df.limit(3).select(F.lit(101.0).alias("x2"))).union(df.limit(3).select(F.lit(102.0).alias("x2")))
    v = np.array(far.select(*[c for _, c in rl.ns("x2", 3).columns(sol.states[2])]).distinct().orderBy(F.col(out.columns[0])).collect()) if False else np.array(sorted(map(tuple, far.select(*[c.alias(f"c{i}") for i, (_, c) in enumerate(rl.ns("x2", 3).columns(sol.states[2]))]).distinct().collect())))
    assert np.allclose(v[2] - v[1], v[1] - v[0], rtol=1e-6)
    df.write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(df.schema).parquet(str(tmp_path / "in"))
    run = score_stream(sol, stream, str(tmp_path / "out"), str(tmp_path / "check"))
    run.processAllAvailable()
    run.stop()
    a = sorted(r[0] for r in spark.read.parquet(str(tmp_path / "out")).select("prediction").collect())
    b = sorted(r[0] for r in rl.predict(sol, df).select("prediction").collect())
    assert np.allclose(a, b)
    with pytest.raises(ValueError):
        score_stream(sol, df, "", "")


def test_dependent_columns():
    rng = np.random.default_rng(1)
    x = rng.normal(size=(50, 4))
    assert dependent(np.linalg.qr(np.column_stack([x, x[:, 1] - x[:, 2]]), mode="r"), 50) in ([4], [1], [2])
    assert dependent(np.linalg.qr(x, mode="r"), 50) == []


def test_bootstrap(spark, monkeypatch):
    _, df = frame(spark, 500)
    sol = rl.solve(rl.linear("y", ["x0", "x1"]), df)
    boot = rl.bootstrap(sol, df, 400, random_state=3)
    again = rl.bootstrap(sol, df, 400, random_state=3)
    assert np.array_equal(boot.replicates, again.replicates)
    for name, (lo, hi) in boot.coefficient_ci().items():
        assert (hi - lo) / (2 * 1.96 * sol.std_errors[name]) == pytest.approx(1, abs=0.15)
    res = rl.bootstrap(sol, df, 400, method="residual").coefficient_ci()
    assert (res["x0"][1] - res["x0"][0]) / (2 * 1.96 * sol.std_errors["x0"]) == pytest.approx(1, abs=0.15)
    monkeypatch.setattr(validate, "HELD_RESIDUALS", 100)  # drawn by a join on ranks
    res = rl.bootstrap(sol, df, 400, method="residual").coefficient_ci()
    assert (res["x0"][1] - res["x0"][0]) / (2 * 1.96 * sol.std_errors["x0"]) == pytest.approx(1, abs=0.15)
    block = rl.bootstrap(sol, df, 200, method="block", splitter=rl.rolling_window("t", "20 days", "20 days")).coefficient_ci()
    assert block["x0"][0] < sol.coefficients["x0"] < block["x0"][1] and "x0" in boot._repr_html_() and "x0" in sol._repr_html_()
    band = boot.prediction_ci(df.limit(5)).collect()
    assert all(r.eta_low < r.eta_high for r in band)
    lasso = rl.solve(rl.linear("y", NAMES, penalty=rl.l1(0.15)), df)
    freq = rl.bootstrap(lasso, df, 100).selection_frequency()
    assert freq["x0"] == 1.0 and freq["x2"] < 0.5
    with pytest.raises(NotImplementedError):
        boot.coefficient_ci(method="bca")


def test_logistic_bootstrap_by_strata(spark):
    _, df = frame(spark, 600, binary=True)
    sol = rl.solve(rl.linear("y", ["x0", "x1"], loss=rl.logistic()), df)
    boot = rl.bootstrap(sol, df, 150, stratify="seg")
    for name, (lo, hi) in boot.coefficient_ci().items():
        assert lo < sol.coefficients[name] < hi
        assert (hi - lo) / (2 * 1.96 * sol.std_errors[name]) == pytest.approx(1, abs=0.25)
    block = rl.bootstrap(sol, df, 60, method="block", splitter=rl.rolling_window("t", "20 days", "20 days"))
    for name, (lo, hi) in block.coefficient_ci().items():
        assert lo < sol.coefficients[name] < hi


def test_products_in_parts():
    rng = np.random.default_rng(2)
    u, z = rng.normal(size=(3, 70)), rng.normal(size=(70, 500))
    assert np.allclose(validate.products(u, z), np.stack([((z * v[:, None]).T @ z).ravel() for v in u]))


def test_logistic_path_starts_from_the_lambda_before(spark):
    _, df = frame(spark, 800, binary=True)
    spec = rl.linear("y", NAMES, loss=rl.logistic(), penalty=rl.l1(1))
    path = rl.lambda_path(spec, df, 5, 0.05)
    assert np.abs(path.coefficients[0, 1:]).max() < 1e-9
    for lam, got in zip(path.lambdas[1::3], path.coefficients[1::3]):
        one = rl.solve(rl.linear("y", NAMES, loss=rl.logistic(), penalty=rl.l1(float(lam))), df, on_violation="ignore")
        assert np.allclose(got, values(one), atol=1e-6)
