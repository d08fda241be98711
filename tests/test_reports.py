import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

import riskloom as rl
from riskloom.functions import metrics as m
from riskloom.functions import ranking
from riskloom.plans import assume
from riskloom.plans.validate import LeakageError
from tests.test_fits import frame


def small(spark, y, s, w=None):
    return spark.createDataFrame(pd.DataFrame({"y": np.asarray(y, float), "s": np.asarray(s, float), "w": np.ones(len(y)) if w is None else np.asarray(w, float)}))


def brute_auc(y, s, w):
    p, n = y == 1, y == 0
    d = np.sign(s[p][:, None] - s[n][None, :]) / 2 + 0.5
    ww = w[p][:, None] * w[n][None, :]
    return (d * ww).sum() / ww.sum()


def test_auc_and_ks_with_ties_and_weights(spark):
    rng = np.random.default_rng(0)
    y, s, w = rng.integers(0, 2, 300).astype(float), rng.integers(0, 12, 300) / 12, rng.integers(1, 4, 300).astype(float)
    f = small(spark, y, s, w)
    assert m.auc_of(f).value == pytest.approx(brute_auc(y, s, w), abs=1e-12)
    copies = np.repeat(np.arange(300), w.astype(int))
    assert m.auc_of(small(spark, y[copies], s[copies])).value == pytest.approx(m.auc_of(f).value, abs=1e-12)
    gaps = {v: abs(w[(y == 1) & (s <= v)].sum() / w[y == 1].sum() - w[(y == 0) & (s <= v)].sum() / w[y == 0].sum()) for v in np.unique(s)}
    top = m.ks_of(f)
    assert top.value == pytest.approx(max(gaps.values())) and top.at == min(v for v, g in gaps.items() if g > max(gaps.values()) - 1e-12)
    assert m.auc_of(small(spark, [0, 1, 1], [0.5] * 3)).value == 0.5
    for bad in (([1, 1], [0.1, 0.2]), ([0, 1], [np.nan, 0.2])):
        with pytest.raises(ValueError):
            m.auc_of(small(spark, *bad))


def test_equal_mass_bins(spark):
    f = small(spark, [0, 1] * 7 + [1], np.arange(15) / 15)
    assert [r.n for r in ranking.calibration_bins(f, 10).orderBy("bin").collect()] == [2, 1, 2, 1, 2, 1, 2, 1, 2, 1]
    lift = ranking.lift_bins(f, 5).orderBy("decile").collect()
    assert lift[-1].captured_response == pytest.approx(1) and [r.mean_score for r in lift] == sorted((r.mean_score for r in lift), reverse=True)
    points = sorted(map(tuple, ranking.gains(f).collect()))
    assert points[0] == (0.0, 0.0) and points[-1] == pytest.approx((1.0, 1.0)) and len(points) == 16


def test_running_sums_over_many_buckets(spark):
    values = np.random.default_rng(2).permutation(5000).astype(float)
    out = ranking.running(spark.createDataFrame(pd.DataFrame({"v": values})), "v", {"n": F.lit(1)}).toPandas()
    assert (out.n == out.v + 1).all()
    down = ranking.running(spark.createDataFrame(pd.DataFrame({"v": values})), "v", {"n": F.lit(1)}, descending=True).toPandas()
    assert (down.n == 5000 - down.v).all()


def test_psi_edges_and_clamping(spark):
    old, new = (spark.createDataFrame(pd.DataFrame({"prediction": v})) for v in (np.arange(100.0), np.arange(100.0) + 30))
    assert rl.psi(old, old).value == pytest.approx(0, abs=1e-12)
    shift = rl.psi(old, new).value
    a = np.full(10, 0.1)
    b = np.array([1e-6, 1e-6, 1e-6, 0.1, 0.1, 0.1, 0.1, 0.1, 0.1, 0.4])
    assert shift == pytest.approx(((b - a) * np.log(b / a)).sum(), rel=0.02)
    flat = spark.createDataFrame(pd.DataFrame({"prediction": np.zeros(50)}))
    assert np.isfinite(rl.psi(flat, new).value)


def test_quantiles_equal_numpy(spark):
    from riskloom.functions.quantiles import quantiles

    v = np.round(np.random.default_rng(3).normal(size=997), 1)
    f = spark.createDataFrame(pd.DataFrame({"v": np.append(v, np.nan)}))
    shares = [0.0, 0.1, 0.333, 0.5, 0.95, 1.0]
    assert np.allclose(quantiles(f, "v", shares), np.quantile(v, shares), atol=1e-12) and quantiles(f.limit(0), "v", shares) == []


def test_delong_against_definition(spark):
    rng = np.random.default_rng(1)
    y = rng.integers(0, 2, 200).astype(float)
    a, b = np.round(rng.normal(size=200) + y, 1), np.round(rng.normal(size=200) + y / 2, 1)
    area, cov = m.delong_of(spark.createDataFrame(pd.DataFrame({"y": y, "a": a, "b": b})), ("a", "b"))
    v = []
    for s in (a, b):
        d = np.sign(s[y == 1][:, None] - s[y == 0][None, :]) / 2 + 0.5
        v.append((d.mean(1), d.mean(0)))
    want = np.cov([v[0][0], v[1][0]]) / (y == 1).sum() + np.cov([v[0][1], v[1][1]]) / (y == 0).sum()
    assert np.allclose(area, [v[0][0].mean(), v[1][0].mean()]) and np.allclose(cov, want)


def test_reports(spark):
    _, df = frame(spark, 900, binary=True)
    sol = rl.solve(rl.linear("y", ["x0", "x1", "x2"], loss=rl.logistic()), df)
    r = rl.performance(sol, df, reference=df)
    assert r.psi == pytest.approx(0, abs=1e-9) and r.psi_tag == "low" and r.slope == pytest.approx(1, abs=1e-5) and r.intercept == pytest.approx(0, abs=1e-5)
    assert r.auc_ci[0] < r.auc < r.auc_ci[1] and "auc" in str(r) and "<table>" in r._repr_html_() and r.lift.count() == 10
    by = {x.seg: x for x in rl.performance_by_segment(sol, df, "seg").collect()}
    own = rl.performance(sol, df.filter("seg = 'a'"))
    assert by["a"].auc == pytest.approx(own.auc) and by["a"].ks == pytest.approx(own.ks) and by["a"].n_obs == 450
    with pytest.raises(ValueError):
        rl.performance_by_segment(sol, df.withColumn("seg", F.col("y").cast("string")), "seg")
    over = rl.performance_over_time(sol, df, rl.expanding_window("t", 3, "200 days"), reference=df).orderBy("window").collect()
    assert len(over) == 3 and all(x.psi < 0.5 for x in over)
    other = rl.solve(rl.linear("y", ["x2"], loss=rl.logistic()), df)
    c = rl.compare({"full": sol, "weak": other}, df)
    assert c.p_values[0, 1] < 1e-6 and np.isnan(c.p_values[0, 0]) and rl.delong_test(sol, other, df).p_value == pytest.approx(c.p_values[0, 1])


def test_diagnostics_against_dense_hat_matrix(spark):
    data, df = frame(spark, 80)
    sol = rl.solve(rl.linear("y", ["x0", "x1"]), df)
    x = np.column_stack([np.ones(80), data[["x0", "x1"]]])
    h = x @ np.linalg.inv(x.T @ x) @ x.T
    out = rl.diagnostics(sol, df).toPandas().sort_values("t")
    e = data.y - h @ data.y
    s2 = (e**2).sum() / 77
    assert np.allclose(out.leverage, np.diag(h)) and np.allclose(out.residual, e) and np.allclose(out.cooks_distance, e**2 * np.diag(h) / (3 * s2 * (1 - np.diag(h)) ** 2))
    some = rl.influence(sol, df).toPandas().sort_values("t")
    gone = np.linalg.lstsq(np.delete(x, 5, 0), np.delete(data.y.to_numpy(), 5), rcond=None)[0]
    left = np.delete(data.y.to_numpy(), 5) - np.delete(x, 5, 0) @ gone
    want = (np.array(list(sol.coefficients.values())) - gone) / np.sqrt((left**2).sum() / 76 * np.diag(np.linalg.inv(x.T @ x)))
    assert np.allclose(some.dfbetas.iloc[5], want)
    assert np.allclose([r.h for r in rl.hat_matrix(sol, df, "t").orderBy("i", "j").collect()], h.ravel())
    with pytest.raises(ValueError):
        rl.hat_matrix(sol, df, "t", most=10)
    assert rl.coefficients(sol, spark).filter("p_value < 1e-6 and term = 'x0'").count() == 1


def test_checks(spark):
    _, df = frame(spark, 400, seed=1)
    sol = rl.solve(rl.linear("y", ["x0", "x1"]), df)
    report = rl.check_assumptions(sol, df)
    assert report.passed and {r.name for r in report.results} == {"FullRankDesign", "ResidualNormality", "Homoscedasticity", "LowVIF"} and all(r.passed for r in report.results)
    skewed = df.withColumn("y", F.exp(F.col("y") * 2))
    bad = {r.name: r.passed for r in rl.check_assumptions(rl.solve(rl.linear("y", ["x0", "x1"]), skewed), skewed).results}
    assert not bad["ResidualNormality"]
    uneven = df.withColumn("y", F.col("x1") + F.randn(7) * F.exp(F.col("x0")))
    lm, p = assume.breusch_pagan(rl.solve(rl.linear("y", ["x0", "x1"]), uneven), uneven)
    assert p < 0.01
    assert assume.durbin_watson(sol, df, ("t",)) == pytest.approx(2, abs=0.3)
    with pytest.warns(UserWarning, match="Scales"):
        rl.solve(rl.linear("y", ["x0", "big"], penalty=rl.l2(0.1)), df.withColumn("big", 1000 * F.col("x1")))
    passed, _, share = assume.supported(sol, df.withColumn("x0", F.col("x0") + 3), df)
    assert not passed and share > 0.05


def test_binning_strategies(spark):
    rng = np.random.default_rng(4)
    x = rng.normal(50, 15, 3000)
    y = (rng.uniform(size=3000) < 1 / (1 + np.exp(-(x - 50) / 15))).astype(int)
    df = spark.createDataFrame(pd.DataFrame({"x": np.where(np.arange(3000) % 50 == 0, np.nan, x), "y": y, "c": np.array(list("aaaabbbcd"))[np.arange(3000) % 9]}))
    mono = rl.monotonic().fit(df, "x", "y")
    rates = [r for i, r in enumerate(mono.event_rate) if i != mono.missing_bin]
    assert rates == sorted(rates) and mono.n_bins > 4 and mono.labels[-1] == "(Missing)" and min(a + b for a, b in zip(mono.events[:-1], mono.others[:-1])) >= 150
    tree = rl.tree_bins(max_leaves=4).fit(df, "x", "y")
    assert tree.n_bins == 5 and tree.iv > 0.3
    cat = rl.categorical(0.12).fit(df, "c", "y")
    assert cat.labels == ("a", "b", "RARE") and dict(cat.levels) == {"a": 0, "b": 1} and cat.rare_bin == 2
    spec = rl.fit_binnings(rl.linear("y", [rl.woe("x", rl.monotonic()), rl.binned("c", rl.categorical())], loss=rl.logistic()), df)
    sol = rl.solve(spec, df, on_violation="ignore")
    assert sol.states[0] == mono and sol.coefficients["x"] > 0.5 and rl.binning_table(sol, spark).count() == mono.n_bins + 4
    assert rl.predict(sol, df.limit(1).withColumn("c", F.lit("new"))).filter("prediction between 0 and 1").count() == 1
    edge = rl.manual([1, 2]).fit(spark.createDataFrame([(1.0, 1), (2.0, 0), (2.5, 1)], "x double, y int"), "x", "y")
    assert edge.events == (1, 0, 1) and edge.labels == ("(-inf, 1]", "(1, 2]", "(2, inf)")


def test_tree_of_many_values_splits_as_one_of_few(spark):
    from riskloom.operators.binning import Tree

    rng = np.random.default_rng(8)
    x = np.round(np.exp(rng.normal(0, 2, 4000)), 2)
    y = (rng.uniform(size=4000) < np.where((x > 0.7) & (x < 3.1) | (x > 40), 0.7, 0.2)).astype(int)
    df = spark.createDataFrame(pd.DataFrame({"x": x, "y": y, "w": rng.integers(1, 4, 4000)}))
    for weights in (None, "w"):
        near = Tree(6, 0.05).fit(df, "x", "y", weights)
        assert Tree(6, 0.05, fine_values=40).fit(df, "x", "y", weights) == near and near.n_bins == 6


def test_splits_and_validation(spark):
    _, df = frame(spark, 700, binary=True)
    for splitter in (rl.expanding_window("t", 3, "100 days", "10 days"), rl.rolling_window("t", "200 days", "100 days", gap="5 days")):
        for train, valid in splitter.split(df):
            a, b = train.agg(F.max("t")).first()[0], valid.agg(F.min("t")).first()[0]
            assert a + splitter.gap < b
    parts = [p.count() for p in rl.time_split(df, "t", (0.5, 0.25, 0.25))]
    assert parts == [350, 175, 175]
    folds = list(rl.purged_kfold("t", 5, "7 days").split(df))
    assert [v.count() for _, v in folds] == [140] * 5 and [t.count() for t, _ in folds] == [553, 546, 546, 546, 553]
    spec = lambda lam: rl.linear("y", ["x0", "x1"], loss=rl.logistic(), penalty=rl.l2(lam))
    cv = rl.cross_validate(spec(0.01), df, rl.expanding_window("t", 3, "100 days"), {"auc": rl.auc, "brier": rl.brier_score})
    assert {r.name for r in cv.assumptions} == {"CoefficientStability", "PredictiveStability(auc)", "PredictiveStability(brier)", "NoTemporalLeakage"} and all(r.passed for r in cv.assumptions if r.severity == "HARD")
    assert "<table>" in cv._repr_html_()
    assert len(cv.folds) == 3 and min(cv.values("auc")) > 0.6 and cv.summary(spark).count() == 6
    made = rl.tune(spec, {"lam": [0.001, 5.0]}, df, rl.expanding_window("t", 2, "150 days"), rl.log_loss, direction="min")
    assert made.params == {"lam": 0.001} and made.curve_df(spark).filter("chosen").count() == 1
    nested = rl.nested_cv(spec, {"lam": [0.001, 5.0]}, df, rl.expanding_window("t", 1, "200 days"), rl.expanding_window("t", 1, "50 days"), rl.auc)
    assert len(nested) == 1 and nested[0].value > 0.6
    from datetime import timedelta

    with pytest.raises(LeakageError):
        rl.cross_validate(rl.linear("y", "x0", loss=rl.logistic(timedelta(days=90))), df, rl.expanding_window("t", 2, "100 days"), rl.auc)
    assert len(rl.over_time(rl.auc, made.solution, df, rl.expanding_window("t", 2, "150 days"))) == 2


def test_psi_weights_and_least_share(spark):
    old = spark.createDataFrame([(0.1, 1.0), (0.1, 1.0), (0.6, 2.0)], "prediction double, w double")
    new = spark.createDataFrame([(0.1, 3.0), (0.6, 1.0)], "prediction double, w double")
    weighted = rl.psi(old, new, bins=[0, 0.5, 1], weights_reference="w", weights_current="w")
    assert abs(weighted.value - (0.25 * np.log(0.75 / 0.5) + (-0.25) * np.log(0.25 / 0.5))) < 1e-12
    only = new.filter("prediction < 0.5")
    for eps in (1e-6, 1e-3):
        assert abs(rl.psi(old, only, bins=[0, 0.5, 1], eps=eps).value - ((1 - 2 / 3) * np.log(1.5) + (eps - 1 / 3) * np.log(eps * 3))) < 1e-9
    with pytest.raises(ValueError):
        rl.psi(old, new.withColumn("w", -F.col("w")), bins=[0, 0.5, 1], weights_current="w")


def test_segments_with_reference_and_aggregate(spark):
    rng = np.random.default_rng(2)
    pdf = pd.DataFrame({"x": rng.normal(size=400), "seg": ["a", "b"] * 200})
    pdf["y"] = (rng.random(400) < 1 / (1 + np.exp(-pdf.x))).astype(float)
    df = spark.createDataFrame(pdf)
    sol = rl.solve(rl.linear("y", "x", loss=rl.logistic()), df, on_violation="ignore")
    rows = {r.seg: r for r in rl.performance_by_segment(sol, df, "seg", reference=df, aggregate=True).collect()}
    assert set(rows) == {None, "a", "b"} and rows[None].n_obs == 400 and abs(rows[None].psi) < 1e-12
    assert abs(rows[None].auc - rl.auc(sol, df).value) < 1e-12 and rows["a"].psi > 0
    reports = rl.report_by_segment(sol, df, "seg")
    assert abs(reports["b"].auc - rows["b"].auc) < 1e-12 and reports["a"].n_obs == 200


def test_checks_of_order_and_support(spark):
    pdf = pd.DataFrame({"t": range(200), "x": np.linspace(0, 1, 200), "z": np.cos(np.arange(200.0))})
    pdf["y"] = pdf.x + np.sin(np.arange(200) / 20)
    df = spark.createDataFrame(pdf)
    sol = rl.solve(rl.linear("y", ["x", "z"]), df, on_violation="ignore")
    found = {r.name: r.passed for r in rl.check_assumptions(sol, df, order_by=("t",), train=df.filter("x < 0.5")).results}
    assert not found["Independence"] and not found["SupportContainsPredictData"]
    assert {r.name: r.passed for r in rl.check_assumptions(sol, df, train=df).results}["SupportContainsPredictData"]


def test_readers(spark, tmp_path):
    from riskloom.sources import tables

    (tmp_path / "a.csv").write_text("n,name\n1,x\n2,y\n")
    assert sorted(map(tuple, tables.read_csv(spark, str(tmp_path / "a.csv")).collect())) == [(1, "x"), (2, "y")]
    (tmp_path / "b.txt").write_text("A11  6\nA12 48\nA13 7\n")
    rows = tables.read_blank_separated(spark, str(tmp_path / "b.txt"), ["status", "months"], {"status": {"A11": "low", "A12": "high"}}).collect()
    assert [tuple(r) for r in rows] == [("low", "6"), ("high", "48"), ("A13", "7")]
    days = tables.with_random_dates(spark.range(500), "day", "2020-01-01", "2020-01-10").selectExpr("min(day) AS a", "max(day) AS b", "count(*) AS n").first()
    assert (str(days.a), str(days.b), days.n) == ("2020-01-01", "2020-01-10", 500)


def test_aggregate_row_beside_null_segments(spark):
    rows = [(["a", "b", None][i % 3], i / 90, int(i % 7 < 3)) for i in range(90)]
    df = spark.createDataFrame(rows, "seg string, x double, y int")
    sol = rl.solve(rl.linear("y", "x", loss=rl.logistic()), df, on_violation="ignore")
    out = rl.performance_by_segment(sol, df, "seg", reference=df, aggregate=True).toPandas()
    total, none = out[out.is_total], out[~out.is_total & out.seg.isna()]
    assert total.n_obs.tolist() == [90] and none.n_obs.tolist() == [30] and len(out) == 4
    assert total.auc.iloc[0] == pytest.approx(rl.performance(sol, df).auc) and abs(total.psi.iloc[0]) < 1e-12
    own = rl.performance_by_segment(sol, df, "seg", reference=df).toPandas()
    assert "is_total" not in own and own.n_obs.tolist() == [30, 30, 30]
    assert own[own.seg.isna()].auc.iloc[0] == pytest.approx(none.auc.iloc[0])
