"""Terms that learn in shared passes, and segments that share all jobs."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

import riskloom as rl
from riskloom.operators.binning import Tree
from riskloom.operators.shared import learn
from riskloom.operators.terms import Term


def frame(spark, n=3000, seed=5, segments="abc"):
    rng = np.random.default_rng(seed)
    data = pd.DataFrame({"x": rng.normal(size=n).round(2), "z": rng.uniform(1, 9, n), "c": rng.choice(["p", "q", "r", "rare"], n, p=[0.5, 0.3, 0.18, 0.02]), "w": rng.integers(1, 4, n).astype(float), "seg": rng.choice(list(segments), n)})
    data["x"] += data.seg.map({s: i / 2 for i, s in enumerate(segments)})
    data["y"] = (rng.random(n) < 1 / (1 + np.exp(-data.x + (data.c == "q")))).astype(int)
    data["t"] = data.x - data.z / 3 + rng.normal(size=n) / 4
    df = spark.createDataFrame(data)
    return data, df.withColumn("m", F.when(F.col("z") < 8, F.col("z")))  # m has missing values


def jobs_of(spark, action):
    """How many Spark jobs an action runs."""
    spark.sparkContext.setJobGroup("counted", "")
    before = set(spark.sparkContext.statusTracker().getJobIdsForGroup("counted"))
    out = action()
    found = set(spark.sparkContext.statusTracker().getJobIdsForGroup("counted")) - before
    spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    return len(found), out


STRATEGIES = [rl.manual([0.0, 1.0]), rl.monotonic(), rl.tree_bins(4), rl.monotonic(0.1, 5)]


@pytest.mark.parametrize("weights", [None, "w"])
def test_same_bins_as_one_by_one(spark, weights):
    _, df = frame(spark)
    terms = [rl.woe(c, s) for c in ("x", "m") for s in STRATEGIES] + [rl.woe("c", rl.categorical(0.05)), rl.binned("c", rl.categorical(0.2))]
    shared = learn(terms, df, "y", weights)[""]
    for t, found in zip(terms, shared):
        assert found == t.bins.fit(df, t.col, "y", weights), t
    spec = rl.fit_binnings(rl.linear("y", terms[:4]), df, weights)
    assert [t.fitted for t in spec.features] == list(shared[:4])
    assert rl.fit_binnings(spec, df) == spec


def test_same_states_by_segment_as_apart(spark):
    _, df = frame(spark)
    terms = [rl.poly("x", 3), rl.bs("z", 6), rl.ns("x", 3), rl.bs("z", 5, knots=[2, 4]), rl.woe("m", rl.monotonic()), rl.woe("x", rl.tree_bins(3)), rl.woe("c", rl.categorical(0.05)), rl.interact("x", rl.poly("z", 2)), rl.linear("y", "x").features[0]]
    by = learn(terms, df, "y", "w", F.col("seg"))
    assert sorted(by) == ["a", "b", "c"]
    for s, states in by.items():
        own = df.filter(F.col("seg") == s)
        for t, found in zip(terms, states):
            want = t.fit(own, "y", "w")
            if isinstance(t, type(terms[4])):
                assert found == want
            else:
                flat = lambda v: np.concatenate([np.ravel(np.asarray(i, float)) if not isinstance(i, tuple) else flat(i) for i in v if i is not None]) if v is not None else np.zeros(0)
                assert np.allclose(flat(found), flat(want), rtol=1e-9, atol=1e-12)


def test_trees_in_spark_are_those_of_the_driver(spark):
    _, df = frame(spark)
    for by in (None, F.col("seg")):
        near, far = (learn([rl.woe("x", Tree(5, 0.05, n)), rl.woe("m", Tree(3, 0.1, n))], df, "y", "w", by) for n in (10**6, 10))
        assert near == far and near[min(near)][0].n_bins == 5


def test_jobs_depend_neither_on_columns_nor_on_segments(spark):
    _, df = frame(spark, 600)
    df = df.withColumn("many", (F.monotonically_increasing_id() % 60).cast("string")).persist()
    df.count()
    few = [rl.woe("x", rl.monotonic()), rl.woe("z", rl.tree_bins(2)), rl.poly("x", 2), rl.bs("z", 4), rl.woe("c", rl.categorical())]
    more = few + [rl.woe("t", rl.monotonic()), rl.woe("m", rl.monotonic()), rl.woe("x", rl.tree_bins(2)), rl.poly("t", 2), rl.bs("t", 4), rl.woe("seg", rl.categorical())]
    counts = [jobs_of(spark, lambda t=t, by=by: learn(t, df, "y", None, by))[0] for t, by in ((few, None), (more, None), (few, F.lit("one")), (few, F.col("seg")))]
    assert counts[0] == counts[1] and counts[3] <= counts[2] + 1  # edges that differ are joined
    spec = lambda col: rl.segmented(col, rl.linear("t", ["x", rl.poly("z", 2)]))
    one, many = (jobs_of(spark, lambda c=c: rl.predict(rl.solve(spec(c), df), df).count())[0] for c in ("seg", "many"))
    assert one == many


def test_segments_with_learned_terms(spark):
    data, df = frame(spark)
    terms = ["x", rl.poly("z", 2), rl.woe("m", rl.monotonic()), rl.bs("x", 4), rl.woe("c", rl.categorical(0.05)), rl.interact("w", rl.ns("z", 2))]  # bs(x) spans x, so the product takes w
    for chosen in (terms[1:3], terms[3:6]):
        base = rl.linear("y", chosen)
        sol = rl.solve(rl.segmented("seg", base), df)
        scored = rl.predict(sol, df).toPandas()
        assert len(scored) == len(data)
        for s in "abc":
            own = rl.solve(base, df.filter(F.col("seg") == s), on_violation="ignore")
            assert list(own.coefficients) == list(sol[s].coefficients)
            assert np.allclose(list(own.coefficients.values()), list(sol[s].coefficients.values()), rtol=1e-7, atol=1e-9)
            want = rl.predict(own, df.filter(F.col("seg") == s)).toPandas()
            key = ["x", "z", "w", "y", "c"]
            assert np.allclose(scored[scored.seg == s].sort_values(key).prediction, want.sort_values(key).prediction, atol=1e-8, equal_nan=True)


def test_segments_whose_bins_differ_in_number(spark):
    rows = [("a", float(i % 40), int(i % 40 > 20)) for i in range(400)] + [("b", float(i % 2), i % 3 % 2) for i in range(300)]
    df = spark.createDataFrame(rows, "seg string, x double, y int")
    sol = rl.solve(rl.segmented("seg", rl.linear("y", rl.binned("x", rl.tree_bins(4, 0.1)))), df)
    assert len(sol["a"].coefficients) != len(sol["b"].coefficients) or sol["a"].states != sol["b"].states
    scored = rl.predict(sol, df).toPandas()
    for s in "ab":
        own = rl.predict(sol[s], df.filter(F.col("seg") == s)).toPandas()
        assert np.allclose(np.sort(scored[scored.seg == s].prediction), np.sort(own.prediction))


def test_ten_thousand_segments(spark):
    n = 10_000
    df = spark.range(6 * n).selectExpr(f"id % {n} AS seg", "CAST(floor(id / %d) AS double) AS x" % n).withColumn("t", 3 + F.col("seg") * F.col("x") + F.col("seg"))
    sol = rl.solve(rl.segmented("seg", rl.linear("t", "x")), df)
    assert len(sol.solutions) == n and np.allclose(list(sol[77].coefficients.values()), [80, 77])
    new = df.unionByName(spark.createDataFrame([(n + 5, 1.0, 0.0), (None, 1.0, 0.0)], df.schema))
    with pytest.warns(UserWarning, match="10005"):
        scored = rl.predict(sol, new)
    plan = scored._jdf.queryExecution().optimizedPlan().toString()
    assert len(plan) < 5000 and "CASE" in plan
    bad = scored.filter("isnan(prediction)").count()
    assert bad == 2 and scored.filter("not isnan(prediction) and abs(prediction - t) > 1e-6").count() == 0


def test_own_terms_are_fitted_segment_by_segment(spark):
    class Share(Term):
        col = "x"

        def __eq__(self, other):
            return isinstance(other, Share)

        __hash__ = object.__hash__

        def fit(self, df, target=None, weights=None):
            return df.agg(F.max("x")).first()[0]

        def columns(self, state):
            return [("share", F.col("x") / F.lit(state))]

    _, df = frame(spark, 600)
    sol = rl.solve(rl.segmented("seg", rl.linear("t", [Share(), "z"])), df)
    scored = rl.predict(sol, df)
    assert scored.filter("isnan(prediction)").count() == 0 and sol["a"].states[0] != sol["b"].states[0]


def test_errors(spark):
    _, df = frame(spark, 300)
    with pytest.raises(ValueError, match="constant"):
        rl.solve(rl.segmented("seg", rl.linear("t", rl.poly("k", 2))), df.withColumn("k", F.when(F.col("seg") == "a", 1.0).otherwise(F.col("x"))))
    with pytest.raises(ValueError, match="missing or infinite"):
        learn([rl.bs("m", 5)], df, "t")
    with pytest.raises(rl.AssumptionError if hasattr(rl, "AssumptionError") else ValueError, match="segment a"):
        rl.solve(rl.segmented("seg", rl.linear("t", ["x", "k"])), df.withColumn("k", F.when(F.col("seg") == "a", F.col("x") * 2).otherwise(F.col("z"))))
    with pytest.raises(ValueError):
        rl.solve(rl.segmented("seg", rl.linear("t", "x")), df.limit(0))
