"""Squared-error segments are solved in tasks; logistic fits read equal rows once."""

import numpy as np
import pandas as pd
import pytest

from pyspark.sql import functions as F

import riskloom as rl
from riskloom.plans import validate
from riskloom.plans.factor import compacted, design, factors
from riskloom.plans.solve import AssumptionError


def test_segments_stay_in_their_table(spark):
    rng = np.random.default_rng(3)
    data = pd.DataFrame({"g": rng.integers(0, 150, 3000), "x": rng.normal(size=3000), "w": rng.integers(1, 4, 3000).astype(float)})
    data["y"] = data.g * data.x + rng.normal(size=3000)
    frame = spark.createDataFrame(data)
    sol = rl.solve(rl.segmented("g", rl.linear("y", "x")), frame, weights="w")
    scored = rl.predict(sol, frame).toPandas()
    assert len(scored) == 3000 and "solutions" not in vars(sol)
    rows = {(r.segment, r.term): r.estimate for r in sol.coefficients_df(spark).collect()}
    for g, own in data.groupby("g"):
        slope, const = np.polyfit(own.x, own.y, 1, w=np.sqrt(own.w))
        assert rows[str(g), "x"] == pytest.approx(slope) and rows[str(g), "(Intercept)"] == pytest.approx(const)
        assert np.allclose(np.sort(scored[scored.g == g].prediction), np.sort(const + slope * own.x))
        assert sol[g].n_obs == len(own) and sol[g].coefficients["x"] == pytest.approx(slope)
    with pytest.raises(AssumptionError, match="in segment 7"):
        rl.solve(rl.segmented("g", rl.linear("y", "x")), frame.selectExpr("g", "if(g = 7, 1, x) AS x", "y"))


def test_equal_rows_are_read_once(spark):
    frame = spark.range(4000).selectExpr("CAST(id % 7 AS DOUBLE) AS x", "CAST(id * id % 11 < 5 AS INT) AS y", "CAST(1 + id % 2 AS DOUBLE) AS w")
    rows = design(frame, [("x", F.col("x"))], "y", "w")
    kept = compacted(rows)
    assert kept.count() <= 28
    a, b = factors(rows, 1)[""], factors(kept, 1)[""]
    assert (a.n, a.sw, a.sy) == (b.n, b.sw, b.sy) == (4000, 6000.0, b.sy) and np.allclose(abs(a.r), abs(b.r))
    assert compacted(design(spark.range(500).selectExpr("CAST(id AS DOUBLE) AS x", "id % 2 AS y"), [("x", F.col("x"))], "y", None)).count() == 500


def test_draws_are_counted_as_before():
    left, again = np.array([40, 7, 0, 300]), np.array([40, 7, 0, 300])
    got = validate.drawn(np.random.default_rng(2), left, 900, 300)
    rng = np.random.default_rng(2)
    take = rng.binomial(again, 300 / 900)
    want = np.zeros((4, 300), int)
    np.add.at(want, (np.repeat(np.arange(4), take), rng.integers(0, 300, int(take.sum()))), 1)
    assert (got == want).all() and (left == again - take).all()
