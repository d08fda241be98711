"""Bins and position splits put only rows in order whose value an edge cuts."""

import numpy as np
import pandas as pd
from pyspark.sql import functions as F

import riskloom as rl
from riskloom.functions import ranking


def counted(monkeypatch):
    sizes, stored = [], ranking.stored

    def store(df, name):
        out = stored(df, name)
        sizes.append(out.count())
        return out

    monkeypatch.setattr(ranking, "stored", store)
    return sizes


def test_bins_order_rows_of_cut_scores_only(spark, monkeypatch):
    rng = np.random.default_rng(5)
    data = pd.DataFrame({"s": rng.integers(0, 40, 2000) / 40.0, "y": rng.integers(0, 2, 2000).astype(float), "w": rng.integers(1, 4, 2000).astype(float), "k": rng.permutation(2000)})
    frame = spark.createDataFrame(data)
    for down in (False, True):
        sizes = counted(monkeypatch)
        got = {r.bin: (r.w, r.ws, r.wy) for r in ranking.bin_sums(frame, 7, ("k",), down).collect()}
        assert max(sizes) < 700
        rows = data.sort_values(["s", "k"], ascending=[not down, True])
        rows["bin"] = np.minimum(np.floor((rows.w.cumsum() - rows.w) * 7 / rows.w.sum() + 1e-12), 6).astype(int)
        want = {b: (g.w.sum(), (g.w * g.s).sum(), (g.w * g.y).sum()) for b, g in rows.groupby("bin")}
        assert got.keys() == want.keys() and all(np.allclose(got[b], want[b]) for b in want)


def test_position_splits_order_rows_of_cut_times_only(spark, monkeypatch):
    rng = np.random.default_rng(6)
    data = pd.DataFrame({"t": pd.Timestamp("2020-01-01") + pd.to_timedelta(rng.integers(0, 60, 1500), "D"), "k": rng.permutation(1500)})
    frame = spark.createDataFrame(data)
    order = data.sort_values(["t", "k"]).k.tolist()
    sizes = counted(monkeypatch)
    cuts = [int(1500 * i / 7) for i in range(8)]
    folds = [sorted(r.k for r in valid.collect()) for _, valid in rl.purged_kfold("t", 7, "2 days", ("k",)).split(frame)]
    assert folds == [sorted(order[a:b]) for a, b in zip(cuts, cuts[1:])]
    parts = rl.time_split(frame.withColumn("t", F.when(F.col("k") < 1000, F.col("t"))), "t", (0.2, 0.8), ("k",))
    assert [p.count() for p in parts] == [300, 1200] and sorted(r.k for r in parts[0].collect()) == list(range(1000, 1300))
    assert max(sizes) < 700


def test_ranges_grow_with_rows(spark, monkeypatch):
    monkeypatch.setattr(ranking, "RANGE_ROWS", 100)
    frame = spark.range(2000).select(F.lit(1.0).alias("s"), (F.col("id") % 2).cast("double").alias("y"), F.lit(1.0).alias("w"), "id")
    out = ranking.running(frame, "s", {"n": F.lit(1)}, (), ("id",), rows=2000)
    assert out._ranges.agg(F.max("_part")).first()[0] > 10
