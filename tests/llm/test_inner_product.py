import random

import numpy as np
from pyspark.sql import functions as F

from riskloom.llm import inner_product as ip
from riskloom.llm.queries import QUERIES, SQL
from tests.llm.oracle import assert_same


def test_query_against_sql(spark):
    assert_same(spark, QUERIES["op1_inner_product"], SQL["op1_inner_product"], "/root/testdata/sf0.01")


def brute(rows, k, every):
    out = []
    for i, v in rows:
        if i % every == 0:
            scores = sorted((-sum(a * b for a, b in zip(v, w)), j) for j, w in rows if j != i and len(w) == len(v))
            out += [(i, r + 1, j, -s) for r, (s, j) in enumerate(scores[:k])]
    return sorted(out)


def test_blocks_ties_and_odd_vectors(spark):
    random.seed(4)
    rows = [(i, [random.randint(-3, 3) for _ in range(6)]) for i in range(400)] + [(1000 + i, [9, 9, 9, 9, 9, 9]) for i in range(40)] + [(5000, [1]), (5010, [2]), (6000, [])]
    odd = [(7000, None), (7010, [1.0, None]), (7020, [float("nan")] * 6), (7030, [float("inf")] * 6), (None, [1.0] * 6), (0, rows[0][1])]
    frame = spark.createDataFrame([(i, v and [x if x is None else float(x) for x in v], "x") for i, v in [*rows[:-1], (6000, []), *odd]], "vec_id bigint, embedding array<float>, vec string")
    v = ip.scaled(frame, "vec_id", "embedding", 1)
    got = ip.top_k(v.filter("id % 10 = 0"), v, 5, part_rows=50).collect()
    assert sorted(map(tuple, got)) == brute(rows, 5, 10)
    assert ip.top_k(v.limit(0), v.limit(0), 5).count() == 0


def test_pruning_keeps_results():
    rng = np.random.default_rng(0)
    c = np.floor(rng.normal(size=(5000, 32)) * rng.gamma(1, 60, (5000, 1))).astype(np.int64)
    turn = np.linalg.svd(c.astype(float), full_matrices=True)[2].T
    ids = np.arange(5000)
    who, found, score = ip.search(ids[:50], c[:50], ids, c, turn, 5, True)
    exact = c[:50] @ c.T
    exact[np.arange(50), np.arange(50)] = -(2**62)
    for q in range(50):
        best = sorted((-s, j) for j, s in enumerate(exact[q].tolist()))[:5]
        assert [(-s, j) for j, s in zip(found[who == q].tolist(), score[who == q].tolist())] == best


def test_bands_that_cannot_reach_are_not_visited(spark, monkeypatch):
    """Lengths that fall from band to band: a query goes on to few bands, and every candidate is in one band."""
    rng = np.random.default_rng(1)
    x = rng.normal(size=(3000, 8)) * np.geomspace(1000, 1, 3000)[:, None]
    rows = [(i, [float(v) for v in np.floor(r)]) for i, r in enumerate(x)]
    frame = spark.createDataFrame(rows, "vec_id bigint, embedding array<double>")
    v, asked = ip.scaled(frame, "vec_id", "embedding", 1), []
    plain = ip.meet
    monkeypatch.setattr(ip, "meet", lambda a, *rest: asked.append(a.count()) or plain(a, *rest))
    got = ip.top_k(v.filter("id % 100 = 0"), v, 5, part_rows=100).collect()
    assert sorted(map(tuple, got)) == brute([(i, [int(a) for a in r]) for i, r in rows], 5, 100)
    assert asked[0] == 30 and asked[1] < 0.4 * 30 * 29


def test_repeated_rows_are_candidates_each(spark):
    frame = spark.createDataFrame([(0, [1.0, 2.0]), (1, [3.0, 1.0]), (1, [3.0, 1.0]), (3, [0.0, 1.0])], "vec_id bigint, embedding array<double>")
    v = ip.scaled(frame, "vec_id", "embedding", 1)
    assert sorted(map(tuple, ip.top_k(v.filter("id = 0"), v, 5).collect())) == [(0, 1, 1, 5), (0, 2, 1, 5), (0, 3, 3, 2)]


def test_many_queries_of_equal_lengths_meet_copies_of_a_band(spark, monkeypatch):
    """Nothing can be pruned here: every query meets every band, in blocks of queries."""
    rng = np.random.default_rng(3)
    x = rng.choice([-3, 3], size=(1200, 6))
    frame = spark.createDataFrame([(i, [float(v) for v in r]) for i, r in enumerate(x)], "vec_id bigint, embedding array<double>")
    v, seen = ip.scaled(frame, "vec_id", "embedding", 1), []
    plain = ip.blocked
    monkeypatch.setattr(ip, "blocked", lambda *a: seen.append(plain(*a)) or seen[-1])
    got = ip.top_k(v.filter("id % 2 = 0"), v, 3, part_rows=300, query_rows=40)
    assert sorted(map(tuple, got.collect())) == brute([(i, r.tolist()) for i, r in enumerate(x)], 3, 2)
    copies = 0
    for rows in seen:
        groups = rows.groupBy("band", "block").agg(F.count("query").alias("q"), F.count_if(F.col("query").isNull()).alias("c")).collect()
        bands = len({g.band for g in groups})
        assert len(groups) == 15 * bands and max(g.q for g in groups) <= 80 and sum(g.q for g in groups) == 600 * bands
        copies += sum(g.c for g in groups)
    assert len(seen) == 2 and copies == 15 * 1200


def test_long_vectors_make_smaller_bands(spark, monkeypatch):
    monkeypatch.setattr(ip, "PART_BYTES", 8 * 4 * 25)  # 25 vectors of four components
    rng = np.random.default_rng(6)
    x = rng.integers(-9, 9, size=(200, 4))
    frame = spark.createDataFrame([(i, [float(v) for v in r]) for i, r in enumerate(x)], "vec_id bigint, embedding array<double>")
    v, made = ip.scaled(frame, "vec_id", "embedding", 1), []
    plain = ip.meet
    monkeypatch.setattr(ip, "meet", lambda a, b, *rest: made.append(b.select("band").distinct().count()) or plain(a, b, *rest))
    got = ip.top_k(v.filter("id % 10 = 0"), v, 5)
    assert sorted(map(tuple, got.collect())) == brute([(i, r.tolist()) for i, r in enumerate(x)], 5, 10) and sum(made) >= 6
