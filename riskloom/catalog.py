"""Registered queries of the modelling engine, each over whole tables, and their SQL twins."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

import riskloom as rl
from riskloom.functions import metrics as m
from riskloom.functions import ranking
from riskloom.functions.quantiles import quantiles
from riskloom.operators.binning import PACKED, index_of
from riskloom.operators.shared import learn
from riskloom.plans import assume, keyed_reports, reports, validate
from riskloom.sources.tables import MODEL_FRAME, TIES, model_frame, table

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}
FRAME = f"WITH m AS ({MODEL_FRAME})"


def query(name: str, sql: str | None = None):
    def put(f: Query) -> Query:
        QUERIES[name] = f
        if sql:
            SQL[name] = sql
        return f

    return put


def rounded(df: DataFrame, digits: int = 6) -> DataFrame:
    return df.select(*[F.round(c, digits).alias(c) if t == "double" else F.col(c) for c, t in df.dtypes])


def one_row(spark: SparkSession, **values) -> DataFrame:
    kinds = ", ".join(f"{k} {'bigint' if isinstance(v, int) else 'double'}" for k, v in values.items())
    return rounded(spark.createDataFrame([tuple(v if isinstance(v, int) else float(v) for v in values.values())], kinds))


def scores(spark: SparkSession, sf_dir: str, weighted: bool = False, score: str = "s", *keep: str) -> DataFrame:
    return ranking.scored(model_frame(spark, sf_dir), F.col("y"), F.col(score), F.col("w") if weighted else None, keep)


# Binning

WOE_SQL = """, c AS (SELECT {key} AS bin, CAST(count(*) AS DOUBLE) AS n, CAST(sum(y) AS DOUBLE) AS e FROM m GROUP BY 1),
p AS (SELECT bin, n, e, (e + 0.5::DOUBLE) / sum(e + 0.5::DOUBLE) OVER () AS pe, (n - e + 0.5::DOUBLE) / sum(n - e + 0.5::DOUBLE) OVER () AS po FROM c)
SELECT bin, n, e AS n_events, round(e / n, 6) AS event_rate, round(ln(pe / po), 6) AS woe, round(sum((pe - po) * ln(pe / po)) OVER (), 6) AS iv FROM p"""


def case(x: str, edges: list[float]) -> str:
    return f"CASE WHEN {x} IS NULL THEN {len(edges) + 1} " + " ".join(f"WHEN {x} <= {e}::DOUBLE THEN {i}" for i, e in enumerate(edges)) + f" ELSE {len(edges)} END"


def bins_of(spark: SparkSession, sf_dir: str, strategy, column: str) -> DataFrame:
    result = strategy.fit(model_frame(spark, sf_dir), column, "y")
    return rounded(result.table(spark).drop("label"))


@query("woe_manual", FRAME + WOE_SQL.format(key=case("q", [10, 25, 40])))
def woe_manual(spark, sf_dir):
    return bins_of(spark, sf_dir, rl.manual([10, 25, 40]), "q")


@query("woe_missing", FRAME + WOE_SQL.format(key=case("d_miss", [0.03, 0.06])))
def woe_missing(spark, sf_dir):
    return bins_of(spark, sf_dir, rl.manual([0.03, 0.06]), "d_miss")


@query("bin_monotonic")
def bin_monotonic(spark, sf_dir):
    return bins_of(spark, sf_dir, rl.monotonic(), "price")


@query("bin_tree")
def bin_tree(spark, sf_dir):
    return bins_of(spark, sf_dir, rl.tree_bins(), "q")


@query("bin_tree_price")
def bin_tree_price(spark, sf_dir):
    return bins_of(spark, sf_dir, rl.tree_bins(), "price")


@query("bin_categorical", """WITH c AS (SELECT l_shipmode_like AS k, count(*) AS n, sum(y) AS e FROM (SELECT o_orderpriority AS l_shipmode_like, CAST(o_orderstatus = 'F' AS INT) AS y FROM orders) GROUP BY 1),
r AS (SELECT CASE WHEN n < 0.01::DOUBLE * sum(n) OVER () THEN 'RARE' ELSE k END AS label, n, e FROM c),
g AS (SELECT label, CAST(sum(n) AS DOUBLE) AS n, CAST(sum(e) AS DOUBLE) AS e FROM r GROUP BY 1),
p AS (SELECT *, (e + 0.5::DOUBLE) / sum(e + 0.5::DOUBLE) OVER () AS pe, (n - e + 0.5::DOUBLE) / sum(n - e + 0.5::DOUBLE) OVER () AS po FROM g)
SELECT label, n, e AS n_events, round(ln(pe / po), 6) AS woe FROM p""")
def bin_categorical(spark, sf_dir):
    df = table(spark, sf_dir, "orders").select("o_orderpriority", (F.col("o_orderstatus") == "F").cast("int").alias("y"))
    return rounded(rl.categorical().fit(df, "o_orderpriority", "y").table(spark).select("label", "n", "n_events", "woe"))


@query("iv_total", FRAME + ", c AS (" + " UNION ALL ".join(f"SELECT '{x}' AS col, {case(x, e)} AS bin, CAST(count(*) AS DOUBLE) AS n, CAST(sum(y) AS DOUBLE) AS e FROM m GROUP BY 1, 2" for x, e in (("q", [10, 25, 40]), ("x", [0.02, 0.05]), ("d", [0.03, 0.06]))) + """), p AS (SELECT col, (e + 0.5::DOUBLE) / sum(e + 0.5::DOUBLE) OVER w AS pe, (n - e + 0.5::DOUBLE) / sum(n - e + 0.5::DOUBLE) OVER w AS po FROM c WINDOW w AS (PARTITION BY col))
SELECT col, round(sum((pe - po) * ln(pe / po)), 6) AS iv FROM p GROUP BY col""")
def iv_total(spark, sf_dir):
    df = model_frame(spark, sf_dir)
    rows = [(c, rl.manual(e).fit(df, c, "y").iv) for c, e in (("q", [10, 25, 40]), ("x", [0.02, 0.05]), ("d", [0.03, 0.06]))]
    return rounded(spark.createDataFrame(rows, "col string, iv double"))


# Terms

IDS = "l_orderkey, l_linenumber, l_partkey, l_extendedprice"


def projected(spark, sf_dir, term, names: list[str]) -> DataFrame:
    df = model_frame(spark, sf_dir)
    columns = term.columns(term.fit(df, "y"))
    return rounded(df.select(*TIES, *[c.alias(n) for n, (_, c) in zip(names, columns)]))


@query("design_step", f"{FRAME} SELECT {IDS}, CAST(q > 10 AND q <= 20 AS DOUBLE) AS b1, CAST(q > 20 AND q <= 40 AS DOUBLE) AS b2, CAST(q > 40 AS DOUBLE) AS b3 FROM m")
def design_step(spark, sf_dir):
    return projected(spark, sf_dir, rl.step("q", [10, 20, 40]), ["b1", "b2", "b3"])


@query("design_hinge", f"{FRAME} SELECT {IDS}, greatest(0::DOUBLE, q - 25) AS h FROM m")
def design_hinge(spark, sf_dir):
    return projected(spark, sf_dir, rl.hinge("q", 25), ["h"])


@query("design_interact", f"{FRAME} SELECT {IDS}, q AS a, d AS b, x AS c, round(q * d, 6) AS ab, round(q * x, 6) AS ac, round(d * x, 6) AS bc, round(q * d * x, 6) AS abc FROM m")
def design_interact(spark, sf_dir):
    return projected(spark, sf_dir, rl.interact("q", "d", "x"), ["a", "b", "c", "ab", "ac", "bc", "abc"])


@query("design_cross", f"{FRAME} SELECT {IDS}, CAST(q > 20 AND q <= 40 AS DOUBLE) * d AS c1, CAST(q > 40 AS DOUBLE) * d AS c2 FROM m")
def design_cross(spark, sf_dir):
    return projected(spark, sf_dir, rl.cross(rl.step("q", [20, 40]), "d"), ["c1", "c2"])


@query("design_woe", FRAME + WOE_SQL.format(key=case("q", [10, 25, 40])).replace("SELECT bin, n, e AS n_events, round(e / n, 6) AS event_rate, round(ln(pe / po), 6) AS woe, round(sum((pe - po) * ln(pe / po)) OVER (), 6) AS iv FROM p", f"SELECT {IDS}, round(ln(pe / po), 6) AS woe FROM m JOIN p ON p.bin = {case('q', [10, 25, 40])}"))
def design_woe(spark, sf_dir):
    return projected(spark, sf_dir, rl.woe("q", rl.manual([10, 25, 40])), ["woe"])


@query("design_binned", f"{FRAME} SELECT {IDS}, CAST(q > 10 AND q <= 25 AS DOUBLE) AS b1, CAST(q > 25 AND q <= 40 AS DOUBLE) AS b2, CAST(q > 40 AS DOUBLE) AS b3 FROM m")
def design_binned(spark, sf_dir):
    return projected(spark, sf_dir, rl.binned("q", rl.manual([10, 25, 40])), ["b1", "b2", "b3"])


@query("poly_orthogonal", f"{FRAME}, c AS (SELECT avg(q) AS mu, count(*) AS n FROM m), a AS (SELECT sum((q - mu) ** 2) AS s2, sum((q - mu) ** 3) AS s3, any_value(n) AS n FROM m, c), o AS (SELECT {IDS}, q - mu AS z, (q - mu) ** 2 - (q - mu) * s3 / s2 - s2 / a.n AS r, s2 FROM m, c, a), k AS (SELECT sum(r * r) AS rr FROM o) SELECT {IDS}, round(z / sqrt(s2), 6) AS p1, round(r / sqrt(rr), 6) AS p2 FROM o, k")
def poly_orthogonal(spark, sf_dir):
    return projected(spark, sf_dir, rl.poly("q", 2), ["p1", "p2"])


@query("spline_fit")
def spline_fit(spark, sf_dir):
    df = model_frame(spark, sf_dir)
    sol = rl.solve(rl.linear("price", [rl.bs("q", 5), rl.ns("d", 3)]), df)
    return rounded(rl.predict(sol, df).groupBy("q", "d").agg(F.avg("prediction").alias("fitted"), F.count("*").alias("n")))


# Losses

@query("loss_values", f"{FRAME} SELECT round(sum(w * (y - s) * (y - s)) / sum(w) / 2, 6) AS squared, round(sum(w * (greatest(s, 0) + ln(1 + exp(-abs(s))) - y * s)) / sum(w), 6) AS logistic FROM m")
def loss_values(spark, sf_dir):
    df, w, y, s = model_frame(spark, sf_dir), F.col("w"), F.col("y"), F.col("s")
    part = lambda loss: F.sum(w * loss.loss_column(y, s)) / F.sum(w)
    return rounded(df.agg(part(rl.squared_error()).alias("squared"), part(rl.logistic()).alias("logistic")))


# Metrics

RANK_SQL = ", g AS (SELECT {by} s, sum({w} * y) AS p, sum({w} * (1 - y)) AS n FROM m GROUP BY ALL), r AS (SELECT *, sum(p) OVER (PARTITION BY {part} ORDER BY s) AS cp, sum(n) OVER (PARTITION BY {part} ORDER BY s) AS cn, sum(p) OVER (PARTITION BY {part}) AS tp, sum(n) OVER (PARTITION BY {part}) AS tn FROM g)"
FLAT = RANK_SQL.format(by="", w="1::DOUBLE", part="1")
WEIGHTED = RANK_SQL.format(by="", w="w", part="1")


@query("auc", FRAME + FLAT + " SELECT round(sum(p * (cn - n / 2)) / any_value(tp * tn), 9) AS auc FROM r")
def auc(spark, sf_dir):
    return rounded(ranking.discrimination(scores(spark, sf_dir)).select("auc"), 9)


@query("auc_weighted", FRAME + WEIGHTED + " SELECT round(sum(p * (cn - n / 2)) / any_value(tp * tn), 9) AS auc FROM r")
def auc_weighted(spark, sf_dir):
    return rounded(ranking.discrimination(scores(spark, sf_dir, True)).select("auc"), 9)


@query("gini", FRAME + FLAT + " SELECT round(2 * sum(p * (cn - n / 2)) / any_value(tp * tn) - 1, 9) AS gini FROM r")
def gini(spark, sf_dir):
    return rounded(ranking.discrimination(scores(spark, sf_dir)).select("gini"), 9)


@query("ks", FRAME + FLAT + " SELECT round(abs(cp / tp - cn / tn), 9) AS ks, s AS ks_at FROM r ORDER BY abs(cp / tp - cn / tn) DESC, s LIMIT 1")
def ks(spark, sf_dir):
    return rounded(ranking.discrimination(scores(spark, sf_dir)).select("ks", "ks_at"), 9)


@query("brier", f"{FRAME} SELECT round(sum(w * (y - s) ** 2) / sum(w), 9) AS brier FROM m")
def brier(spark, sf_dir):
    return rounded(scores(spark, sf_dir, True).agg((F.sum(F.col("w") * m.brier_column()) / F.sum("w")).alias("brier")), 9)


@query("log_loss", f"{FRAME}, c AS (SELECT y, w, least(greatest(s, 1e-12::DOUBLE), 1 - 1e-12::DOUBLE) AS p FROM m) SELECT round(sum(-w * (y * ln(p) + (1 - y) * ln(1 - p))) / sum(w), 9) AS log_loss FROM c")
def log_loss(spark, sf_dir):
    return rounded(scores(spark, sf_dir, True).agg((F.sum(F.col("w") * m.log_loss_column()) / F.sum("w")).alias("log_loss")), 9)


@query("cohens_d", f"{FRAME} SELECT round((avg(s) FILTER (y = 1) - avg(s) FILTER (y = 0)) / sqrt(((count(*) FILTER (y = 1) - 1) * var_samp(s) FILTER (y = 1) + (count(*) FILTER (y = 0) - 1) * var_samp(s) FILTER (y = 0)) / (count(*) - 2)), 6) AS cohens_d FROM m")
def cohens_d(spark, sf_dir):
    return one_row(spark, cohens_d=m.cohens_d_of(scores(spark, sf_dir)).value)


@query("distribution", f"{FRAME} SELECT round(avg(s), 6) AS mean, round(median(s), 6) AS median, min(s) AS least, max(s) AS largest FROM m")
def distribution(spark, sf_dir):
    frame = scores(spark, sf_dir)
    return rounded(frame.agg(F.avg("s").alias("mean"), F.lit(quantiles(frame, "s", [0.5])[0]).alias("median"), F.min("s").alias("least"), F.max("s").alias("largest")))


def mass(order: str, k: int = 10, w: str = "1::DOUBLE") -> str:
    return f", o AS (SELECT *, sum({w}) OVER (ORDER BY {order} ROWS UNBOUNDED PRECEDING) - {w} AS before, sum({w}) OVER () AS total FROM m), b AS (SELECT *, CAST(floor(before * {k}::DOUBLE / total + 1e-12::DOUBLE) AS INT) AS bin FROM o)"


UP, DOWN = f"s, {IDS}", f"s DESC, {IDS}"


@query("calibration", FRAME + mass(UP) + " SELECT bin, round(avg(s), 6) AS predicted, round(avg(y), 6) AS observed, CAST(count(*) AS DOUBLE) AS n FROM b GROUP BY bin")
def calibration(spark, sf_dir):
    return rounded(ranking.calibration_bins(scores(spark, sf_dir, False, "s", *TIES), 10, TIES))


@query("calibration_weighted", FRAME + mass(UP, 10, "w") + " SELECT bin, round(sum(w * s) / sum(w), 6) AS predicted, round(sum(w * y) / sum(w), 6) AS observed, sum(w) AS n FROM b GROUP BY bin")
def calibration_weighted(spark, sf_dir):
    return rounded(ranking.calibration_bins(scores(spark, sf_dir, True, "s", *TIES), 10, TIES))


@query("ece", FRAME + mass(UP) + ", c AS (SELECT avg(s) AS p, avg(y) AS o, count(*) AS n FROM b GROUP BY bin) SELECT round(sum(n * abs(o - p)) / sum(n), 6) AS ece FROM c")
def ece(spark, sf_dir):
    return one_row(spark, ece=m.ece_of(scores(spark, sf_dir, False, "s", *TIES), 10, TIES).value)


@query("lift", FRAME + mass(DOWN) + ", c AS (SELECT bin + 1 AS decile, avg(s) AS ms, avg(y) AS er, sum(y) AS e, count(*) AS n FROM b GROUP BY bin) SELECT decile, round(ms, 6) AS mean_score, round(er, 6) AS event_rate, round(er / (sum(e) OVER () / sum(n) OVER ()), 6) AS lift, round(sum(e) OVER (ORDER BY decile) / sum(e) OVER (), 6) AS captured_response, CAST(n AS DOUBLE) AS n FROM c")
def lift(spark, sf_dir):
    return rounded(ranking.lift_bins(scores(spark, sf_dir, False, "s", *TIES), 10, TIES))


@query("gains", f"{FRAME} SELECT round(row_number() OVER o / CAST(count(*) OVER () AS DOUBLE), 9) AS share, round(sum(y) OVER (o ROWS UNBOUNDED PRECEDING) / CAST(sum(y) OVER () AS DOUBLE), 9) AS captured FROM m WINDOW o AS (ORDER BY {DOWN}) UNION ALL SELECT 0::DOUBLE, 0::DOUBLE")
def gains(spark, sf_dir):
    return rounded(ranking.gains(scores(spark, sf_dir, False, "s", *TIES), TIES), 9)


PSI_SQL = ", e AS (SELECT quantile_cont(s, [0.1, 0.2, 0.3, 0.4, 0.5, 0.6, 0.7, 0.8, 0.9]) AS cuts FROM m WHERE {old}), c AS (SELECT {by} len(list_filter(cuts, lambda v: v <= s)) AS bin, {old} AS old FROM m, e), "
OLD = "t < DATE '1995-06-17'"


@query("psi", FRAME + PSI_SQL.format(old=OLD, by="") + "n AS (SELECT bin, greatest(count(*) FILTER (old) / CAST(sum(count(*) FILTER (old)) OVER () AS DOUBLE), 1e-6::DOUBLE) AS r, greatest(count(*) FILTER (NOT old) / CAST(sum(count(*) FILTER (NOT old)) OVER () AS DOUBLE), 1e-6::DOUBLE) AS c FROM c GROUP BY bin) SELECT round(sum((c - r) * ln(c / r)), 6) AS psi FROM n")
def psi(spark, sf_dir):
    df = model_frame(spark, sf_dir)
    old = F.col("t") < F.lit("1995-06-17").cast("date")
    return one_row(spark, psi=rl.psi(df.filter(old), df.filter(~old), "s").value)


def newton_sql(x: str, start: tuple[float, float], ridge: str = "0::DOUBLE", w: str = "1::DOUBLE", steps: int = 14) -> str:
    """Logistic regression of y on one column by Newton steps in a recursive CTE: columns a (constant) and b."""
    p = f"1 / (1 + exp(-(n.a + n.b * ({x}))))"
    return f"""RECURSIVE n AS (SELECT 0 AS i, {start[0]}::DOUBLE AS a, {start[1]}::DOUBLE AS b UNION ALL
SELECT i + 1, a + (h22 * g1 - h12 * g2) / (h11 * h22 - h12 * h12), b + (h11 * g2 - h12 * g1) / (h11 * h22 - h12 * h12) FROM (
SELECT n.i, n.a, n.b, sum({w} * p * (1 - p)) AS h11, sum({w} * p * (1 - p) * z) AS h12, sum({w} * p * (1 - p) * z * z) + {ridge} AS h22, sum({w} * (y - p)) AS g1, sum({w} * (y - p) * z) - {ridge} * n.b AS g2
FROM (SELECT n.*, y, w, {x} AS z, {p} AS p FROM n, m WHERE i < {steps}) n GROUP BY n.i, n.a, n.b))"""


CLIPPED = "ln(least(greatest(s, 1e-12::DOUBLE), 1 - 1e-12::DOUBLE) / (1 - least(greatest(s, 1e-12::DOUBLE), 1 - 1e-12::DOUBLE)))"


@query("calibration_fit", "WITH " + newton_sql(CLIPPED, (0.0, 0.0)).replace("RECURSIVE n", f"RECURSIVE m AS ({MODEL_FRAME}), n") + " SELECT round(b, 6) AS slope, round(a, 6) AS intercept FROM n WHERE i = 14")
def calibration_fit(spark, sf_dir):
    slope, intercept = m.calibration_fit(scores(spark, sf_dir))
    return one_row(spark, slope=slope, intercept=intercept)


RANKS = ", ".join(f"rank() OVER (ORDER BY {s}) + (count(*) OVER (PARTITION BY {s}) - 1) / 2::DOUBLE AS all_{s}, rank() OVER (PARTITION BY y ORDER BY {s}) + (count(*) OVER (PARTITION BY y, {s}) - 1) / 2::DOUBLE AS own_{s}" for s in ("s", "sb"))


@query("delong", f"""{FRAME}, n AS (SELECT sum(y) AS p, sum(1 - y) AS q FROM m), r AS (SELECT y, {RANKS} FROM m),
v AS (SELECT y, CASE WHEN y = 1 THEN (all_s - own_s) / q ELSE 1 - (all_s - own_s) / p END AS a, CASE WHEN y = 1 THEN (all_sb - own_sb) / q ELSE 1 - (all_sb - own_sb) / p END AS b FROM r, n),
c AS (SELECT avg(a) FILTER (y = 1) AS ma, avg(b) FILTER (y = 1) AS mb, (var_samp(a - b) FILTER (y = 1)) / count(*) FILTER (y = 1) + (var_samp(a - b) FILTER (y = 0)) / count(*) FILTER (y = 0) AS v FROM v)
SELECT round(ma, 6) AS auc_a, round(mb, 6) AS auc_b, round((ma - mb) / sqrt(v), 6) AS z FROM c""")
def delong(spark, sf_dir):
    frame = model_frame(spark, sf_dir).select(F.col("y").cast("double").alias("y"), F.col("s").alias("a"), F.col("sb").alias("b"))
    d = m.delong_from(*m.delong_of(frame, ("a", "b")))
    return one_row(spark, auc_a=d.auc_a, auc_b=d.auc_b, z=d.z)


# Fits

def coefficient_rows(spark, sol) -> DataFrame:
    return rounded(sol.coefficients_df(spark).select("term", "estimate"))


TWO = """, c AS (SELECT {w} AS w, d - sum({w} * d) OVER () / sum({w}) OVER () AS a, x - sum({w} * x) OVER () / sum({w}) OVER () AS b, q - sum({w} * q) OVER () / sum({w}) OVER () AS z FROM m),
g AS (SELECT sum(w * a * a) + {lam} AS aa, sum(w * a * b) AS ab, sum(w * b * b) + {lam} AS bb, sum(w * a * z) AS az, sum(w * b * z) AS bz FROM c),
k AS (SELECT (az * bb - bz * ab) / (aa * bb - ab * ab) AS b1, (aa * bz - ab * az) / (aa * bb - ab * ab) AS b2 FROM g),
v AS (SELECT sum({w} * q) / sum({w}) - b1 * sum({w} * d) / sum({w}) - b2 * sum({w} * x) / sum({w}) AS b0, b1, b2 FROM m, k GROUP BY b1, b2)
SELECT '(Intercept)' AS term, round(b0, 6) AS estimate FROM v UNION ALL SELECT 'd', round(b1, 6) FROM v UNION ALL SELECT 'x', round(b2, 6) FROM v"""


@query("ols_simple", f"{FRAME} SELECT '(Intercept)' AS term, round(regr_intercept(price, q), 6) AS estimate FROM m UNION ALL SELECT 'q', round(regr_slope(price, q), 6) FROM m")
def ols_simple(spark, sf_dir):
    return coefficient_rows(spark, rl.solve(rl.linear("price", "q"), model_frame(spark, sf_dir)))


@query("ols_multi", FRAME + TWO.format(w="1::DOUBLE", lam="0"))
def ols_multi(spark, sf_dir):
    return coefficient_rows(spark, rl.solve(rl.linear("q", ["d", "x"]), model_frame(spark, sf_dir)))


@query("wls", FRAME + TWO.format(w="m.w", lam="0"))
def wls(spark, sf_dir):
    return coefficient_rows(spark, rl.solve(rl.linear("q", ["d", "x"]), model_frame(spark, sf_dir), weights="w"))


@query("ridge", FRAME + TWO.format(w="1::DOUBLE", lam="0.001::DOUBLE * count(*)"))
def ridge(spark, sf_dir):
    return coefficient_rows(spark, rl.solve(rl.linear("q", ["d", "x"], penalty=rl.l2(0.001)), model_frame(spark, sf_dir), on_violation="ignore"))


@query("lasso_1d", f"{FRAME}, c AS (SELECT stddev_pop(q) AS sd, covar_pop(q, price) / stddev_pop(q) AS r, avg(q) AS mx, avg(price) AS my FROM m), b AS (SELECT sign(r) * greatest(abs(r) - 1.5::DOUBLE, 0) / sd AS b, mx, my FROM c) SELECT '(Intercept)' AS term, round(my - b * mx, 6) AS estimate FROM b UNION ALL SELECT 'q', round(b, 6) FROM b")
def lasso_1d(spark, sf_dir):
    return coefficient_rows(spark, rl.solve(rl.linear("price", "q", penalty=rl.l1(1.5)), model_frame(spark, sf_dir)))


@query("elastic_net_1d", f"{FRAME}, c AS (SELECT stddev_pop(q) AS sd, covar_pop(q, price) / stddev_pop(q) AS r, avg(q) AS mx, avg(price) AS my FROM m), b AS (SELECT sign(r) * greatest(abs(r) - 1.5::DOUBLE, 0) / (1 + 0.5::DOUBLE) / sd AS b, mx, my FROM c) SELECT '(Intercept)' AS term, round(my - b * mx, 6) AS estimate FROM b UNION ALL SELECT 'q', round(b, 6) FROM b")
def elastic_net_1d(spark, sf_dir):
    return coefficient_rows(spark, rl.solve(rl.linear("price", "q", penalty=rl.l1(1.5) + rl.l2(0.5)), model_frame(spark, sf_dir)))


@query("logit_irls", "WITH " + newton_sql("q / 50::DOUBLE", (0.0, 0.0), w="w").replace("RECURSIVE n", f"RECURSIVE m AS ({MODEL_FRAME}), n") + " SELECT '(Intercept)' AS term, round(a, 6) AS estimate FROM n WHERE i = 14 UNION ALL SELECT 'q', round(b / 50::DOUBLE, 6) FROM n WHERE i = 14")
def logit_irls(spark, sf_dir):
    return coefficient_rows(spark, rl.solve(rl.linear("y", "q", loss=rl.logistic()), model_frame(spark, sf_dir), weights="w"))


@query("logit_ridge", "WITH " + newton_sql("d", (0.0, 0.0), "(0.001::DOUBLE * count(*))").replace("RECURSIVE n", f"RECURSIVE m AS ({MODEL_FRAME}), n") + " SELECT '(Intercept)' AS term, round(a, 6) AS estimate FROM n WHERE i = 14 UNION ALL SELECT 'd', round(b, 6) FROM n WHERE i = 14")
def logit_ridge(spark, sf_dir):
    return coefficient_rows(spark, rl.solve(rl.linear("y", "d", loss=rl.logistic(), penalty=rl.l2(0.001)), model_frame(spark, sf_dir)))


@query("logit_lasso")
def logit_lasso(spark, sf_dir):
    return coefficient_rows(spark, rl.solve(rl.linear("y", ["q", "d", "x", "price"], loss=rl.logistic(), penalty=rl.l1(0.001)), model_frame(spark, sf_dir), on_violation="ignore"))


@query("coefficients_table", f"{FRAME}, a AS (SELECT count(*) AS n, regr_sxx(price, q) AS sxx, regr_syy(price, q) AS syy, regr_sxy(price, q) AS sxy, avg(q) AS mx, regr_slope(price, q) AS b, regr_intercept(price, q) AS c FROM m), s AS (SELECT *, (syy - sxy * sxy / sxx) / (n - 2) AS s2 FROM a) SELECT 'q' AS term, round(b, 6) AS estimate, round(sqrt(s2 / sxx), 6) AS std_error FROM s UNION ALL SELECT '(Intercept)', round(c, 6), round(sqrt(s2 * (1 / n::DOUBLE + mx * mx / sxx)), 6) FROM s")
def coefficients_table(spark, sf_dir):
    return rounded(rl.coefficients(rl.solve(rl.linear("price", "q"), model_frame(spark, sf_dir)), spark).select("term", "estimate", "std_error"))


@query("predict_linear", f"{FRAME}, k AS (SELECT regr_intercept(price, q) AS a, regr_slope(price, q) AS b FROM m) SELECT {IDS}, round(a + b * q, 6) AS prediction FROM m, k")
def predict_linear(spark, sf_dir):
    df = model_frame(spark, sf_dir)
    return rounded(rl.predict(rl.solve(rl.linear("price", "q"), df), df).select(*TIES, "prediction"))


@query("predict_segment", f"{FRAME}, k AS (SELECT seg, regr_intercept(price, q) AS a, regr_slope(price, q) AS b FROM m GROUP BY seg) SELECT seg, round(sum(a + b * q), 4) AS total, count(*) AS n FROM m JOIN k USING (seg) GROUP BY seg")
def predict_segment(spark, sf_dir):
    df = model_frame(spark, sf_dir)
    sol = rl.solve(rl.segmented("seg", rl.linear("price", "q")), df)
    return rounded(rl.predict(sol, df).groupBy("seg").agg(F.sum("prediction").alias("total"), F.count("*").alias("n")), 4)


MANY = "WITH m AS (SELECT l_suppkey AS supp, CAST(l_returnflag = 'R' AS INT) AS y, CAST(l_quantity AS DOUBLE) AS q, CAST(l_extendedprice AS DOUBLE) / CAST(1000 AS DOUBLE) AS price FROM lineitem)"


def many_segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.sql(MANY.replace("FROM lineitem", "FROM {lineitem}") + " SELECT * FROM m", lineitem=table(spark, sf_dir, "lineitem"))


@query("predict_segment_many", f"{MANY}, k AS (SELECT supp, regr_intercept(price, q) AS a, regr_slope(price, q) AS b FROM m GROUP BY supp) SELECT supp, round(sum(a + b * q), 2) AS total, round(sum((a + b * q) * (a + b * q)), 1) AS squares, count(*) AS n FROM m JOIN k USING (supp) GROUP BY supp")
def predict_segment_many(spark, sf_dir):
    df = many_segments(spark, sf_dir)
    scored = rl.predict(rl.solve(rl.segmented("supp", rl.linear("price", "q")), df), df)
    out = scored.groupBy("supp").agg(F.round(F.sum("prediction"), 2).alias("total"), F.round(F.sum(F.col("prediction") * F.col("prediction")), 1).alias("squares"), F.count("*").alias("n"))
    return out


SEGMENT_WOE = f"""{MANY}, b AS (SELECT *, CASE WHEN q <= 15 THEN 0 WHEN q <= 35 THEN 1 ELSE 2 END AS k FROM m),
c AS (SELECT supp, k, sum(y) + 0.5::DOUBLE AS e, count(*) - sum(y) + 0.5::DOUBLE AS o FROM (SELECT supp, k, y FROM b) GROUP BY supp, k),
v AS (SELECT supp, k, ln((e / sum(e) OVER (PARTITION BY supp)) / (o / sum(o) OVER (PARTITION BY supp))) AS woe FROM c),
g AS (SELECT supp, min(q) AS lo, max(q) AS hi, quantile_cont(q, 0.5) AS mid FROM m GROUP BY supp)
SELECT supp, round(regr_slope(price, woe), 5) AS slope, round(regr_intercept(price, woe), 5) AS intercept, any_value(round(lo, 5)) AS lo, any_value(round(mid, 5)) AS mid, any_value(round(hi, 5)) AS hi FROM b JOIN v USING (supp, k) JOIN g USING (supp) GROUP BY supp"""


@query("segment_terms", SEGMENT_WOE)
def segment_terms(spark, sf_dir):
    """Fits by segment whose terms learn: a slope on the weight of evidence (no segment lacks a bin), and the knots of a spline."""
    df = many_segments(spark, sf_dir).withColumn("default", F.col("y"))
    target = "default"
    states = learn([rl.woe("q", rl.manual([15, 35])), rl.ns("q", 2)], df, target, None, F.col("supp"))
    rows = [(int(seg), *(float(k) for k in knots)) for seg, (_, knots) in states.items()]
    knots = spark.createDataFrame(rows, "supp bigint, lo double, mid double, hi double")
    table_of = spark.createDataFrame([(int(seg), own.packed()) for seg, (own, _) in states.items()], f"of bigint, bins {PACKED}")
    own = df.join(table_of, F.col("supp") == F.col("of")).withColumn("evidence", F.get(F.col("bins.woe"), index_of("q", F.col("bins"), 2)))
    fits = rl.solve(rl.segmented("supp", rl.linear("price", "evidence")), own).coefficients_df(spark)
    slopes = fits.groupBy(F.col("segment").cast("bigint").alias("supp")).agg(F.max(F.when(F.col("term") == "evidence", F.col("estimate"))).alias("slope"), F.max(F.when(F.col("term") != "evidence", F.col("estimate"))).alias("intercept"))
    return rounded(slopes.join(knots, "supp"), 5)


def share_sql(i: int, column: str, key: str) -> str:
    return f"SELECT {i} AS term, '{column}' AS feature, {key} AS k, count(*) AS n, sum(y) AS e FROM m GROUP BY 3"


BINNINGS = [("q", "manual"), ("x", "manual"), ("d", "manual"), ("price", "halves"), ("q", "halves"), ("seg", "levels")]
HALVES = "(SELECT quantile_cont({c}, 0.5) FROM m)"
BINNINGS_SQL = f"""{FRAME}, c AS ({' UNION ALL '.join(share_sql(i, c, k) for i, (c, k) in enumerate([
    ('q', 'CASE WHEN q <= 10 THEN 0 WHEN q <= 25 THEN 1 ELSE 2 END'), ('x', 'CASE WHEN x <= 0.02::DOUBLE THEN 0 WHEN x <= 0.05::DOUBLE THEN 1 ELSE 2 END'), ('d', 'CASE WHEN d <= 0.03::DOUBLE THEN 0 WHEN d <= 0.06::DOUBLE THEN 1 ELSE 2 END'),
    ('price', f"CASE WHEN price <= {HALVES.format(c='price')} THEN 0 ELSE 1 END"), ('q', f"CASE WHEN q <= {HALVES.format(c='q')} THEN 0 ELSE 1 END"), ('seg', "CASE WHEN seg = (SELECT seg FROM m GROUP BY seg ORDER BY count(*) DESC, seg LIMIT 1) THEN 0 ELSE 1 END")]))}),
p AS (SELECT *, (e + 0.5::DOUBLE) / sum(e + 0.5::DOUBLE) OVER (PARTITION BY term) AS pe, (n - e + 0.5::DOUBLE) / sum(n - e + 0.5::DOUBLE) OVER (PARTITION BY term) AS po FROM c)
SELECT term, feature, k AS bin, CAST(n AS DOUBLE) AS n, CAST(e AS DOUBLE) AS n_events, round(ln(pe / po), 6) AS woe FROM p"""


@query("fit_binnings", BINNINGS_SQL)
def fit_binnings_query(spark, sf_dir):
    """Six columns, three strategies, the same passes."""
    made = {"halves": rl.monotonic(max_bins=2), "levels": rl.categorical()}
    edges = {"q": [10, 25], "x": [0.02, 0.05], "d": [0.03, 0.06]}
    spec = rl.fit_binnings(rl.linear("y", [rl.woe(c, rl.manual(edges[c]) if how == "manual" else made[how]) for c, how in BINNINGS]), model_frame(spark, sf_dir))
    rows = [(i, t.col, k, float(e + o), float(e), w) for i, t in enumerate(spec.features) for k, (e, o, w) in enumerate(zip(t.fitted.events, t.fitted.others, t.fitted.woe))]
    return rounded(spark.createDataFrame(rows, "term int, feature string, bin int, n double, n_events double, woe double"))


@query("lambda_max", f"{FRAME} SELECT round(greatest(abs(covar_pop(q, price) / stddev_pop(q)), abs(covar_pop(d, price) / stddev_pop(d))), 6) AS lambda_max FROM m")
def lambda_max(spark, sf_dir):
    return one_row(spark, lambda_max=validate.lambda_max(rl.linear("price", ["q", "d"], penalty=rl.l1(1)), model_frame(spark, sf_dir)))


@query("lambda_path")
def lambda_path(spark, sf_dir):
    return rounded(rl.lambda_path(rl.linear("price", ["q", "d", "x"], penalty=rl.l1(1)), model_frame(spark, sf_dir), 20).to_df(spark))


@query("lambda_path_1d", f"""{FRAME}, c AS (SELECT stddev_pop(q) AS sd, covar_pop(q, price) / stddev_pop(q) AS r, avg(q) AS mx, avg(price) AS my FROM m),
l AS (SELECT abs(r) * pow(0.001::DOUBLE, CAST(k AS DOUBLE) / 9) AS lam, c.* FROM c, range(10) x(k)), b AS (SELECT lam, sign(r) * greatest(abs(r) - lam, 0) / sd AS b, mx, my FROM l)
SELECT round(lam, 6) AS lambda, '(Intercept)' AS term, round(my - b * mx, 6) AS coefficient FROM b UNION ALL SELECT round(lam, 6), 'q', round(b, 6) + 0::DOUBLE FROM b""")
def lambda_path_1d(spark, sf_dir):
    out = rounded(rl.lambda_path(rl.linear("price", "q", penalty=rl.l1(1)), model_frame(spark, sf_dir), 10).to_df(spark))
    return out.withColumn("coefficient", F.col("coefficient") + 0.0)  # no negative zeros


@query("bootstrap_ci")
def bootstrap_ci(spark, sf_dir):
    df = model_frame(spark, sf_dir)
    boot = rl.bootstrap(rl.solve(rl.linear("price", ["q", "d"]), df), df, 200, random_state=1)
    return rounded(spark.createDataFrame([(k, a, b) for k, (a, b) in boot.coefficient_ci().items()], "term string, low double, high double"))


# Splits

def fold_counts(spark, sf_dir, splitter) -> DataFrame:
    return splitter.assign(model_frame(spark, sf_dir)).groupBy("fold", "role").agg(F.count("*").alias("n"), F.min("t").cast("date").alias("first"), F.max("t").cast("date").alias("last"))


FOLD_SQL = " SELECT fold, role, count(*) AS n, CAST(min(t) AS DATE) AS first, CAST(max(t) AS DATE) AS last FROM ({}) GROUP BY fold, role"


def both(train: str, valid: str, folds: str, more: str = "") -> str:
    return FRAME + f", z AS (SELECT min(t) AS t0, max(t) AS t1 FROM m), f AS ({folds}){more}" + FOLD_SQL.format(f"SELECT f.fold, 'train' AS role, t FROM m, f WHERE {train} UNION ALL SELECT f.fold, 'valid', t FROM m, f WHERE {valid}")


@query("split_expanding", both("t <= e", "t > e + INTERVAL 30 DAY AND t <= e + INTERVAL 210 DAY", "SELECT CAST(k AS INT) AS fold, t0 + (365 + 180 * k) * INTERVAL 1 DAY AS e FROM z, range(4) r(k)"))
def split_expanding(spark, sf_dir):
    return fold_counts(spark, sf_dir, rl.expanding_window("t", 4, "180 days", "30 days", "365 days"))


@query("split_rolling", both("t > e - INTERVAL 365 DAY AND t <= e", "t > e + INTERVAL 10 DAY AND t <= e + INTERVAL 190 DAY", "SELECT CAST(k AS INT) AS fold, e FROM (SELECT k, t0 + (365 + 180 * k) * INTERVAL 1 DAY AS e, t1 FROM z, range(40) r(k)) WHERE e + INTERVAL 190 DAY <= t1 + INTERVAL 180 DAY"))
def split_rolling(spark, sf_dir):
    return fold_counts(spark, sf_dir, rl.rolling_window("t", "365 days", "180 days", "180 days", "10 days"))


@query("split_purged", FRAME + f", o AS (SELECT t, row_number() OVER (ORDER BY t, {IDS}) AS i, count(*) OVER () AS n FROM m), v AS (SELECT t, CAST((SELECT count(*) FROM range(1, 5) r(k) WHERE o.i > floor(o.n * k / 5::DOUBLE)) AS INT) AS fold FROM o), b AS (SELECT fold, min(t) AS lo, max(t) AS hi FROM v GROUP BY fold)" + FOLD_SQL.format("SELECT fold, 'valid' AS role, t FROM v UNION ALL SELECT b.fold, 'train', m.t FROM m, b WHERE m.t < lo - INTERVAL 30 DAY OR m.t > hi + INTERVAL 30 DAY"))
def split_purged(spark, sf_dir):
    return fold_counts(spark, sf_dir, rl.purged_kfold("t", 5, "30 days", TIES))


@query("split_time", FRAME + f", o AS (SELECT t, row_number() OVER (ORDER BY t, {IDS}) AS i, count(*) OVER () AS n FROM m) SELECT CASE WHEN i <= round_even(0.6::DOUBLE * n, 0) THEN 0 WHEN i <= round_even(0.8::DOUBLE * n, 0) THEN 1 ELSE 2 END AS part, count(*) AS n, CAST(min(t) AS DATE) AS first, CAST(max(t) AS DATE) AS last FROM o GROUP BY 1")
def split_time(spark, sf_dir):
    parts = rl.time_split(model_frame(spark, sf_dir), "t", (0.6, 0.2, 0.2), TIES)
    made = [p.agg(F.lit(i).alias("part"), F.count("*").alias("n"), F.min("t").cast("date").alias("first"), F.max("t").cast("date").alias("last")) for i, p in enumerate(parts)]
    return made[0].unionByName(made[1]).unionByName(made[2])


@query("tune_curve")
def tune_curve(spark, sf_dir):
    made = rl.tune(lambda lam: rl.linear("price", ["q", "d", "x"], penalty=rl.l1(lam)), {"lam": [0.1, 1.0, 3.0]}, model_frame(spark, sf_dir), rl.expanding_window("t", 2, "365 days"), mean_squared, direction="min")
    return rounded(made.curve_df(spark))


def mean_squared(sol, df) -> float:
    return df.agg(F.avg(F.pow(F.col(sol.spec.target) - sol.score(), F.lit(2.0)))).first()[0]


#: Newton steps for both folds at once; the normal equations of three coefficients are solved by Cramer's rule.
NEWTON_SQL = f"""WITH RECURSIVE {FRAME[5:]}, z AS (SELECT min(t) AS t0 FROM m), f AS (SELECT CAST(k AS INT) AS fold, t0 + (365 + 365 * k) * INTERVAL 1 DAY AS e FROM z, range(2) r(k)),
tr AS (SELECT fold, q, d, y FROM m, f WHERE t <= e), va AS (SELECT fold, q, d, y FROM m, f WHERE t > e AND t <= e + INTERVAL 365 DAY),
b(fold, step, b0, b1, b2) AS (SELECT fold, 0, ln(avg(y) / (1 - avg(y))), 0::DOUBLE, 0::DOUBLE FROM tr GROUP BY fold UNION ALL
SELECT fold, step + 1, b0 + (g0 * (h11 * h22 - h12 * h12) - h01 * (g1 * h22 - h12 * g2) + h02 * (g1 * h12 - h11 * g2)) / det, b1 + (h00 * (g1 * h22 - h12 * g2) - g0 * (h01 * h22 - h12 * h02) + h02 * (h01 * g2 - g1 * h02)) / det, b2 + (h00 * (h11 * g2 - g1 * h12) - h01 * (h01 * g2 - g1 * h02) + g0 * (h01 * h12 - h11 * h02)) / det
FROM (SELECT *, h00 * (h11 * h22 - h12 * h12) - h01 * (h01 * h22 - h12 * h02) + h02 * (h01 * h12 - h11 * h02) AS det FROM (
SELECT fold, step, b0, b1, b2, sum(v) AS h00, sum(v * q) AS h01, sum(v * d) AS h02, sum(v * q * q) AS h11, sum(v * q * d) AS h12, sum(v * d * d) AS h22, sum(y - p) AS g0, sum((y - p) * q) AS g1, sum((y - p) * d) AS g2
FROM (SELECT *, p * (1 - p) AS v FROM (SELECT b.*, q, d, y, 1 / (1 + exp(-(b0 + b1 * q + b2 * d))) AS p FROM b JOIN tr USING (fold) WHERE step < 9)) GROUP BY fold, step, b0, b1, b2))),
s AS (SELECT fold, y, round(1 / (1 + exp(-(b0 + b1 * q + b2 * d))), 9) AS p FROM va JOIN (SELECT * FROM b WHERE step = 9) USING (fold)),
g AS (SELECT fold, p, sum(y)::DOUBLE AS e, sum(1 - y)::DOUBLE AS o FROM s GROUP BY fold, p), c AS (SELECT *, sum(o) OVER (PARTITION BY fold ORDER BY p) AS co, sum(e) OVER (PARTITION BY fold) AS te, sum(o) OVER (PARTITION BY fold) AS tot FROM g),
v AS (SELECT fold, 'brier' AS metric, avg((y - p) ** 2) AS value FROM s GROUP BY fold UNION ALL SELECT fold, 'auc', sum(e * (co - o / 2)) / any_value(te * tot) FROM c GROUP BY fold),
n AS (SELECT fold, count(*) AS n_train FROM tr GROUP BY fold), k AS (SELECT fold, count(*) AS n_valid FROM va GROUP BY fold)
SELECT fold, n_train, n_valid, metric, round(value, 5) AS value FROM v JOIN n USING (fold) JOIN k USING (fold)"""


@query("cross_validation", NEWTON_SQL)
def cross_validation(spark, sf_dir):
    made = rl.cross_validate(rl.linear("y", ["q", "d"], loss=rl.logistic()), model_frame(spark, sf_dir), rl.expanding_window("t", 2, "365 days"), {"brier": rl.brier_score, "auc": rl.auc})
    return rounded(made.summary(spark), 5)


FOLDS = f"""WITH m AS ({MODEL_FRAME}), z AS (SELECT min(t) AS t0 FROM m), f AS (SELECT CAST(k AS INT) AS fold, t0 + 365 * (1 + k) * INTERVAL 1 DAY AS e FROM z, range(2) r(k)),
a AS (SELECT fold, any_value(e) AS e, count(*) AS n_train, regr_slope(price, q) AS b, regr_intercept(price, q) AS c, stddev_pop(q) AS sd, covar_pop(q, price) / stddev_pop(q) AS r, avg(q) AS mx, avg(price) AS my FROM m, f WHERE t <= e GROUP BY fold)"""


@query("cross_validation_1d", FOLDS + " SELECT fold, any_value(n_train) AS n_train, count(*) AS n_valid, 'mean_squared' AS metric, round(avg((price - c - b * q) ** 2), 6) AS value FROM m, a WHERE t > e AND t <= e + INTERVAL 365 DAY GROUP BY fold")
def cross_validation_1d(spark, sf_dir):
    return rounded(rl.cross_validate(rl.linear("price", "q"), model_frame(spark, sf_dir), rl.expanding_window("t", 2, "365 days", min_train="365 days"), {"mean_squared": mean_squared}).summary(spark))


@query("tune_curve_1d", FOLDS + """, p AS (SELECT a.*, lam, sign(r) * greatest(abs(r) - lam, 0) / sd AS slope FROM a, (VALUES (0.001::DOUBLE), (0.004::DOUBLE), (5.0::DOUBLE)) l(lam)),
v AS (SELECT lam, fold, avg((price - my - slope * (q - mx)) ** 2) AS mse FROM m, p WHERE t > e AND t <= e + INTERVAL 365 DAY GROUP BY lam, fold), g AS (SELECT lam, avg(mse) AS mean, stddev_samp(mse) AS sd FROM v GROUP BY lam)
SELECT CAST(row_number() OVER (ORDER BY lam) - 1 AS INT) AS point, round(mean, 6) AS metric_mean, round(sd, 6) AS metric_sd, mean = min(mean) OVER () AS chosen FROM g""")
def tune_curve_1d(spark, sf_dir):
    made = rl.tune(lambda lam: rl.linear("price", "q", penalty=rl.l1(lam)), {"lam": [0.001, 0.004, 5.0]}, model_frame(spark, sf_dir), rl.expanding_window("t", 2, "365 days", min_train="365 days"), mean_squared, direction="min")
    return rounded(made.curve_df(spark).drop("params"))


# Reports

GROUP_SQL = " SELECT {by}, count(*) AS n_obs, CAST(sum(y) AS BIGINT) AS n_events, round(any_value(auc), 6) AS auc, round(any_value(ks), 6) AS ks, round(avg((y - s) ** 2), 6) AS brier, round(avg(s), 6) AS mean_p FROM m JOIN (SELECT {by}, sum(p * (cn - n / 2)) / any_value(tp * tn) AS auc, max(abs(cp / tp - cn / tn)) AS ks FROM r GROUP BY {by}) USING ({by}) GROUP BY {by}"


@query("perf_by_segment", FRAME + RANK_SQL.format(by="seg,", w="1::DOUBLE", part="seg") + GROUP_SQL.format(by="seg"))
def perf_by_segment(spark, sf_dir):
    return rounded(reports.grouped(scores(spark, sf_dir, False, "s", "seg"), "seg").drop("log_loss", reports.TOTAL))


TOTAL_SQL = FRAME.replace("WITH m", "WITH a") + ", m AS (SELECT concat('0', NULLIF(seg, 'O')) AS g, y, s, w FROM a UNION ALL SELECT '1', y, s, w FROM a)" + RANK_SQL.format(by="g,", w="1::DOUBLE", part="g") + GROUP_SQL.format(by="g")


@query("perf_by_segment_total", f"SELECT NULLIF(g[2:], '') AS seg, g[1] = '1' AS is_total, n_obs, n_events, auc, ks, brier, mean_p FROM ({TOTAL_SQL})")
def perf_by_segment_total(spark, sf_dir):
    """Segments, one of which is null, and the row over all of them."""
    frame = scores(spark, sf_dir, False, "s", "seg").withColumn("seg", F.expr("nullif(seg, 'O')"))
    return rounded(reports.grouped(frame, "seg", True).withColumn("is_total", F.col(reports.TOTAL) == 1).drop("log_loss", reports.TOTAL))


#: Figures of every supplier's rows; slopes by Newton steps of all suppliers at once.
REPORTS_SQL = """WITH RECURSIVE m AS (SELECT l_suppkey AS key, CAST(l_returnflag = 'R' AS INT) AS y, ROUND(CAST(l_quantity AS DOUBLE) / CAST(51 AS DOUBLE), 6) AS s, l_orderkey, l_linenumber, l_partkey, l_extendedprice FROM lineitem),
g AS (SELECT key, s, sum(y)::DOUBLE AS p, sum(1 - y)::DOUBLE AS n FROM m GROUP BY key, s),
r AS (SELECT *, sum(p) OVER k AS cp, sum(n) OVER k AS cn, sum(p) OVER (PARTITION BY key) AS tp, sum(n) OVER (PARTITION BY key) AS tn FROM g WINDOW k AS (PARTITION BY key ORDER BY s)),
v AS (SELECT *, (cn - n / 2) / tn AS below, (tp - cp + p / 2) / tp AS above FROM r),
a AS (SELECT key, sum(p * below) / any_value(tp) AS auc, max(abs(cp / tp - cn / tn)) AS ks, (sum(p * below * below) - sum(p * below) ** 2 / any_value(tp)) / (any_value(tp) - 1) / any_value(tp) + (sum(n * above * above) - sum(n * above) ** 2 / any_value(tn)) / (any_value(tn) - 1) / any_value(tn) AS var FROM v GROUP BY key),
f AS (SELECT key, count(*) AS n_obs, sum(y) AS n_events, avg((y - s) ** 2) AS brier, avg(s) AS mean, min(s) AS least, max(s) AS largest, quantile_cont(s, 0.5) AS median,
    (avg(s) FILTER (y = 1) - avg(s) FILTER (y = 0)) / sqrt(((count(*) FILTER (y = 1) - 1) * var_samp(s) FILTER (y = 1) + (count(*) FILTER (y = 0) - 1) * var_samp(s) FILTER (y = 0)) / (count(*) - 2)) AS cohens_d FROM m GROUP BY key),
e AS (SELECT key, sum(n * abs(o - p)) / sum(n) AS ece FROM (SELECT key, bin, avg(s) AS p, avg(y) AS o, count(*) AS n FROM (SELECT key, s, y, least(floor((row_number() OVER (PARTITION BY key ORDER BY s, l_orderkey, l_linenumber, l_partkey, l_extendedprice) - 1) * 10 / (count(*) OVER (PARTITION BY key))::DOUBLE + 1e-12), 9) AS bin FROM m) GROUP BY key, bin) GROUP BY key),
x AS (SELECT key, ln(s / (1 - s)) AS x, p + n AS w, p AS e FROM g),
t(key, i, a, b) AS (SELECT DISTINCT key, 0, 0::DOUBLE, 0::DOUBLE FROM m UNION ALL SELECT key, i + 1, a + (g0 * h2 - g1 * h1) / (h0 * h2 - h1 * h1), b + (g1 * h0 - g0 * h1) / (h0 * h2 - h1 * h1)
    FROM (SELECT key, i, a, b, sum(v) AS h0, sum(v * x) AS h1, sum(v * x * x) AS h2, sum(e - w * q) AS g0, sum((e - w * q) * x) AS g1 FROM (SELECT *, w * q * (1 - q) AS v FROM (SELECT t.*, x.x, w, e, 1 / (1 + exp(-(a + b * x.x))) AS q FROM t JOIN x USING (key) WHERE i < 12)) GROUP BY key, i, a, b))
SELECT key, figure, round(value, 5) AS value FROM (SELECT key, unnest(['n_obs', 'n_events', 'auc', 'auc_low', 'auc_high', 'gini', 'ks', 'cohens_d', 'brier', 'ece', 'slope', 'intercept', 'mean', 'median', 'least', 'largest']) AS figure,
    unnest([n_obs, n_events, auc, greatest(auc - 1.959963984540054 * sqrt(var), 0), least(auc + 1.959963984540054 * sqrt(var), 1), 2 * auc - 1, ks, cohens_d, brier, ece, t.b, t.a, mean, median, least, largest]) AS value
    FROM f JOIN a USING (key) JOIN e USING (key) JOIN t USING (key) WHERE t.i = 12)"""


@query("perf_reports_many", REPORTS_SQL)
def perf_reports_many(spark, sf_dir):
    rows = spark.sql("SELECT l_suppkey AS key, CAST(l_returnflag = 'R' AS DOUBLE) AS y, ROUND(CAST(l_quantity AS DOUBLE) / CAST(51 AS DOUBLE), 6) AS s, CAST(1 AS DOUBLE) AS w, l_orderkey, l_linenumber, l_partkey, l_extendedprice FROM {lineitem}", lineitem=table(spark, sf_dir, "lineitem"))
    return rounded(keyed_reports.figures_of_keys(rows, None, 10, ties=TIES).filter("figure not in ('ks_at', 'log_loss')"), 5)


@query("perf_over_time", f"WITH a AS ({MODEL_FRAME}), z AS (SELECT min(t) AS t0 FROM a), m AS (SELECT a.*, CAST(k AS INT) AS \"window\" FROM a, z, range(5) r(k) WHERE t > t0 + (365 + 365 * k) * INTERVAL 1 DAY AND t <= t0 + (730 + 365 * k) * INTERVAL 1 DAY)" + RANK_SQL.format(by='"window",', w="1::DOUBLE", part='"window"') + GROUP_SQL.format(by='"window"'))
def perf_over_time(spark, sf_dir):
    rows = reports.windows(model_frame(spark, sf_dir), rl.expanding_window("t", 5, "365 days"))
    return rounded(reports.grouped(ranking.scored(rows, F.col("y"), F.col("s"), None, ("window",)), "window").drop("log_loss", reports.TOTAL))


@query("perf_report")
def perf_report(spark, sf_dir):
    df = model_frame(spark, sf_dir)
    sol = rl.solve(rl.linear("y", ["q", "d", "x"], loss=rl.logistic()), df)
    return rounded(reports.performance(sol, df, reference=df, ties=TIES).to_df(spark))


@query("perf_figures", FRAME + FLAT + mass(UP) + """, x AS (SELECT sum(p * (cn - n / 2)) / any_value(tp * tn) AS auc, max(abs(cp / tp - cn / tn)) AS ks FROM r), e AS (SELECT sum(k * abs(ob - pr)) / sum(k) AS ece FROM (SELECT avg(s) AS pr, avg(y) AS ob, count(*) AS k FROM b GROUP BY bin)),
d AS (SELECT count(*)::DOUBLE AS n_obs, sum(y)::DOUBLE AS n_events, avg((y - s) ** 2) AS brier, avg(-(y * ln(least(greatest(s, 1e-12::DOUBLE), 1 - 1e-12::DOUBLE)) + (1 - y) * ln(1 - least(greatest(s, 1e-12::DOUBLE), 1 - 1e-12::DOUBLE)))) AS log_loss, avg(s) AS mean, median(s) AS median, min(s) AS least, max(s) AS largest FROM m),
w AS (SELECT * FROM d, x, e)
SELECT figure, round(value, 6) AS value FROM (SELECT 'n_obs' AS figure, n_obs AS value FROM w UNION ALL SELECT 'n_events', n_events FROM w UNION ALL SELECT 'auc', auc FROM w UNION ALL SELECT 'gini', 2 * auc - 1 FROM w UNION ALL SELECT 'ks', ks FROM w UNION ALL SELECT 'brier', brier FROM w UNION ALL SELECT 'log_loss', log_loss FROM w UNION ALL SELECT 'ece', ece FROM w UNION ALL SELECT 'mean', mean FROM w UNION ALL SELECT 'median', median FROM w UNION ALL SELECT 'least', least FROM w UNION ALL SELECT 'largest', largest FROM w)""")
def perf_figures(spark, sf_dir):
    """The figures of a report on a score column that have a closed form in SQL."""
    out = reports.performance_of(scores(spark, sf_dir, False, "s", *TIES), ties=TIES).to_df(spark)
    return rounded(out.filter(~F.col("figure").isin("ks_at", "cohens_d", "slope", "intercept")))


@query("compare_models")
def compare_models(spark, sf_dir):
    df = model_frame(spark, sf_dir)
    fits = {n: rl.solve(rl.linear("y", f, loss=rl.logistic()), df) for n, f in (("small", ["q"]), ("large", ["q", "d", "x"]))}
    return rounded(rl.compare(fits, df).to_df(spark))


# Inspection and checks

@query("residuals", f"{FRAME}, a AS (SELECT count(*) AS n, avg(q) AS mx, regr_sxx(price, q) AS sxx, regr_slope(price, q) AS b, regr_intercept(price, q) AS c, (regr_syy(price, q) - regr_sxy(price, q) ** 2 / regr_sxx(price, q)) / (count(*) - 2) AS s2 FROM m), e AS (SELECT {IDS}, price - c - b * q AS e, 1 / n::DOUBLE + (q - mx) ** 2 / sxx AS h, s2 FROM m, a) SELECT {IDS}, round(e, 6) AS residual, round(h, 9) AS leverage, round(e * e * h / (2 * s2 * (1 - h) ** 2), 9) AS cooks_distance, round(e / sqrt(s2 * (1 - h)), 6) AS studentised FROM e")
def residuals(spark, sf_dir):
    df = model_frame(spark, sf_dir)
    out = rl.diagnostics(rl.solve(rl.linear("price", "q"), df), df)
    return out.select(*TIES, F.round("residual", 6).alias("residual"), F.round("leverage", 9).alias("leverage"), F.round("cooks_distance", 9).alias("cooks_distance"), F.round("studentised", 6).alias("studentised"))


@query("durbin_watson", f"{FRAME}, e AS (SELECT *, price - regr_intercept(price, q) OVER () - regr_slope(price, q) OVER () * q AS e FROM m), d AS (SELECT e, e - lag(e) OVER (ORDER BY t, {IDS}) AS d FROM e) SELECT round(sum(d * d) / sum(e * e), 6) AS durbin_watson FROM d")
def durbin_watson(spark, sf_dir):
    df = model_frame(spark, sf_dir)
    return one_row(spark, durbin_watson=assume.durbin_watson(rl.solve(rl.linear("price", "q"), df), df, ("t", *TIES)))


@query("vif", f"{FRAME}, c AS (SELECT corr(q, price) ** 2 AS r FROM m) SELECT 'q' AS term, round(1 / (1 - r), 6) AS vif FROM c UNION ALL SELECT 'price', round(1 / (1 - r), 6) FROM c")
def vif(spark, sf_dir):
    sol = rl.solve(rl.linear("d", ["q", "price"]), model_frame(spark, sf_dir))
    return rounded(spark.createDataFrame(list(assume.vif(sol).items()), "term string, vif double"))


@query("breusch_pagan", f"{FRAME}, e AS (SELECT q, (price - regr_intercept(price, q) OVER () - regr_slope(price, q) OVER () * q) ** 2 AS e FROM m) SELECT round(count(*) * corr(e, q) ** 2, 4) AS lm FROM e")
def breusch_pagan(spark, sf_dir):
    df = model_frame(spark, sf_dir)
    return rounded(one_row(spark, lm=assume.breusch_pagan(rl.solve(rl.linear("price", "q"), df), df)[0]), 4)


@query("assumption_report")
def assumption_report(spark, sf_dir):
    df = model_frame(spark, sf_dir)
    sol = rl.solve(rl.linear("y", [rl.woe("q", rl.manual([10, 25, 40])), "d"], loss=rl.logistic()), df, on_violation="ignore")
    return rl.check_assumptions(sol, df).to_df(spark).select("name", "severity", "passed")


@query("weighted_quantile", f"{FRAME}, g AS (SELECT s, sum(w) AS w FROM m GROUP BY s), r AS (SELECT s, (sum(w) OVER (ORDER BY s) - w / 2) / sum(w) OVER () AS pos FROM g), a AS (SELECT max(pos) AS x, arg_max(s, pos) AS v FROM r WHERE pos <= 0.3::DOUBLE), b AS (SELECT min(pos) AS x, arg_min(s, pos) AS v FROM r WHERE pos >= 0.3::DOUBLE) SELECT round(a.v + (b.v - a.v) * (0.3::DOUBLE - a.x) / (b.x - a.x), 6) AS quantile FROM a, b")
def weighted_quantile(spark, sf_dir):
    return one_row(spark, quantile=m.weighted_quantile(model_frame(spark, sf_dir), "s", "w", 0.3))


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The lift table of a logistic ridge model on weights of evidence."""
    df = model_frame(spark, sf_dir)
    spec = rl.linear("y", [rl.woe("q", rl.manual([10, 25, 40])), rl.woe("d_miss", rl.manual([0.03, 0.06])), rl.hinge("x", 0.04)], loss=rl.logistic(), penalty=rl.l2(0.01))
    sol = rl.solve(spec, df, on_violation="ignore")
    return rl.lift_table(sol, df, ties=TIES)


QUERIES["flagship_lift"] = flagship

