"""Prefix sums over an ordered column, and what is read off them: rank curve, equal-mass bins, lift and gains.

A window over all rows in one order would end in one task. Here rows are range-partitioned by the order, its ties
included, and written once with the number of their partition; totals of earlier partitions come from one small
aggregate, and windows run inside partitions. Spark samples the ranges, so their number follows the session's shuffle
partitions and a value that many rows share is split.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from riskloom.sources.store import discard, stored


#: Rows of a range where their number is known.
RANGE_ROWS = 1_000_000


def scored(df: DataFrame, y: Column, s: Column, w: Column | None = None, keep: tuple[str, ...] = ()) -> DataFrame:
    """y, s, w: the columns that all metrics read."""
    return df.select(y.cast("double").alias("y"), s.cast("double").alias("s"), (F.lit(1.0) if w is None else w.cast("double")).alias("w"), *keep)


def running(df: DataFrame, order: str, sums: dict[str, Column], by: tuple[str, ...] = (), ties: tuple[str, ...] = (), descending: bool = False, whole: bool = False, rows: int | None = None) -> DataFrame:
    """Adds inclusive running sums in the order of a column (then of ties) within each group `by`; with whole, also each sum over the group, as all_<name>. rows: how many there are, where known, so that no range holds many more than RANGE_ROWS."""
    first = F.col(order).desc() if descending else F.col(order).asc()
    keys = [*by, first, *ties, "_nth"]
    dealt = df.select("*", F.monotonically_increasing_id().alias("_nth"))
    least = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = dealt.repartitionByRange(n, *keys) if rows is not None and (n := -(-rows // RANGE_ROWS)) > least else dealt.repartitionByRange(*keys)
    dealt = stored(dealt.withColumn("_part", F.spark_partition_id()), "ranges")
    totals = dealt.groupBy(*by, "_part").agg(*[F.sum(c).alias(f"_{n}") for n, c in sums.items()])
    group = Window.partitionBy(*by)  # a row for each partition and group
    before = group.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    ends = [F.sum(f"_{n}").over(group).alias(f"all_{n}") for n in sums] if whole else []
    totals = totals.select(*[F.col(c).alias(f"_of_{c}") for c in by], F.col("_part").alias("_of"), *[F.coalesce(F.sum(f"_{n}").over(before), F.lit(0)).alias(f"_{n}") for n in sums], *ends)
    inside = Window.partitionBy(*by, "_part").orderBy(first, *ties, "_nth").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    same = F.col("_part") == F.col("_of")
    for c in by:
        same = same & F.col(c).eqNullSafe(F.col(f"_of_{c}"))
    out = dealt.join(totals, same)
    out = out.select(*df.columns, *[(F.col(f"_{n}") + F.sum(c).over(inside)).alias(n) for n, c in sums.items()], *([f"all_{n}" for n in sums] if whole else []))
    out._ranges = dealt  # for release()
    return out


def release(ranked: DataFrame) -> None:
    """Deletes the ranges that running() has stored for a frame; nothing may read it any more."""
    discard(ranked._ranges)


def rank_curve(frame: DataFrame, by: tuple[str, ...] = ()) -> DataFrame:
    """A row for each distinct score: masses p and n of events and others, their running sums cp and cn, and totals all_cp and all_cn."""
    return curve_of(frame.groupBy(*by, "s").agg(*class_masses()), by)


def class_masses() -> list[Column]:
    return [F.sum(F.col("w") * F.col("y")).alias("p"), F.sum(F.col("w") * (1 - F.col("y"))).alias("n")]


def curve_of(masses: DataFrame, by: tuple[str, ...]) -> DataFrame:
    return running(masses, "s", {"cp": F.col("p"), "cn": F.col("n")}, by, whole=True)


def discrimination(frame: DataFrame, by: tuple[str, ...] = ()) -> DataFrame:
    """auc, gini, ks and the smallest score that attains ks, for each group; null where a class is missing."""
    return discrimination_of(rank_curve(frame, by), by)


def discrimination_of(curve: DataFrame, by: tuple[str, ...]) -> DataFrame:
    curve = curve.filter("all_cp > 0 and all_cn > 0")
    gap = F.abs(F.col("cp") / F.col("all_cp") - F.col("cn") / F.col("all_cn"))
    area = F.sum(F.col("p") * (F.col("cn") - F.col("n") / 2)) / (F.first("all_cp") * F.first("all_cn"))
    top = F.max(F.struct(gap.alias("gap"), (-F.col("s")).alias("minus")))
    out = curve.groupBy(*by).agg(area.alias("auc"), top["gap"].alias("ks"), (-top["minus"]).alias("ks_at"))
    return out.select(*by, "auc", (2 * F.col("auc") - 1).alias("gini"), "ks", "ks_at")


def mass_bins(frame: DataFrame, n_bins: int, ties: tuple[str, ...] = (), descending: bool = False, by: tuple[str, ...] = ()) -> DataFrame:
    """Adds bin: floor(weight before the row * n_bins / all weight + 1e-12), so bins hold equal mass."""
    ranked = running(frame, "s", {"cw": F.col("w")}, by, ties, descending, whole=True)
    share = (F.col("cw") - F.col("w")) * F.lit(float(n_bins)) / F.col("all_cw") + F.lit(1e-12)
    return ranked.withColumn("bin", F.least(F.floor(share).cast("int"), F.lit(n_bins - 1))).drop("all_cw")


def bin_sums(frame: DataFrame, n_bins: int, ties: tuple[str, ...] = (), descending: bool = False, by: tuple[str, ...] = ()) -> DataFrame:
    """by, bin and the sums w, ws and wy of its rows, by the bins of mass_bins(). Without groups, a score whose rows are all in one bin counts as one mass; only rows of scores that the edge of a bin cuts (fewer than n_bins scores) are put in order."""
    w, sums = F.col("w"), ("w", "ws", "wy")
    parts = [w, (w * F.col("s")).alias("ws"), (w * F.col("y")).alias("wy")]
    total = [F.sum(c).alias(c) for c in sums]
    if by:
        return mass_bins(frame, n_bins, ties, descending, by).select(*by, "bin", *parts).groupBy(*by, "bin").agg(*total)
    masses = frame.select("s", *parts).groupBy("s").agg(*total, F.min("w").alias("least"), F.count("*").alias("rows"))
    steps = running(masses, "s", {"cw": w}, (), (), descending, whole=True)
    bin_of = lambda before: F.least(F.floor(before * F.lit(float(n_bins)) / F.col("all_cw") + F.lit(1e-12)).cast("int"), F.lit(n_bins - 1))
    steps = steps.withColumn("before", F.col("cw") - w).withColumns({"bin": bin_of(F.col("before")), "last": bin_of(F.col("cw") - F.col("least"))})
    cut = steps.filter("bin < last").select("s", "before", "all_cw", "rows").collect()
    whole = steps.filter("bin >= last or bin is null").select("bin", *sums)
    if not cut:
        return whole.groupBy("bin").agg(*total)
    starts = F.broadcast(frame.sparkSession.createDataFrame([tuple(r)[:3] for r in cut], "_s double, before double, all_cw double"))
    rows = frame.select("s", "y", "w", *ties).join(starts, F.col("s").eqNullSafe(F.col("_s")))
    inner = running(rows, "s", {"cw": w}, ("_s",), ties, descending, rows=sum(r["rows"] for r in cut))
    inner = inner.withColumn("bin", bin_of(F.col("before") + F.col("cw") - w)).select("bin", *parts)
    return whole.unionByName(inner).groupBy("bin").agg(*total)


def calibration_bins(frame: DataFrame, n_bins: int = 10, ties: tuple[str, ...] = (), by: tuple[str, ...] = ()) -> DataFrame:
    """bin, predicted, observed, n. Without groups every bin has a row: an empty one has n = 0 and NaN figures."""
    rows = bin_sums(frame, n_bins, ties, by=by).select(*by, "bin", (F.col("ws") / F.col("w")).alias("predicted"), (F.col("wy") / F.col("w")).alias("observed"), F.col("w").alias("n"))
    if by:
        return rows
    bins = frame.sparkSession.range(n_bins).select(F.col("id").cast("int").alias("bin"))
    return bins.join(rows, "bin", "left").fillna(float("nan"), ["predicted", "observed"]).fillna(0.0, ["n"])


def lift_bins(frame: DataFrame, n_deciles: int = 10, ties: tuple[str, ...] = ()) -> DataFrame:
    """decile (1 holds the highest scores), mean_score, event_rate, lift, captured_response, n."""
    rows = bin_sums(frame, n_deciles, ties, descending=True).select((F.col("bin") + 1).alias("decile"), F.col("w").alias("n"), F.col("wy").alias("e"), F.col("ws").alias("t"))
    order = Window.orderBy("decile")  # a row for each decile
    every = Window.partitionBy(F.lit(1))
    events, mass = F.sum("e").over(every), F.sum("n").over(every)
    return rows.select("decile", (F.col("t") / F.col("n")).alias("mean_score"), (F.col("e") / F.col("n")).alias("event_rate"), ((F.col("e") / F.col("n")) / (events / mass)).alias("lift"), (F.sum("e").over(order) / events).alias("captured_response"), "n")


def gains(frame: DataFrame, ties: tuple[str, ...] = ()) -> DataFrame:
    """A point for each row and the origin: share of rows taken and share of events captured, from the highest score."""
    ranked = running(frame, "s", {"cw": F.col("w"), "ce": F.col("w") * F.col("y")}, (), ties, True, whole=True)
    points = ranked.select((F.col("cw") / F.col("all_cw")).alias("share"), F.when(F.col("all_ce") > 0, F.col("ce") / F.col("all_ce")).otherwise(float("nan")).alias("captured"))
    origin = frame.sparkSession.range(1).select(F.lit(0.0).alias("share"), F.lit(0.0).alias("captured"))
    return points.unionByName(origin)


def stability(reference: DataFrame, current: DataFrame, edges: list[float], eps: float = 1e-6) -> DataFrame:
    """bin, shares of both frames (of s and w) in [a, b), eps at least, and the bin's part of the population stability index."""
    at = F.lit(0)
    for e in edges:
        at = at + (F.col("s") >= F.lit(float(e))).cast("int")
    both = reference.select("s", F.col("w").alias("o"), F.lit(0.0).alias("c")).unionByName(current.select("s", F.lit(0.0).alias("o"), F.col("w").alias("c")))
    rows = both.groupBy(at.alias("bin")).agg(F.sum("o").alias("o"), F.sum("c").alias("c"))
    bins = reference.sparkSession.range(len(edges) + 1).select(F.col("id").cast("int").alias("bin"))
    rows = bins.join(rows, "bin", "left").fillna(0)
    every = Window.partitionBy(F.lit(1))  # a row for each bin
    share = lambda c: F.greatest(F.col(c) / F.sum(c).over(every), F.lit(eps))
    rows = rows.select("bin", share("o").alias("reference"), share("c").alias("current"))
    return rows.withColumn("part", (F.col("current") - F.col("reference")) * F.log(F.col("current") / F.col("reference")))
