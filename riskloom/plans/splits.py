"""Temporal splits as predicates on the time column; folds are lazily filtered frames.

Splits by position rank rows by time (then by ties) with distributed prefix counts, so no frame is sorted in one task.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from datetime import timedelta
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from riskloom.functions.ranking import release, running


def span(value) -> timedelta:
    """A timedelta, or text such as "30 days"."""
    if isinstance(value, timedelta):
        return value
    n, unit = str(value).split() if " " in str(value) else (str(value)[:-1], {"d": "days", "h": "hours", "w": "weeks"}[str(value)[-1].lower()])
    return timedelta(**{unit if unit.endswith("s") else unit + "s": float(n)})


def stamp(time_col: str) -> Column:
    return F.col(time_col).cast("timestamp")


def plus(at: Column, d: timedelta) -> Column:
    return F.timestamp_micros(F.unix_micros(at) + F.lit(round(d.total_seconds() * 1_000_000)))


def ranked(df: DataFrame, time_col: str, ties: tuple[str, ...], cuts: list[int]) -> DataFrame:
    """Adds _nth: a place that is on the same side of every cut as the row's place by time and ties, from 1. Places come from counts by time; only rows of times that a cut parts are put in order."""
    timed = df.withColumn("_at", F.coalesce(F.unix_micros(stamp(time_col)), F.lit(-(2**63))))  # null times come first
    steps = running(timed.groupBy("_at").agg(F.count("*").alias("c")), "_at", {"upto": F.col("c")})
    cuts = sorted(set(cuts))
    if not cuts:
        return df.withColumn("_nth", F.lit(1).cast("bigint"))
    below = steps.agg(*[F.max(F.when(F.col("upto") <= c, F.col("_at"))).alias(f"c{i}") for i, c in enumerate(cuts)]).first()
    parted = reduce(lambda a, b: a | b, [(F.col("upto") - F.col("c") < c) & (F.col("upto") > c) for c in cuts])
    split = {r["_at"]: (r["upto"] - r["c"], r["c"]) for r in steps.filter(parted).collect()}
    release(steps)
    passed = reduce(lambda a, b: a + b, [(F.lit(True) if x is None else F.col("_at") > F.lit(x)).cast("int") for x in below])
    nth = F.element_at(F.array(*[F.lit(c + 1).cast("bigint") for c in [0, *cuts]]), passed + 1)
    if not split:
        return timed.withColumn("_nth", nth).drop("_at")
    whole = timed.filter(~F.col("_at").isin(list(split))).withColumn("_nth", nth)
    inner = running(timed.filter(F.col("_at").isin(list(split))), "_at", {"_nth": F.lit(1)}, ("_at",), ties or tuple(c for c in df.columns if c != time_col), rows=sum(n for _, n in split.values()))
    before = reduce(lambda c, x: F.when(F.col("_at") == x[0], F.lit(x[1][0])).otherwise(c), split.items(), F.lit(0))
    return whole.unionByName(inner.withColumn("_nth", F.col("_nth") + before)).drop("_at")


def time_split(df: DataFrame, time_col: str, ratios: tuple[float, ...] = (0.7, 0.3), ties: tuple[str, ...] = ()) -> list[DataFrame]:
    """Frames of consecutive rows with shares of the row count, cut at half-even rounded places."""
    if any(r <= 0 for r in ratios) or abs(sum(ratios) - 1) > 1e-9:
        raise ValueError("ratios must be positive and sum to 1")
    n = df.count()
    cuts, total = [0], 0.0
    for r in ratios:
        total += r
        cuts.append(round(total * n))
    cuts[-1] = n
    rows = ranked(df, time_col, ties, cuts[1:-1])
    return [rows.filter((F.col("_nth") > a) & (F.col("_nth") <= b)).select(*df.columns) for a, b in zip(cuts, cuts[1:])]


@dataclass(frozen=True)
class Splitter:
    """Folds of (train, valid); assign() is the same as one long frame with fold and role."""

    time_col: str
    gap: timedelta

    def predicates(self, df: DataFrame) -> Iterator[tuple[Column, Column]]:
        raise NotImplementedError

    def split(self, df: DataFrame) -> Iterator[tuple[DataFrame, DataFrame]]:
        for train, valid in self.predicates(df):
            yield df.filter(train), df.filter(valid)

    def assign(self, df: DataFrame) -> DataFrame:
        rows = self.rows(df)
        roles = [F.when(p, F.struct(F.lit(i).alias("fold"), F.lit(role).alias("role"))) for i, pair in enumerate(self.predicates(df)) for role, p in zip(("train", "valid"), pair)]
        if not roles:
            return df.withColumns({"fold": F.lit(0), "role": F.lit("")}).limit(0)
        return rows.select(*df.columns, F.explode(F.array_compact(F.array(*roles))).alias("_r")).select(*df.columns, "_r.fold", "_r.role")

    def rows(self, df: DataFrame) -> DataFrame:
        return df

    def bounds(self, df: DataFrame) -> tuple:
        t = stamp(self.time_col)
        return df.agg(F.min(t), F.max(t)).first()


@dataclass(frozen=True)
class ExpandingWindow(Splitter):
    n_folds: int
    horizon: timedelta
    min_train: timedelta

    def predicates(self, df: DataFrame) -> Iterator[tuple[Column, Column]]:
        first, _ = self.bounds(df)
        t = stamp(self.time_col)
        for k in range(self.n_folds if first is not None else 0):
            end = first + self.min_train + k * self.horizon
            yield t <= F.lit(end), (t > F.lit(end + self.gap)) & (t <= F.lit(end + self.gap + self.horizon))


@dataclass(frozen=True)
class RollingWindow(Splitter):
    train_size: timedelta
    horizon: timedelta
    step: timedelta

    def predicates(self, df: DataFrame) -> Iterator[tuple[Column, Column]]:
        first, last = self.bounds(df)
        t, pairs = stamp(self.time_col), []
        end = first + self.train_size if first is not None else None
        while end is not None and end + self.gap + self.horizon <= last + self.step:
            pairs.append(((t > F.lit(end - self.train_size)) & (t <= F.lit(end)), (t > F.lit(end + self.gap)) & (t <= F.lit(end + self.gap + self.horizon))))
            end = end + self.step
        if not pairs:
            return
        sizes = df.agg(*[F.sum(p.cast("int")).alias(f"c{i}_{j}") for i, pair in enumerate(pairs) for j, p in enumerate(pair)]).first()
        yield from (pair for i, pair in enumerate(pairs) if sizes[f"c{i}_0"] and sizes[f"c{i}_1"])


@dataclass(frozen=True)
class PurgedKFold(Splitter):
    """Buckets of equal row counts by time; training rows keep the gap on both sides of the validation span."""

    n_folds: int
    ties: tuple[str, ...] = ()

    def rows(self, df: DataFrame) -> DataFrame:
        return ranked(df, self.time_col, self.ties, self.cuts(df.count())[1:-1])

    def cuts(self, n: int) -> list[int]:
        return [int(n * k / self.n_folds) for k in range(self.n_folds + 1)]

    def split(self, df: DataFrame) -> Iterator[tuple[DataFrame, DataFrame]]:
        rows = self.rows(df)
        for train, valid in self.predicates(df):
            yield rows.filter(train).select(*df.columns), rows.filter(valid).select(*df.columns)

    def predicates(self, df: DataFrame) -> Iterator[tuple[Column, Column]]:
        rows, n = self.rows(df), df.count()
        cuts = self.cuts(n)
        bucket = reduce(lambda c, b: c + (F.col("_nth") > b).cast("int"), cuts[1:-1], F.lit(0))
        t = stamp(self.time_col)
        for r in rows.groupBy(bucket.alias("b")).agg(F.min(t).alias("lo"), F.max(t).alias("hi")).orderBy("b").collect():
            valid = (F.col("_nth") > cuts[r.b]) & (F.col("_nth") <= cuts[r.b + 1])
            yield (t < F.lit(r.lo - self.gap)) | (t > F.lit(r.hi + self.gap)), valid


def positive(name: str, d: timedelta, zero: bool = False) -> timedelta:
    if d < timedelta(0) or not zero and d == timedelta(0):
        raise ValueError(f"{name} must be positive")
    return d


def expanding_window(time_col: str, n_folds: int, horizon, gap="0 days", min_train=None) -> ExpandingWindow:
    if n_folds < 1:
        raise ValueError("one fold at least")
    h = positive("horizon", span(horizon))
    return ExpandingWindow(time_col, positive("gap", span(gap), True), n_folds, h, positive("min_train", span(min_train)) if min_train is not None else h)


def rolling_window(time_col: str, train_size, horizon, step=None, gap="0 days") -> RollingWindow:
    h = positive("horizon", span(horizon))
    return RollingWindow(time_col, positive("gap", span(gap), True), positive("train_size", span(train_size)), h, positive("step", span(step)) if step is not None else h)


def purged_kfold(time_col: str, n_folds: int, gap="0 days", ties: tuple[str, ...] = ()) -> PurgedKFold:
    if n_folds < 2:
        raise ValueError("two folds at least")
    return PurgedKFold(time_col, positive("gap", span(gap), True), n_folds, ties)
