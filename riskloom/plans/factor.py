"""Distributed least-squares factors.

Every fit reduces to the triangular factor R of sqrt(w) * [1, x, z]: tasks factor their rows block by block, factors
are stacked and factored again, first for 64 neighbouring tasks at a time, then on the driver, which gets a few small matrices for each
group (a fold, a segment or the whole). R has the accuracy of a QR of all rows, gives the centred cross-products
(the part right of and below the constant), residual sums, and the rank. Iterative fits pass their coefficients in; a
task turns them into working weights and responses for its rows.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SCHEMA = "grp string, lot int, n bigint, extra binary, r binary"
#: (eta, y) -> (factor on the weight, working response, further sums)
Working = Callable[[np.ndarray, np.ndarray], tuple[np.ndarray, np.ndarray]]


@dataclass(frozen=True)
class Factor:
    """n rows; total: sum of weights; r: triangular factor of [1, x, z]; extra: sums of (y, y*y, w*w, wy, least y, largest y)."""

    n: int
    r: np.ndarray
    sw: float
    sy: float
    least: float
    largest: float

    @property
    def p(self) -> int:
        return self.r.shape[0] - 2

    def centred(self) -> tuple[np.ndarray, np.ndarray, np.ndarray, float, float]:
        """(X'WX, X'Wz, means of x, mean of z, z'Wz), all but the means centred."""
        inner = self.r[1:, 1:]
        gram = inner.T @ inner
        means = self.r[0, 1:] / self.r[0, 0]
        return gram[:-1, :-1], gram[:-1, -1], means[:-1], float(means[-1]), float(gram[-1, -1])


def design(df: DataFrame, columns: list[tuple[str, Column]], target: str, weights: str | None, group: Column | None = None) -> DataFrame:
    """grp, x (array), y, w: all that a fit reads."""
    w = F.col(weights).cast("double") if weights else F.lit(1.0)
    grp = group.cast("string") if group is not None else F.lit("")
    return df.select(grp.alias("grp"), F.array(*[c for _, c in columns]).alias("x"), F.col(target).cast("double").alias("y"), w.alias("w"))


def blocks(batch: pa.RecordBatch, p: int) -> Iterator[tuple[str, np.ndarray, np.ndarray, np.ndarray]]:
    """(group, x, y, w) of the rows of a batch; null components become NaN."""
    x = batch["x"].flatten().to_numpy(zero_copy_only=False).reshape(-1, p)
    y, w = (batch[c].to_numpy(zero_copy_only=False) for c in ("y", "w"))
    names = batch["grp"].dictionary_encode()
    code = names.indices.to_numpy(zero_copy_only=False)
    for i, name in enumerate(names.dictionary.to_pylist()):
        rows = code == i
        yield name, (x if rows.all() else x[rows]), (y if rows.all() else y[rows]), (w if rows.all() else w[rows])


def stack(a: np.ndarray | None, b: np.ndarray) -> np.ndarray:
    r = np.linalg.qr(b if a is None else np.concatenate([a, b]), mode="r")
    if r.shape[0] < r.shape[1]:
        r = np.concatenate([r, np.zeros((r.shape[1] - r.shape[0], r.shape[1]))])
    return r


class NonFinite(ValueError):
    pass


class Held:
    """What a task has of a group: rows wait until they are worth factoring, then join the triangular factor."""

    def __init__(self):
        self.n, self.r, self.waiting, self.rows = 0, None, [], 0
        self.sums, self.least, self.largest = np.zeros(2), np.inf, -np.inf

    def add(self, block: np.ndarray, y: np.ndarray, w: np.ndarray) -> None:
        self.waiting.append(block)
        self.rows, self.n = self.rows + len(block), self.n + len(block)
        self.sums = self.sums + [w.sum(), (w * y).sum()]
        self.least, self.largest = min(self.least, y.min()), max(self.largest, y.max())
        if self.rows >= 2 * block.shape[1]:
            self.settle()

    def settle(self) -> None:
        if self.waiting:
            self.r = stack(self.r, np.concatenate(self.waiting))
            self.waiting, self.rows = [], 0


def grouped_factors(rows: DataFrame, p: int, lots: int = 4) -> DataFrame:
    """Factors of many groups as rows of SCHEMA, some for each group: rows meet by group and lot, so a task holds one group at a time, whatever their number."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, own = None, Held()
        row = lambda: (*key, own.n, np.array([*own.sums, own.least, own.largest]), own.r)
        for batch in batches:
            if not batch.num_rows:
                continue
            out = []
            x = batch["x"].flatten().to_numpy(zero_copy_only=False).reshape(-1, p)
            y, w, lot = (batch[c].to_numpy(zero_copy_only=False) for c in ("y", "w", "lot"))
            check_finite(x, y, w)
            block = np.concatenate([np.ones((len(x), 1)), x, y[:, None]], 1) * np.sqrt(w)[:, None]
            code = batch["grp"].dictionary_encode().indices.to_numpy(zero_copy_only=False)
            starts = np.flatnonzero(np.concatenate([[True], (np.diff(code) != 0) | (np.diff(lot) != 0)]))
            names = batch["grp"].take(pa.array(starts)).to_pylist()
            for name, a, b in zip(names, starts.tolist(), [*starts[1:].tolist(), len(x)]):
                if (name, int(lot[a])) != key:
                    if key is not None:
                        own.settle()
                        out.append(row())
                    key, own = (name, int(lot[a])), Held()
                own.add(block[a:b], y[a:b], w[a:b])
            yield packed(out)
        if key is not None:
            own.settle()
            yield packed([row()])

    dealt = rows.select("grp", "x", "y", "w", F.pmod(F.xxhash64("x", "y"), F.lit(lots)).cast("int").alias("lot"))
    return dealt.repartition("grp", "lot").sortWithinPartitions("grp", "lot").mapInArrow(run, SCHEMA)


def check_finite(x: np.ndarray, y: np.ndarray, w: np.ndarray) -> None:
    bad = ~np.isfinite(x).all(0)
    if bad.any() or not np.isfinite(y).all() or not np.isfinite(w).all():
        what = ", ".join(f"#{j}" for j in np.flatnonzero(bad)) or "target or weight"
        raise NonFinite(f"missing or infinite values in {what}")


def compacted(rows: DataFrame) -> DataFrame:
    """Design rows for many passes: where equal ones are frequent (a tenth are distinct at most) each is kept once, with its weights added and the number of rows in times."""
    n, distinct = rows.agg(F.count("*"), F.approx_count_distinct(F.xxhash64("grp", "x", "y", "w"))).first()
    if 10 * distinct > n:
        return rows
    return rows.groupBy("grp", "x", "y", "w").agg(F.count("*").alias("times")).select("grp", "x", "y", (F.col("w") * F.col("times")).alias("w"), "times")


def factors(rows: DataFrame, p: int, betas: dict[str, np.ndarray] | None = None, working: Working | None = None, most: int = 64) -> dict[str, Factor]:
    """The factor of every group. betas: coefficients (intercept first) by group, for iterative fits. Factors of `most` neighbouring tasks are merged in a task; the driver merges what is left."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[str, Held] = {}
        for batch in batches:
            for name, x, y, w in blocks(batch, p):
                check_finite(x, y, w)
                z, v = y, w
                if working is not None:
                    if name not in betas:
                        continue
                    beta = betas[name]
                    scale, z = working(beta[0] + x @ beta[1:], y)
                    v = w * scale
                root = np.sqrt(v)[:, None]
                if name not in held:
                    held[name] = Held()
                held[name].add(np.concatenate([np.ones((len(x), 1)), x, z[:, None]], 1) * root, y, w)
            if "times" in batch.schema.names:
                for name, times in zip(batch["grp"].to_pylist(), batch["times"].to_pylist()):
                    if name in held:
                        held[name].n += times - 1
        for own in held.values():
            own.settle()
        lot = TaskContext.get().partitionId() // most
        names = list(held)
        yield pa.record_batch([pa.array(names, pa.string()), pa.array([lot] * len(names), pa.int32()), pa.array([held[k].n for k in names], pa.int64()), pa.array([np.array([*held[k].sums, held[k].least, held[k].largest]).tobytes() for k in names], pa.binary()), pa.array([held[k].r.tobytes() for k in names], pa.binary())], ["grp", "lot", "n", "extra", "r"])

    def join(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, own = None, []
        for batch in batches:
            out = []
            for row in zip(*(batch[c].to_pylist() for c in ("grp", "lot", "n", "extra", "r"))):
                if row[:2] != key:
                    if own:
                        out.append((*key, *merged(own, p)))
                    key, own = row[:2], []
                own.append(row[2:])
            yield packed(out)
        yield packed([(*key, *merged(own, p))] if own else [])

    dealt = rows.mapInArrow(run, SCHEMA).repartition("grp", "lot").sortWithinPartitions("grp", "lot")
    parts: dict[str, list] = {}
    for r in dealt.mapInArrow(join, SCHEMA).collect():
        parts.setdefault(r.grp, []).append((r.n, r.extra, r.r))
    out = {}
    for name in sorted(parts):
        n, extra, r = merged(parts[name], p)
        out[name] = Factor(n, r, *map(float, extra))
    return out


def packed(rows: list[tuple]) -> pa.RecordBatch:
    kinds = (pa.string(), pa.int32(), pa.int64(), pa.binary(), pa.binary())
    return pa.record_batch([pa.array([x.tobytes() if isinstance(x := r[i], np.ndarray) else x for r in rows], k) for i, k in enumerate(kinds)], ["grp", "lot", "n", "extra", "r"])


def merged(parts: list[tuple[int, bytes, bytes]], p: int) -> tuple[int, np.ndarray, np.ndarray]:
    """(n, extra, r) of several."""
    r = np.concatenate([np.frombuffer(x[2]).reshape(p + 2, p + 2) for x in parts])
    e = np.array([np.frombuffer(x[1]) for x in parts])
    return sum(x[0] for x in parts), np.array([e[:, 0].sum(), e[:, 1].sum(), e[:, 2].min(), e[:, 3].max()]), stack(None, r) if len(parts) > 1 else r


def dependent(r: np.ndarray, n: int) -> list[int]:
    """Columns of a triangular factor that earlier ones determine (pivoted QR, relative to the largest column)."""
    a = r.copy()
    p = a.shape[1]
    order, rank = list(range(p)), 0
    first = None
    for k in range(p):
        size = (a[k:, k:] ** 2).sum(0)
        j = k + int(size.argmax())
        a[:, [k, j]], order[k], order[j] = a[:, [j, k]], order[j], order[k]
        v = a[k:, k].copy()
        length = np.linalg.norm(v)
        first = length if first is None else first
        if length <= max(n, p) * np.finfo(float).eps * first:
            break
        rank += 1
        v[0] += np.copysign(length, v[0])
        v /= np.linalg.norm(v)
        a[k:, k:] -= 2 * np.outer(v, v @ a[k:, k:])
    return sorted(order[rank:])
