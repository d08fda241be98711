"""Exact top-k search by inner product over norm-sorted vectors with SVD-rotated partial sums.

Candidates are dealt once, by falling length, into bands. Every query first meets the band of the longest candidates;
its k-th score there and its own length bound the length that a better candidate must have (Cauchy-Schwarz), so it goes
on only to bands whose longest vector reaches that. A task holds the vectors of one band, and the queries stream past.
Where more than `query_rows` queries go to a band, they are dealt to blocks and the band is copied to each, so no task
has all of them; copies are `part_rows` vectors for every `query_rows` queries. Vectors of equal lengths leave nothing to
prune between bands: every query then goes to every band, a shuffle of queries times bands.
Within a band candidates go by descending length: a query is done when its length times the next candidate's can't reach
its k-th score. For the rest the first rotated components give a partial sum, and the lengths of what remains bound the
other components; only candidates whose bound reaches the k-th score get an exact integer product. The rotation comes
from the singular vectors of at most `fit_rows` candidates; it moves work, never results.

Rows: vectors that are null or hold null, NaN or infinite components take no part; vectors meet only those of their own
dimension; empty vectors score 0; equal scores go to the smaller id; repeated rows are candidates each, but one
query; different query rows that share an id share its k results; a null id takes no part; a query whose candidates are
fewer than k returns them all; an empty table gives an empty table; extra columns are ignored. Components are expected
below 2**31 after scaling, so that products fit 64 bits.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from riskloom.llm.common import materialize, shuffle_partitions

#: Bytes of a band's vectors (long ones make bands of fewer rows), its vectors, the number of bands above which bands hold more instead, and queries that meet one copy of a band.
PART_BYTES, PART_ROWS, MOST_BANDS, QUERY_ROWS = 1 << 26, 8192, 20_000, 16_384


def scaled(vectors: DataFrame, id_col: str, vector_col: str, scale: int) -> DataFrame:
    """id and vec: floor(scale * x) of every component; only vectors that are whole and finite."""
    sound = F.forall(vector_col, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    whole = F.transform(vector_col, lambda x: F.floor(F.lit(float(scale)) * x.cast("double")).cast("bigint"))
    return vectors.filter(F.col(id_col).isNotNull() & F.col(vector_col).isNotNull() & sound).select(F.col(id_col).cast("bigint").alias("id"), whole.alias("vec"))


def rotations(vectors: DataFrame, fit_rows: int) -> dict[int, np.ndarray]:
    """Singular vectors, by dimension, of a bounded sample (the smallest hashes of ids); other dimensions aren't rotated."""
    rows = vectors.orderBy(F.xxhash64("id"), "id").limit(fit_rows).select("vec").collect()
    by_dim: dict[int, list] = {}
    for (vec,) in rows:
        by_dim.setdefault(len(vec), []).append(vec)
    return {d: np.linalg.svd(np.array(v, float), full_matrices=True)[2].T for d, v in by_dim.items() if d}


def matrix(column: pa.Array, dim: int) -> np.ndarray:
    return column.flatten().to_numpy().reshape(len(column), dim)


def search(q_ids: np.ndarray, q: np.ndarray, c_ids: np.ndarray, c: np.ndarray, rotation: np.ndarray | None, k: int, exclude_own: bool, start: np.ndarray | None = None, block: int = 512) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(query's place, candidate id, score) of the k best candidates of each query. start: scores that each query needs at least."""
    dim = q.shape[1]
    head = max(1, dim // 4)
    turn = (lambda x: x.astype(float) @ rotation) if rotation is not None else lambda x: x.astype(float)
    rc, rq = turn(c), turn(q)
    norm_c, norm_q = np.sqrt((rc**2).sum(1)), np.sqrt((rq**2).sum(1))
    order = np.argsort(-norm_c, kind="stable")
    c, c_ids, rc, norm_c = c[order], c_ids[order], rc[order], norm_c[order]
    rest_c, rest_q = np.sqrt((rc[:, head:] ** 2).sum(1)), np.sqrt((rq[:, head:] ** 2).sum(1))
    small = max(np.abs(q).max(initial=0), 1) * max(np.abs(c).max(initial=0), 1) * max(dim, 1) < 2**53
    kth = np.full(len(q), -np.inf) if start is None else start.copy()
    best = (np.zeros(0, np.int64),) * 3
    for at in range(0, len(c), block):
        slack = 1e-9 * norm_q * norm_c[at] + 1e-6
        live = np.flatnonzero(norm_q * norm_c[at] + slack >= kth)
        if not len(live):
            break
        part = slice(at, at + block)
        bound = rq[live, :head] @ rc[part, :head].T + rest_q[live, None] * rest_c[None, part] + slack[live, None]
        i, j = np.nonzero(bound >= kth[live, None])
        if len(i) > 0.1 * bound.size:
            exact = (q[live].astype(float) @ c[part].astype(float).T).astype(np.int64) if small else q[live] @ c[part].T
            score = exact[i, j]
        else:
            score = np.einsum("ij,ij->i", q[live[i]], c[part][j])
        who, found = live[i], c_ids[part][j]
        keep = score >= kth[who]
        if exclude_own:
            keep &= found != q_ids[who]
        who, found, score = (np.concatenate([old, new[keep]]) for old, new in zip(best, (who, found, score)))
        rank = np.lexsort((found, -score, who))
        who, found, score = who[rank], found[rank], score[rank]
        nth = np.arange(len(who)) - np.searchsorted(who, who)
        top = nth < k
        best = who[top], found[top], score[top]
        last = nth == k - 1
        kth[who[last]] = np.maximum(kth[who[last]], score[last])
    return best


def blocked(asked: DataFrame, bands: DataFrame, query_rows: int) -> DataFrame:
    """Candidates (their query is null) and queries of every (dim, band, block); a band has a copy for each of its blocks."""
    loads = asked.groupBy("dim", "band").agg(F.ceil(F.count("*") / F.lit(query_rows)).cast("int").alias("blocks"))  # a row for each band, MOST_BANDS and the dimensions at most
    columns = ["dim", "band", "block", "query", "id", "vec", "kth"]
    copies = bands.join(F.broadcast(loads), ["dim", "band"]).withColumn("block", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    held = copies.withColumn("query", F.lit(None).cast("bigint")).withColumn("kth", F.lit(None).cast("double"))
    dealt = asked.join(F.broadcast(loads), ["dim", "band"]).withColumn("block", F.pmod(F.xxhash64("query"), F.col("blocks")).cast("int"))
    return held.select(*columns).unionByName(dealt.select(*columns))


def meet(asked: DataFrame, bands: DataFrame, turns, k: int, exclude_own: bool, query_rows: int) -> DataFrame:
    """query, query_id, vec_id, score: the k best of each query in each band that it goes to. asked: query, id, vec, dim, band, kth."""
    rows = blocked(asked, bands, query_rows).repartition(max(1, shuffle_partitions(asked.sparkSession)), "dim", "band", "block")
    rows = rows.sortWithinPartitions("dim", "band", "block", F.asc_nulls_first("query"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, ids, vectors = None, [], []
        for batch in batches:
            place = np.stack([batch["dim"].to_numpy(), batch["band"].to_numpy(), batch["block"].to_numpy(), np.asarray(batch["query"].is_null())], 1)
            cuts = [0, *(np.flatnonzero((place[1:] != place[:-1]).any(1)) + 1).tolist(), len(place)] if len(place) else [0]
            for a, b in zip(cuts[:-1], cuts[1:]):
                dim, band, block, is_candidate = place[a].tolist()
                part = batch.slice(a, b - a)
                own, x = part["id"].to_numpy(), matrix(part["vec"], dim)
                if (dim, band, block) != at:
                    at, ids, vectors = (dim, band, block), [], []
                if is_candidate:
                    ids.append(own)
                    vectors.append(x)
                elif ids:
                    ids, vectors = [np.concatenate(ids)], [np.concatenate(vectors)]
                    start = np.nan_to_num(part["kth"].to_numpy(zero_copy_only=False).astype(float), nan=-np.inf)
                    who, found, score = search(own, x, ids[0], vectors[0], turns.value.get(dim), k, exclude_own, start)
                    yield pa.record_batch([part["query"].take(pa.array(who)), pa.array(own[who], pa.int64()), pa.array(found, pa.int64()), pa.array(score, pa.int64())], ["query", "query_id", "vec_id", "score"])

    return rows.mapInArrow(run, "query bigint, query_id bigint, vec_id bigint, score bigint")


def top_k(queries: DataFrame, candidates: DataFrame, k: int, exclude_own: bool = True, fit_rows: int = 4096, part_rows: int = PART_ROWS, query_rows: int = QUERY_ROWS) -> DataFrame:
    """query_id, rank (from 1), vec_id, score. Both inputs: id and vec, as scaled() makes them."""
    length = F.sqrt(F.aggregate("vec", F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double")))
    sized = lambda rows: rows.select("id", "vec", F.size("vec").alias("dim"), length.alias("norm"))
    plain = materialize(sized(candidates), "vectors")
    total, widest = plain.agg(F.count("*"), F.coalesce(F.max("dim"), F.lit(0))).first()
    n = max(1, min(MOST_BANDS, -(-total // max(1, min(part_rows, PART_BYTES // (8 * max(1, widest)))))))
    bands = materialize(plain.repartitionByRange(n, "dim", F.desc("norm"), "id").withColumn("band", F.spark_partition_id()), "bands")
    turns = bands.sparkSession.sparkContext.broadcast(rotations(plain, fit_rows))
    tops = bands.groupBy("dim", "band").agg(F.max("norm").alias("top"))
    first = tops.groupBy("dim").agg(F.min("band").alias("band"))
    asked = materialize(sized(queries).distinct().withColumn("query", F.monotonically_increasing_id()), "queries")
    begun = asked.join(F.broadcast(first), "dim").withColumn("kth", F.lit(None).cast("double"))  # at most MOST_BANDS rows and one for each dimension
    near = materialize(meet(begun, bands.join(F.broadcast(first), ["dim", "band"], "left_semi"), turns, k, exclude_own, query_rows), "first-band")
    kth = near.groupBy("query").agg(F.when(F.count("*") >= k, F.min("score")).cast("double").alias("kth"))
    others = tops.join(first, ["dim", "band"], "left_anti")
    reach = F.col("kth").isNull() | (F.col("norm") * F.col("top") * (1 + 1e-9) + 1e-6 >= F.col("kth"))
    going = asked.join(kth, "query", "left").join(F.broadcast(others), "dim").filter(reach)
    far = meet(going, bands.join(F.broadcast(first), ["dim", "band"], "left_anti"), turns, k, exclude_own, query_rows)
    best = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return near.unionByName(far).withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
