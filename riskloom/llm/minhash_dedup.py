"""Near-duplicate documents by DartMinHash signatures, banded joins and exact verification.

Each document is a weighted set of shingles of five words; a shingle that occurs c times weighs 1 + log2(c) / 4. Hashed
darts are thrown into the plane of weight and rank above every shingle: a unit cell holds a Poisson number of them, each
with a coordinate, a rank and a weight, all derived from the hash of shingle and cell. Of the darts below a shingle's
weight the earliest of each coordinate is kept, so two documents agree in a coordinate with the probability of their
weighted Jaccard similarity. About k ln k + 2k darts are thrown for a document whatever its length; rows of cells are
added until each coordinate has a dart. Links are judged by plain sets, so a document with a repeated shingle also gets
the signature in which all weights are 1: repetition alone never parts it from a document that it resembles.

Signatures are cut into bands. Documents with equal shingle sets are one from the start. In every bucket of equal bands
all members are compared with two pivots, the smallest and the largest id; pairs with a similarity of at least
`threshold` by their exact sets of 64-bit shingle hashes become links. In buckets that still hold members of different
classes all members of different classes are compared, so no link between documents that share a bucket is lost: a
bucket of at most SMALL members is compared in one partition; larger ones are joined to clusters where they share
members, so that a pair which shares many buckets is compared once, and a cluster is dealt into blocks of about BLOCK
documents and SHINGLES shingles. Every pair of blocks is a task's piece of work; of the links that a piece finds it hands
out a spanning forest of the classes. A class larger than a block has blocks of its own, which are not compared with each
other. Memory is bounded by two blocks; comparisons grow with the square of a cluster, as the exact answer does. Two
documents of a similarity s share a band with 1 - (1 - s^5)^24, all but 7e-5 at 0.8. Classes are the connected components.

Only signatures are kept of all documents; shingle sets are made again for those that share a bucket. A pivot with many
members is copied to as many keys as it has SALTED members, so no task holds all of a large cluster.

Rows: repeated rows are in one class; texts of one to four words are a single shingle; null, empty and wordless texts
are in a class only with equal texts (null counts as empty); very long texts are hashed in parts of PART bytes, with the
same shingles; a null id is in no class (class_id null); rows that share an id are one document, whose class joins those
of all its texts; an empty table gives an empty table; extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from riskloom.llm.common import discard, materialize, short_batches, slices, utf8

WORDS = 5
THRESHOLD = 0.8
COORDINATES, ROWS = 120, 5
PART = 1 << 20
#: Buckets of so many members are compared whole; larger ones in pairs of blocks of about so many documents and shingles.
SMALL, BLOCK, SHINGLES = 64, 1024, 1 << 20
#: Members of a pivot that are compared under one key.
SALTED = 2000
#: So many ids are broadcast to select their shingle sets, of which then only those are shuffled.
BROADCAST_IDS = 1_000_000
GOLDEN = np.uint64(0x9E3779B97F4A7C15)
#: Bytes of words, A-Z as a-z; 0 for all that parts words.
WORD_BYTES = np.array([b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 0 for b in range(256)], np.uint8)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective scramble of 64-bit integers."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def unit(x: np.ndarray) -> np.ndarray:
    return (x >> np.uint64(11)).astype(np.float64) * 2.0**-53


class Shingler:
    """Hashes of all runs of so many words of a text."""

    def __init__(self, n_words: int = WORDS, part: int = PART, seed: int = 5):
        rng = np.random.default_rng(seed)
        base = int(rng.integers(2**61, 2**62)) | 1
        self.n_words, self.part, self.table = n_words, part, rng.integers(1, 2**63, 256, dtype=np.uint64)
        self.bases = base, pow(base, -1, 2**64)
        self.up = self.down = np.ones(1, np.uint64)

    def grow(self, n: int) -> None:
        if n > len(self.up):
            self.up, self.down = (np.multiply.accumulate(np.concatenate([np.ones(1, np.uint64), np.full(n - 1, b, np.uint64)])) for b in self.bases)

    def hashes(self, data: np.ndarray) -> np.ndarray:
        x = WORD_BYTES[data]
        inner = np.concatenate([[False], x[:-1] != 0])[: len(x)] & (x == 0)
        x = x[(x != 0) | inner]
        if len(x) and x[-1] != 0:
            x = np.append(x, np.uint8(0))
        ends = np.flatnonzero(x == 0)
        if not len(ends):
            return np.zeros(0, np.uint64)
        starts = np.concatenate([[0], ends[:-1] + 1])
        k = min(self.n_words, len(ends))
        out, n = [], len(ends) - k + 1
        at = 0
        while at < n:  # long texts in parts, so that memory for powers is bounded
            to = max(at + 1, min(n, int(np.searchsorted(starts, starts[at] + self.part))))
            a, b = starts[at], ends[to + k - 2]
            self.grow(int(b - a) + 1)
            total = np.zeros(b - a + 1, np.uint64)
            np.cumsum(self.table[x[a:b]] * self.up[: b - a], out=total[1:])
            s, e = starts[at:to] - a, ends[at + k - 1 : to + k - 1] - a
            out.append(mix((total[e] - total[s]) * self.down[s]))
            at = to
        return np.concatenate(out)


class DartMinHash:
    """Signatures of weighted sets."""

    def __init__(self, k: int = COORDINATES, seed: int = 1):
        self.k, self.darts = k, k * np.log(k) + 2 * k
        self.seed = mix(np.array([seed], np.uint64))[0]
        steps = np.exp(-1.0) / np.cumprod(np.concatenate([[1.0], np.arange(1, 20)]))
        self.poisson = np.cumsum(steps)

    def cells(self, elements: np.ndarray, weights: np.ndarray, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(coordinate, rank, hash) of all darts in some rows of cells that lie below the weights."""
        levels = np.ceil(weights).astype(np.int64)
        level = np.arange(levels.sum()) - np.repeat(np.cumsum(levels) - levels, levels)
        cell = np.repeat(elements, levels) ^ mix(level.astype(np.uint64) + self.seed)
        cell = mix(cell[None, :] + (rows.astype(np.uint64)[:, None] + np.uint64(1)) * GOLDEN)
        count = np.searchsorted(self.poisson, unit(cell))
        row, place = np.nonzero(count)
        n = count[row, place]
        nth = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
        row, place = np.repeat(row, n), np.repeat(place, n)
        dart = mix(cell[row, place] + nth.astype(np.uint64) * GOLDEN + np.uint64(7))
        rank = rows[row] + unit(mix(dart ^ GOLDEN))
        if (weights != levels).any():
            below = level[place] + unit(mix(dart + np.uint64(99))) < np.repeat(weights, levels)[place]
            dart, rank = dart[below], rank[below]
        return (dart % np.uint64(self.k)).astype(np.int64), rank, dart

    def signature(self, elements: np.ndarray, weights: np.ndarray) -> np.ndarray:
        best, value = np.full(self.k, np.inf), np.zeros(self.k, np.uint64)
        done, rows = 0, max(1, int(np.ceil(self.darts / weights.sum())))
        while np.isinf(best).any():
            for at in range(done, rows, step := max(1, int(1_000_000 // len(elements)))):
                j, rank, dart = self.cells(elements, weights, np.arange(at, min(rows, at + step)))
                order = np.argsort(-rank, kind="stable")
                j, rank, dart = j[order], rank[order], dart[order]
                sig, least = np.zeros(self.k, np.uint64), np.full(self.k, np.inf)
                sig[j], least[j] = dart, rank  # of equal places the last one stays: the smallest rank
                better = least < best
                best[better], value[better] = least[better], sig[better]
            done, rows = rows, 2 * rows
        return value

    def bands(self, signature: np.ndarray, rows: int = ROWS) -> np.ndarray:
        """A hash of each band."""
        places = np.arange(0, self.k, rows)
        out = mix(np.arange(len(places), dtype=np.uint64) + np.uint64(1))
        for i in range(rows):
            out = mix(out ^ signature[(places + i) % self.k]) * GOLDEN
        return out


def weights_of(counts: np.ndarray) -> np.ndarray:
    return 1 + np.log2(counts) / 4


def signatures(dart: DartMinHash, hashes: np.ndarray, weighted: bool) -> list[np.ndarray]:
    """The signature of a set and, if it has repeated elements, that of its weights."""
    h, counts = np.unique(hashes, return_counts=True)
    out = [dart.signature(h, np.ones(len(h)))] if len(h) else []
    return [*out, dart.signature(h, weights_of(counts))] if len(h) and weighted and counts.max() > 1 else out


def sketch(docs: DataFrame, k: int, rows: int, n_words: int, weighted: bool) -> DataFrame:
    """id, same (16 bytes that equal shingle sets share), n (size of the set), bands (of one signature or two)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shingler, dart = Shingler(n_words), DartMinHash(k)
        for batch in slices(batches, 512, 4 << 20):
            data, offsets = utf8(batch["text"])
            same, bands, sizes = [], [], []
            for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist()):
                hashes = shingler.hashes(data[a:b])
                distinct = np.unique(hashes)
                same.append(xxhash.xxh3_128_digest(distinct.tobytes() if len(hashes) else b"no words" + data[a:b].tobytes()))
                made = [dart.bands(x, rows) for x in signatures(dart, hashes, weighted)]
                bands.append(np.concatenate([np.zeros(0, np.uint64), *made]).view(np.int64))
                sizes.append(len(distinct))
            yield pa.record_batch([batch["id"], pa.array(same, pa.binary()), pa.array(sizes, pa.int32()), pa.array(bands, pa.list_(pa.int64()))], ["id", "same", "n", "bands"])

    return docs.mapInArrow(run, "id bigint, same binary, n int, bands array<bigint>")


def shingle_sets(docs: DataFrame, n_words: int) -> DataFrame:
    """id and shingles (sorted 64-bit hashes), once for each id and set."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shingler = Shingler(n_words)
        for batch in slices(batches, 512, 4 << 20):
            data, offsets = utf8(batch["text"])
            sets = [np.unique(shingler.hashes(data[a:b])) for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist())]
            same = [xxhash.xxh3_128_digest(h.tobytes()) for h in sets]
            yield pa.record_batch([batch["id"], pa.array(same, pa.binary()), pa.array([h.view(np.int64) for h in sets], pa.list_(pa.int64()))], ["id", "same", "shingles"])

    return docs.mapInArrow(run, "id bigint, same binary, shingles array<bigint>").dropDuplicates(["id", "same"]).select("id", "shingles")


def chosen(rows: DataFrame, ids: DataFrame) -> DataFrame:
    """The rows whose id is among some distinct ids; those are broadcast if they are few."""
    return rows.join(F.broadcast(ids) if ids.count() <= BROADCAST_IDS else ids, "id", "left_semi")


def verified(pairs: DataFrame, sets: DataFrame, threshold: float) -> DataFrame:
    """The pairs (a member, b pivot) whose shingle sets are similar enough."""
    pairs = materialize(pairs, "pairs")
    sets = chosen(sets, materialize(pairs.select(F.explode(F.array("a", "b")).alias("id")).distinct(), "ids"))
    salts = pairs.groupBy("b").agg(F.ceil(F.count("*") / SALTED).cast("int").alias("salts"))
    left = pairs.join(salts, "b").select("a", "b", F.pmod(F.xxhash64("a"), F.col("salts")).cast("int").alias("salt"))
    left = left.join(sets.select(F.col("id").alias("a"), F.col("shingles").alias("x")), "a")
    right = salts.join(sets.select(F.col("id").alias("b"), F.col("shingles").alias("y")), "b")
    right = right.select("b", F.explode(F.sequence(F.lit(0), F.col("salts") - 1)).alias("salt"), "y")
    both = left.join(right, ["b", "salt"])
    common = F.size(F.array_intersect("x", "y"))
    return both.filter(common >= threshold * (F.size("x") + F.size("y") - common)).select("a", "b").distinct()


def components(links: DataFrame) -> DataFrame:
    """(id, label) of the nodes of some links; label: the smallest id that links lead to. Labels spread along links and are followed to their own labels, so paths shrink by half in each round."""
    edges = materialize(links.select("a", "b").unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct(), "edges")
    labels = materialize(edges.groupBy("a").agg(F.least(F.min("b"), F.first("a")).alias("label")).withColumnRenamed("a", "id"), "labels")
    while True:
        near = edges.join(labels.withColumnRenamed("id", "b"), "b").groupBy("a").agg(F.min("label").alias("near"))
        step = labels.join(near.withColumnRenamed("a", "id"), "id").select("id", "label", F.least("label", "near").alias("new"))
        jump = labels.select(F.col("id").alias("new"), F.col("label").alias("far"))
        after = materialize(step.join(jump, "new", "left").select("id", "label", F.least("new", F.coalesce("far", "new")).alias("new")), "labels")
        discard(labels)
        if after.filter("new < label").isEmpty():
            discard(edges)
            return materialize(after.select("id", F.col("new").alias("label")), "labels")
        labels = materialize(after.select("id", F.col("new").alias("label")), "labels")
        discard(after)


def mixed(left: DataFrame) -> DataFrame:
    """The members of buckets that hold different classes, with the size of their bucket and its smallest id."""
    buckets = left.groupBy("band", "value").agg(F.count("*").alias("size"), F.min("label").alias("least"), F.max("label").alias("most"), F.min("id").alias("lo"))
    return materialize(left.join(buckets.filter("least < most").drop("least", "most"), ["band", "value"]), "mixed")


def alike(sets: list[np.ndarray], threshold: float, block: int = 8192, left: int | None = None) -> np.ndarray:
    """A matrix of which sets are similar enough; common elements are counted a block of distinct ones at a time. left: the first so many sets are compared with the others only, and have the rows."""
    sizes = np.array([len(s) for s in sets], np.float64)
    place, times = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)[1:]
    owner = np.repeat(np.arange(len(sets)), sizes.astype(np.int64))
    number = np.cumsum(times > 1) - 1
    shared = times[place] > 1  # what one set alone has is common to none
    place, owner = number[place[shared]], owner[shared]
    order = np.argsort(place, kind="stable")
    place, owner = place[order], owner[order]
    one, two = (slice(None), slice(None)) if left is None else (slice(0, left), slice(left, None))
    common = np.zeros((len(sizes[one]), len(sizes[two])))
    for at in range(0, int(place[-1]) + 1 if len(place) else 0, block):
        lo, hi = np.searchsorted(place, [at, at + block])
        has = np.zeros((len(sets), min(block, int(place[-1]) + 1 - at)), np.float32)
        has[owner[lo:hi], place[lo:hi] - at] = 1
        common += has[one] @ has[two].T
    same = np.diag(sizes) if left is None else 0  # a set is all common with itself
    common = np.maximum(common, same)
    return common >= threshold * (sizes[one][:, None] + sizes[two][None, :] - common)


def within(small: DataFrame, sets: DataFrame, threshold: float) -> DataFrame:
    """Links (a, b) inside buckets of few members. Each bucket's members meet with their sets in one partition, bucket after bucket, and only links leave it, not the pairs that were compared."""

    def links(members: list[tuple[int, int, np.ndarray]]) -> list[tuple[int, int]]:
        ids, labels = (np.array([m[i] for m in members]) for i in (0, 1))
        found = np.triu(alike([m[2] for m in members], threshold) & (labels[:, None] != labels[None, :]), 1)
        return [(int(ids[i]), int(ids[j])) for i, j in zip(*np.nonzero(found))]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, members, out = None, [], []
        for batch in slices(batches, 512, 4 << 20):
            shingles, offsets = batch["shingles"], batch["shingles"].offsets.to_numpy()
            values = shingles.values.to_numpy()
            keys = zip(batch["band"].to_pylist(), batch["value"].to_pylist())
            for i, (at, name, label) in enumerate(zip(keys, batch["id"].to_pylist(), batch["label"].to_pylist())):
                if at != key:
                    out += links(members) if len(members) > 1 else []
                    key, members = at, []
                members.append((name, label, values[offsets[i] : offsets[i + 1]].copy()))
            yield pa.record_batch([pa.array([x for x, _ in out], pa.int64()), pa.array([y for _, y in out], pa.int64())], ["a", "b"])
            out = []
        out = links(members) if len(members) > 1 else []
        yield pa.record_batch([pa.array([x for x, _ in out], pa.int64()), pa.array([y for _, y in out], pa.int64())], ["a", "b"])

    full = small.select("id", "n", "label", "band", "value").join(sets, "id").filter(F.size("shingles") == F.col("n")).drop("n")
    full = full.repartition("band", "value").sortWithinPartitions("band", "value")
    return full.mapInArrow(run, "a bigint, b bigint").distinct()


def dealt(large: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(members: id, n, label, block; pairs: piece, block, side) of large buckets: the pairs of blocks that together hold all pairs of documents of a cluster that are in different classes."""
    stars = large.filter("id != lo").select(F.col("id").alias("a"), F.col("lo").alias("b")).distinct()
    cluster = components(stars).withColumnRenamed("label", "cluster")
    docs = materialize(large.select("id", "n", "label").distinct().join(cluster, "id"), "clusters")
    parts = lambda: F.ceil(F.greatest(F.count("*") / BLOCK, F.sum("n") / SHINGLES)).cast("bigint")
    own = docs.groupBy("cluster", "label").agg(F.count("*").alias("size"), F.sum("n").alias("shingles"), parts().alias("own"))
    pooled = own.filter("own = 1").groupBy("cluster").agg(F.ceil(F.greatest(F.sum("size") / BLOCK, F.sum("shingles") / SHINGLES)).cast("bigint").alias("pooled"))
    placed = docs.join(own.select("cluster", "label", "own"), ["cluster", "label"]).join(pooled, "cluster", "left")
    big = F.col("own") > 1
    place = F.when(big, F.pmod(F.xxhash64("id"), F.col("own"))).otherwise(F.pmod(F.xxhash64("label"), F.col("pooled")))
    placed = placed.select("id", "n", "label", "cluster", F.struct(F.when(big, F.col("label")).otherwise(0).alias("owner"), big.alias("big"), place.alias("place")).alias("block"))
    members = materialize(placed, "blocks")
    blocks = materialize(members.select("cluster", "block").distinct(), "blocks")
    both = blocks.alias("a").join(blocks.alias("b"), "cluster").filter("a.block <= b.block").filter("NOT (a.block.big AND b.block.big AND a.block.owner = b.block.owner)")
    both = materialize(both.select("cluster", F.col("a.block").alias("a"), F.col("b.block").alias("b"), F.monotonically_increasing_id().alias("piece")), "pieces")
    sides = F.when(F.col("a") == F.col("b"), F.array(F.struct(F.col("a").alias("block"), F.lit(0).alias("side")))).otherwise(F.array(F.struct(F.col("a").alias("block"), F.lit(0).alias("side")), F.struct(F.col("b").alias("block"), F.lit(1).alias("side"))))
    return members, both.select("cluster", "piece", F.inline(sides))


def forest(links: np.ndarray, left: np.ndarray, right: np.ndarray) -> list[tuple[int, int]]:
    """Of links (places in left and right, which hold labels) those that join classes which no earlier one has joined."""
    root: dict[int, int] = {}

    def top(x: int) -> int:
        while root.setdefault(x, x) != x:
            root[x] = x = root[root[x]]
        return x

    out = []
    labels = np.stack([left[links[:, 0]], right[links[:, 1]]], 1)
    for i in np.sort(np.unique(labels, axis=0, return_index=True)[1]).tolist():
        a, b = (top(int(x)) for x in labels[i])
        if a != b:
            root[a] = b
            out.append((int(links[i, 0]), int(links[i, 1])))
    return out


def between(large: DataFrame, sets: DataFrame, threshold: float) -> DataFrame:
    """Links (a, b) that join all classes of large buckets that any link joins."""

    def links(rows: list[tuple[int, int, int, np.ndarray]]) -> list[tuple[int, int]]:
        rows = sorted(rows, key=lambda r: r[0])  # side, id, label, set
        ids, labels = (np.array([r[i] for r in rows], np.int64) for i in (1, 2))
        n = sum(r[0] == 0 for r in rows)
        alone = n == len(rows)
        if n == 0 or not alone and (labels[:n] == labels[0]).all() and (labels == labels[0]).all():
            return []
        other = slice(None) if alone else slice(n, None)
        found = alike([r[3] for r in rows], threshold, 2048, None if alone else n) & (labels[:n, None] != labels[None, other])
        return [(int(ids[:n][i]), int(ids[other][j])) for i, j in forest(np.argwhere(found), labels[:n], labels[other])]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, rows = None, []
        for batch in slices(batches, 512, 4 << 20):
            shingles, offsets = batch["shingles"], batch["shingles"].offsets.to_numpy()
            values, out = shingles.values.to_numpy(), []
            for i, (piece, side, name, label) in enumerate(zip(*(batch[c].to_pylist() for c in ("piece", "side", "id", "label")))):
                if piece != key:
                    out += links(rows) if rows else []
                    key, rows = piece, []
                rows.append((side, name, label, values[offsets[i] : offsets[i + 1]].view(np.uint64).copy()))
            yield pa.record_batch([pa.array([x for x, _ in out], pa.int64()), pa.array([y for _, y in out], pa.int64())], ["a", "b"])
        out = links(rows) if rows else []
        yield pa.record_batch([pa.array([x for x, _ in out], pa.int64()), pa.array([y for _, y in out], pa.int64())], ["a", "b"])

    members, pieces = dealt(large)
    known = chosen(sets, materialize(members.select("id").distinct(), "ids"))
    full = members.join(known, "id").filter(F.size("shingles") == F.col("n")).join(pieces, ["cluster", "block"]).select("piece", "side", "id", "label", "shingles")
    return full.repartition("piece").sortWithinPartitions("piece").mapInArrow(run, "a bigint, b bigint").distinct()


def classes(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", threshold: float = THRESHOLD, k: int = COORDINATES, rows: int = ROWS, n_words: int = WORDS, weighted: bool = True) -> DataFrame:
    """One row for each document: id column and class_id, the smallest id of its class. weighted: signatures of weights are used beside those of sets."""
    short_batches(docs.sparkSession)
    texts = docs.select(F.col(id_col).cast("bigint").alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    all_rows = materialize(sketch(texts, k, rows, n_words, weighted), "sketches")
    known = all_rows.filter("id is not null")
    firsts = materialize(known.groupBy("same").agg(F.min("id").alias("id")), "firsts")
    nodes = known.join(firsts, ["same", "id"], "left_semi")
    member = nodes.select("id", "n", F.posexplode("bands").alias("place", "value")).select("id", "n", F.pmod("place", F.lit(k // rows)).alias("band"), "value").distinct()
    member = materialize(member, "members")
    pivots = member.groupBy("band", "value").agg(F.min("id").alias("lo"), F.max("id").alias("hi")).filter("lo < hi")
    near = materialize(member.join(pivots, ["band", "value"]), "near")
    discard(member)
    one = known.select("id", "same").join(firsts.withColumnRenamed("id", "b"), "same").filter("id != b").select(F.col("id").alias("a"), "b")
    sets = materialize(shingle_sets(chosen(texts, materialize(near.select("id").distinct(), "ids")), n_words), "sets")
    pair = lambda c: near.select(F.col("id").alias("a"), F.col(c).alias("b")).filter("a != b")
    links = materialize(verified(pair("lo").unionByName(pair("hi")).distinct(), sets, threshold).unionByName(one.distinct()), "links")
    labels = components(links)
    named = near.select("id", "n", "band", "value").join(labels, "id", "left").select("id", "n", "band", "value", F.coalesce("label", "id").alias("label"))
    left = mixed(named)
    large = left.filter(F.col("size") > SMALL)
    more = within(left.filter(F.col("size") <= SMALL), sets, threshold)
    more = materialize(more if large.isEmpty() else more.unionByName(between(large, sets, threshold)), "links")
    if not more.isEmpty():
        labels = components(links.unionByName(more))
    discard(sets)
    out = all_rows.select("id", "same").join(firsts.withColumnRenamed("id", "first"), "same", "left")
    out = out.join(labels.withColumnRenamed("id", "first"), "first", "left")
    return out.select(F.col("id").alias(id_col), F.when(F.col("id").isNotNull(), F.coalesce("label", "first")).alias("class_id"))
