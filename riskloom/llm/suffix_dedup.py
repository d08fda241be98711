"""Removal of repeated passages by sampled suffix arrays in a logarithmic index family.

A string of SPAN bytes that starts at two places is found as follows. Every window of SPAN bytes has an anchor, the
leftmost GRAM-byte string in it with the smallest hash, so equal windows have equal anchors at equal places. Windows
that follow each other and share their anchor form a run; a run's span is the bytes of all its windows. Only the runs,
about one for each 60 bytes, are shuffled, by the hash of their anchor:

1. anchors that occur once have no repeated window and are dropped;
2. runs with equal anchor and equal span are repeated as a whole;
3. the distinct spans that share an anchor go to one partition. Their windows are inserted batch by batch: each batch
   gets a suffix array, which is merge-scanned against the existing levels for matches of SPAN bytes and becomes a new
   level; levels of about equal size are merged, so their sizes grow geometrically. Of equal suffixes a level keeps one.
   An anchor with more than `hot_spans` distinct spans is dealt out window by window, by the content of the window;
4. the repeated windows go back to their documents, which lose every byte that such a window covers.

Rows are told apart by 128 bits of hashes of id and text, runs by 64 bits each of their anchor and their content.

Rows: a null text counts as empty; texts of fewer than SPAN bytes keep every byte; the same row given twice counts as
two documents, whose windows repeat each other; rows that share an id are documents each; a null id is kept; very long
texts are sampled in parts of `chunk` bytes that share SPAN - 1; an empty table gives an empty table; extra columns are
ignored; bytes, not characters, are removed, so `kept` is binary.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from riskloom.llm.common import carried, fields_of, materialize, short_batches, shuffle_partitions, slices, unpack, utf8

SPAN = 200
GRAM = 40
PLACE_BITS = 24
CHUNK = 1 << 20


class Roller:
    """Rolling hashes of all GRAM-byte strings of a text, by differences of prefix sums modulo 2**64."""

    def __init__(self, gram: int, most: int, seed: int = 11):
        rng = np.random.default_rng(seed)
        base = int(rng.integers(2**61, 2**62)) | 1
        self.gram, self.table = gram, rng.integers(1, 2**63, 256, dtype=np.uint64)
        self.up, self.down = (self.powers(b, most + 1) for b in (base, pow(base, -1, 2**64)))

    @staticmethod
    def powers(base: int, n: int) -> np.ndarray:
        out = np.full(n, base, np.uint64)
        out[0] = 1
        return np.multiply.accumulate(out)

    def hashes(self, data: np.ndarray) -> np.ndarray:
        n = len(data)
        total = np.zeros(n + 1, np.uint64)
        np.cumsum(self.table[data] * self.up[:n], out=total[1:])
        h = (total[self.gram :] - total[: -self.gram]) * self.down[: n - self.gram + 1]
        h ^= h >> np.uint64(32)
        h *= np.uint64(0x9E3779B97F4A7C15)
        h ^= h >> np.uint64(29)
        return h


def sliding_min(x: np.ndarray, width: int) -> np.ndarray:
    n = len(x)
    blocks = np.full(-(-n // width) * width, np.iinfo(np.uint64).max, np.uint64)
    blocks[:n] = x
    blocks = blocks.reshape(-1, width)
    left = np.minimum.accumulate(blocks, axis=1).ravel()
    right = np.minimum.accumulate(blocks[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(right[: n - width + 1], left[width - 1 : n])


def runs(data: np.ndarray, offsets: np.ndarray, roller: Roller, span: int) -> tuple[np.ndarray, ...]:
    """(document, anchor hash, first window's place, number of windows) of each run of several texts."""
    n, gram = len(data), roller.gram
    none = np.zeros(0, np.int64)
    if n < span:
        return none, none.view(np.uint64), none, none
    low = np.uint64((1 << PLACE_BITS) - 1)
    h = roller.hashes(data)
    anchor = (sliding_min((h & ~low) | np.arange(len(h), dtype=np.uint64), span - gram + 1) & low).astype(np.int64)
    lengths = np.diff(offsets)
    doc = np.repeat(np.arange(len(lengths)), np.maximum(0, lengths - span + 1))
    skip = offsets[:-1] - np.concatenate([[0], np.cumsum(np.maximum(0, lengths - span + 1))[:-1]])
    at = np.arange(len(doc)) + skip[doc]
    anchor = anchor[at]
    new = np.ones(len(doc), bool)
    new[1:] = (anchor[1:] != anchor[:-1]) | (doc[1:] != doc[:-1])
    first = np.flatnonzero(new)
    return doc[first], h[anchor[first]], at[first], np.diff(np.append(first, len(doc)))


def sample(docs: DataFrame, span: int, gram: int, chunk: int) -> DataFrame:
    """The runs of all documents: row, anchor, content (a hash of the span's bytes), place, n."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        roller = Roller(gram, 2 * chunk + span)
        for batch in slices(batches, 4096, chunk):
            data, offsets = utf8(batch["text"])
            ids = batch["row"]
            for doc, lo, part, cuts in cut_long(data, offsets, span, chunk):
                d, anchor, at, n = runs(part, cuts, roller, span)
                raw = part.tobytes()
                content = np.fromiter((xxhash.xxh3_64_intdigest(raw[a:b]) for a, b in zip(at.tolist(), (at + n + span - 1).tolist())), np.uint64, len(at))
                place = at - cuts[d] + lo
                yield pa.record_batch([ids.take(pa.array(doc + d)), pa.array(anchor.view(np.int64)), pa.array(content.view(np.int64)), pa.array(place), pa.array(n.astype(np.int32))], ["row", "anchor", "content", "place", "n"])

    return docs.select("row", "text").mapInArrow(run, "row struct<a: bigint, b: bigint>, anchor bigint, content bigint, place bigint, n int")


def cut_long(data: np.ndarray, offsets: np.ndarray, span: int, chunk: int) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first document, place of the part in it, bytes, offsets): whole texts together, long ones in parts that share span - 1 bytes, so that each window is in one part."""
    if offsets[-1] <= 2 * chunk:
        yield 0, 0, data, offsets
        return
    for doc in range(len(offsets) - 1):
        for at in range(offsets[doc], max(offsets[doc] + 1, offsets[doc + 1] - span + 1), chunk):
            end = min(at + chunk + span - 1, offsets[doc + 1])
            yield doc, at - offsets[doc], data[at:end], np.array([0, end - at])


class SuffixLevels:
    """Suffix arrays of geometrically growing size over the windows of many spans."""

    def __init__(self, span: int):
        self.span, self.text, self.levels = span, np.zeros(1 << 16, np.uint8), []
        self.matched = np.zeros(1 << 16, bool)
        self.size = 0

    def room(self, more: int) -> None:
        if self.size + more > len(self.text):
            n = max(2 * len(self.text), self.size + more)
            self.text, self.matched = (np.concatenate([x, np.zeros(n - len(x), x.dtype)]) for x in (self.text, self.matched))

    def suffixes(self, places: np.ndarray) -> np.ndarray:
        """The first span bytes of the suffixes at some places, as values that compare like the bytes."""
        if not len(places):
            return np.zeros(0, f"S{self.span}")
        return np.lib.stride_tricks.sliding_window_view(self.text[: self.size], self.span)[places].view(f"S{self.span}").ravel()

    def insert(self, spans: list[bytes], windows: np.ndarray) -> int:
        """Adds a batch; returns the place of its first byte. windows: how many windows each span has."""
        blob = np.frombuffer(b"".join(spans), np.uint8)
        self.room(len(blob))
        base = self.size
        self.text[base : base + len(blob)] = blob
        self.size += len(blob)
        begins = base + np.concatenate([[0], np.cumsum([len(s) for s in spans])[:-1]]).astype(np.int64)
        within = np.arange(windows.sum()) - np.repeat(np.cumsum(windows) - windows, windows)
        places = np.repeat(begins, windows) + within
        keys = self.suffixes(places)
        order = np.argsort(keys, kind="stable")
        places, keys = places[order], keys[order]
        same = keys[1:] == keys[:-1]
        self.matched[places[1:][same]] = self.matched[places[:-1][same]] = True
        keep = np.append(True, ~same)[: len(keys)]
        places, keys = places[keep], keys[keep]
        for level in self.levels:
            self.scan(level, places, keys)
        while self.levels and len(self.levels[-1]) <= 2 * len(places):
            places = self.merge(self.levels.pop(), places)
        self.levels.append(places)
        return base

    def scan(self, level: np.ndarray, places: np.ndarray, keys: np.ndarray, block: int = 1 << 16) -> None:
        """Marks suffixes of a level and of the batch that agree in span bytes, block by block of the level."""
        for at in range(0, len(level), block):
            part = level[at : at + block]
            held = self.suffixes(part)
            lo, hi = np.searchsorted(keys, held[[0, -1]], "left") + [0, 1]
            found = np.searchsorted(held, keys[lo:hi])
            ok = found < len(held)
            ok[ok] = held[found[ok]] == keys[lo:hi][ok]
            self.matched[part[found[ok]]] = self.matched[places[lo:hi][ok]] = True

    def merge(self, level: np.ndarray, places: np.ndarray) -> np.ndarray:
        a, b = self.suffixes(level), self.suffixes(places)
        at = np.searchsorted(a, b)
        new = at == len(a)
        new[~new] = a[at[~new]] != b[~new]
        return np.insert(level, at[new], places[new])


def long_matches(spans: DataFrame, span: int) -> DataFrame:
    """The windows of spans (anchor, content, whole, first, n, bytes) that repeat in their partition, as runs [begin, end); spans known to repeat as a whole take part and are left out of the result."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index, held = SuffixLevels(span), []
        for batch in slices(batches, 1024, 1 << 19):
            texts, n = batch["bytes"].to_pylist(), batch["n"].to_numpy().astype(np.int64)
            base = index.insert(texts, n)
            begins = base + np.concatenate([[0], np.cumsum([len(t) for t in texts])[:-1]]).astype(np.int64)
            held.append((begins, n, *(batch[c].to_numpy(zero_copy_only=False) for c in ("anchor", "content", "first", "whole"))))
        for begins, n, anchor, content, first, whole in held:
            rows: list[tuple] = []
            for i, (b, k) in enumerate(zip(begins.tolist(), n.tolist())):
                flags = index.matched[b : b + k]
                if flags.any() and not whole[i]:
                    edges = np.flatnonzero(np.diff(np.concatenate([[0], flags.view(np.int8), [0]])))
                    rows += [(i, x, y) for x, y in zip(edges[::2].tolist(), edges[1::2].tolist())]
            at = np.array([r[0] for r in rows], np.int64)
            yield pa.record_batch([pa.array(anchor[at]), pa.array(content[at]), pa.array(np.array([r[1] for r in rows], np.int32) + first[at]), pa.array(np.array([r[2] for r in rows], np.int32) + first[at])], ["anchor", "content", "begin", "end"])

    return spans.mapInArrow(run, "anchor bigint, content bigint, begin int, end int")


def cut_spans(docs: DataFrame, span: int) -> DataFrame:
    """Bytes of the runs that each document lends: part, anchor, content, whole, first, n, bytes. Runs of hot anchors go out window by window."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, 256, 2 << 20):
            out: list[tuple] = []
            for text, lent in zip(batch["text"].to_pylist(), batch["lent"].to_pylist()):
                raw = (text or "").encode()
                for x in lent or ():
                    a, n = x["place"], x["n"]
                    if x["hot"]:
                        for i in range(n):
                            w = raw[a + i : a + i + span]
                            out.append((xxhash.xxh3_64_intdigest(w) - 2**63, x["anchor"], x["content"], x["whole"], i, 1, w))
                    else:
                        out.append((x["anchor"], x["anchor"], x["content"], x["whole"], 0, n, raw[a : a + n + span - 1]))
            columns = list(zip(*out)) or [()] * 7
            kinds = (pa.int64(), pa.int64(), pa.int64(), pa.bool_(), pa.int32(), pa.int32(), pa.binary())
            yield pa.record_batch([pa.array(c, k) for c, k in zip(columns, kinds)], ["part", "anchor", "content", "whole", "first", "n", "bytes"])

    return docs.select("id", "text", "carried", "lent").mapInArrow(run, "part bigint, anchor bigint, content bigint, whole boolean, first int, n int, bytes binary")


def covered(begins: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The maximal runs of intervals [begin, end); runs that touch are one."""
    order = np.argsort(begins, kind="stable")
    a, b = begins[order], np.maximum.accumulate(ends[order])
    new = np.append(True, a[1:] > b[:-1])
    return a[new], b[np.append(np.flatnonzero(new)[1:] - 1, len(a) - 1)]


def remove(docs: DataFrame, span: int) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, 512, 4 << 20):
            sizes, kept, firsts, ends = [], [], [], []
            for text, begin, end in zip(batch["text"].to_pylist(), batch["begin"], batch["end"]):
                raw = (text or "").encode()
                a = b = np.zeros(0, np.int64)
                if begin.values is not None and len(begin.values):
                    a, b = covered(begin.values.to_numpy(), end.values.to_numpy() + span - 1)
                cuts = [0, *np.stack([a, b], 1).ravel().tolist(), len(raw)]
                sizes.append(len(raw))
                kept.append(b"".join(raw[x:y] for x, y in zip(cuts[::2], cuts[1::2])))
                firsts.append(a)
                ends.append(b)
            lists = (pa.array(x, pa.list_(pa.int64())) for x in (firsts, ends))
            yield pa.record_batch([batch["id"], batch["carried"], pa.array(sizes, pa.int64()), *lists, pa.array(kept, pa.binary())], ["id", "carried", "n_bytes", "removed_from", "removed_to", "kept"])

    return docs.select("id", "text", "carried", "begin", "end").mapInArrow(run, fields_of(docs, ["id", "carried"], "n_bytes bigint, removed_from array<bigint>, removed_to array<bigint>, kept binary"))


def drop_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", span: int = SPAN, gram: int = GRAM, hot_spans: int = 8000, chunk: int = CHUNK, keep: list[str] | None = None) -> DataFrame:
    """id column, n_bytes, removed_from and removed_to (byte places of the maximal removed runs), kept (binary); with keep, those columns in place of the id."""
    short_batches(docs.sparkSession)
    spark = docs.sparkSession
    rows = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"), carried(docs, keep))
    key = F.struct(F.xxhash64("id", "text").alias("a"), F.xxhash64(F.lit(1), "text", "id").alias("b"))  # 128 bits
    rows = rows.select(key.alias("row"), "id", "text", "carried")
    found = materialize(sample(rows, span, gram, chunk), "runs")
    repeated = materialize(found.groupBy("anchor").agg(F.count("*").alias("c")).filter("c > 1").select("anchor"), "anchors")
    found = materialize(found.join(repeated, "anchor", "left_semi"), "repeated-runs")
    distinct = materialize(found.groupBy("anchor", "content").agg(F.count("*").alias("c"), F.min(F.struct("row", "place", "n")).alias("one")), "distinct-runs")
    shared = distinct.groupBy("anchor").agg(F.count("*").alias("spans")).filter("spans > 1")
    lent = distinct.join(shared, "anchor").select(F.col("one.row").alias("row"), F.struct("anchor", "content", "one.place", "one.n", (F.col("c") > 1).alias("whole"), (F.col("spans") > hot_spans).alias("hot")).alias("x"))
    lent = lent.groupBy("row").agg(F.collect_list("x").alias("lent"))
    parts = max(shuffle_partitions(spark), 1 + distinct.count() // 4000)
    spans = cut_spans(rows.join(lent, "row"), span).repartition(parts, "part")
    whole = distinct.filter("c > 1").select("anchor", "content", F.lit(0).alias("begin"), F.col("one.n").alias("end"))
    hits = long_matches(spans, span).unionByName(whole)
    places = found.join(hits, ["anchor", "content"]).select("row", (F.col("place") + F.col("begin")).alias("begin"), (F.col("place") + F.col("end")).alias("end"))
    by_row = places.groupBy("row").agg(F.collect_list(F.struct("begin", "end")).alias("x")).select("row", "x.begin", "x.end")
    out = remove(rows.join(by_row, "row", "left"), span)
    return unpack(out.drop("id"), keep) if keep else out.drop("carried").withColumnRenamed("id", id_col)
