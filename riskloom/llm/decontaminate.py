"""Benchmark decontamination by Wu-Manber multi-pattern search over words.

The patterns are the windows of `width` consecutive words of every benchmark item; an item of fewer words, but not
none, is one window. Windows of one length share a shift table: it maps a block of BLOCK words to the distance by which
a search may move on when that block ends at the present place, and blocks that no window holds allow the largest
shift. Where the shift is 0, the block that ends a window selects a bucket of windows, and direct comparison of all its
words confirms an occurrence.

Rows: a null or wordless text has no words and no hits; an item that is null or wordless has no window; repeated items
each count; repeated documents give repeated results; an empty benchmark hits nothing; extra columns are ignored.
The windows reach the executors as a broadcast of whole items of at most `part_bytes` bytes of text at a time; a larger
benchmark is searched in as many parts as it takes, whose hits are merged by document.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator
from itertools import chain

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from riskloom.llm.common import materialize, short_batches, slices

WIDTH = 10
BLOCK = 2
#: ASCII that is no digit and no letter parts words; A-Z counts as a-z; bytes from 0x80 belong to words.
WORD_BYTES = bytes(b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32 for b in range(256))


def split_words(text: str | None) -> list[bytes]:
    return text.encode("utf-8", "surrogatepass").translate(WORD_BYTES).split() if text else []


class WordPatterns:
    """Wu-Manber tables for windows of one length."""

    def __init__(self, windows: dict[tuple[bytes, ...], list[int]]):
        self.length = len(next(iter(windows)))
        self.block = min(BLOCK, self.length)
        self.shift: dict[tuple[bytes, ...], int] = {}
        self.buckets: dict[tuple[bytes, ...], list[tuple[tuple[bytes, ...], list[int]]]] = defaultdict(list)
        for window, items in windows.items():
            for end in range(self.block, self.length + 1):
                key, far = window[end - self.block : end], self.length - end
                self.shift[key] = min(far, self.shift.get(key, far))
            self.buckets[window[-self.block :]].append((window, items))

    def find(self, text: list[bytes]) -> Iterator[tuple[int, list[int]]]:
        """(first word, items) of every occurrence."""
        n, m, get, most = len(text), self.length, self.shift.get, self.length - self.block + 1
        at = m  # the window under test ends before this word
        if self.block == 2:
            while at <= n:
                if step := get((text[at - 2], text[at - 1]), most):
                    at += step
                    continue
                yield from self.confirm(text, at)
                at += 1
        else:
            while at <= n:
                if step := get((text[at - 1],), most):
                    at += step
                    continue
                yield from self.confirm(text, at)
                at += 1

    def confirm(self, text: list[bytes], at: int) -> Iterator[tuple[int, list[int]]]:
        found = tuple(text[at - self.length : at])
        for window, items in self.buckets[found[-self.block :]]:
            if window == found:
                yield at - self.length, items


def build(items: list[tuple[int, str | None]], width: int) -> list[WordPatterns]:
    by_length: dict[int, dict[tuple[bytes, ...], list[int]]] = defaultdict(dict)
    for item_id, text in items:
        ws = split_words(text)
        size = min(width, len(ws))
        for at in range(len(ws) - size + 1 if ws else 0):
            held = by_length[size].setdefault(tuple(ws[at : at + size]), [])
            if item_id not in held:
                held.append(item_id)
    return [WordPatterns(by_length[k]) for k in sorted(by_length)]


def scan(docs: DataFrame, items: list[tuple[int, str | None]], width: int) -> DataFrame:
    """Hits of some items in all documents: row, id, n_words, hit spans as [first, end) word numbers, item ids."""
    held = docs.sparkSession.sparkContext.broadcast(items)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        patterns = build(held.value, width)
        for batch in slices(batches, 512, 4 << 20):
            counts, firsts, ends, ids = [], [], [], []
            for text in batch["text"].to_pylist():
                ws, spans, found = split_words(text), [], set()
                for p in patterns:
                    for at, items in p.find(ws):
                        spans.append((at, at + p.length))
                        found.update(items)
                merged: list[list[int]] = []
                for a, b in sorted(spans):
                    if merged and a <= merged[-1][1]:
                        merged[-1][1] = max(b, merged[-1][1])
                    else:
                        merged.append([a, b])
                counts.append(len(ws))
                firsts.append([a for a, _ in merged])
                ends.append([b for _, b in merged])
                ids.append(sorted(found))
            yield pa.record_batch([batch["id"], pa.array(counts, pa.int64()), pa.array(firsts, pa.list_(pa.int64())), pa.array(ends, pa.list_(pa.int64())), pa.array(ids, pa.list_(pa.int64()))], ["id", "n_words", "hit_from", "hit_to", "items"])

    kind = docs.schema["id"].dataType.simpleString()
    return docs.mapInArrow(run, f"id {kind}, n_words bigint, hit_from array<bigint>, hit_to array<bigint>, items array<bigint>")


def parts_of(benchmark: DataFrame, item_col: str, text_col: str, part_bytes: int) -> Iterator[list[tuple[int, str | None]]]:
    """Whole items, read one by one from Spark and handed on in parts of bounded size."""
    part, size = [], 0
    for row in benchmark.select(F.col(item_col).cast("bigint"), text_col).toLocalIterator():
        more = len((row[1] or "").encode("utf-8", "surrogatepass"))
        if part and size + more > part_bytes:
            yield part
            part, size = [], 0
        part.append((row[0], row[1]))
        size += more
    yield part


def contaminated(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text: str = "text", width: int = WIDTH, part_bytes: int = 8 << 20) -> DataFrame:
    """id column, n_words, hit_from and hit_to (word numbers of the maximal hit runs), items (ids, ascending)."""
    short_batches(docs.sparkSession)
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    parts = parts_of(benchmark, item_col, item_text, part_bytes)
    first, second = next(parts), next(parts, None)
    if second is None:
        return scan(rows, first, width).withColumnRenamed("id", id_col)
    keyed = rows.withColumn("row", F.struct("id", F.xxhash64("text").alias("h")))
    found = [materialize(scan(keyed.select(F.col("row").alias("id"), "text"), part, width), "decontaminate") for part in chain((first, second), parts)]
    merged = None
    for i, f in enumerate(found):
        f = f.withColumn("part", F.lit(i))
        merged = f if merged is None else merged.unionByName(f)
    return join_parts(merged, len(found)).withColumnRenamed("id", id_col)


def join_parts(found: DataFrame, n_parts: int) -> DataFrame:
    """Merges the spans that the parts have found; a row that occurs k times stays k rows."""
    spans = F.flatten(F.collect_list(F.arrays_zip("hit_from", "hit_to")))
    grouped = found.groupBy("id").agg(F.first("n_words").alias("n_words"), F.array_sort(spans).alias("spans"), F.array_sort(F.array_distinct(F.flatten(F.collect_list("items")))).alias("items"), (F.count("*") / n_parts).cast("int").alias("copies"))
    start = F.expr("cast(array() as array<struct<a:bigint,b:bigint>>)")
    merge = lambda acc, x: F.when((F.size(acc) > 0) & (x["hit_from"] <= F.try_element_at(acc, F.lit(-1))["b"]), F.concat(F.slice(acc, 1, F.greatest(F.size(acc) - 1, F.lit(0))), F.array(F.struct(F.try_element_at(acc, F.lit(-1))["a"].alias("a"), F.greatest(F.try_element_at(acc, F.lit(-1))["b"], x["hit_to"]).alias("b"))))).otherwise(F.concat(acc, F.array(F.struct(x["hit_from"].alias("a"), x["hit_to"].alias("b")))))
    return grouped.withColumn("runs", F.aggregate("spans", start, merge)).select(F.col("id.id").alias("id"), "n_words", F.col("runs.a").alias("hit_from"), F.col("runs.b").alias("hit_to"), "items", F.explode(F.sequence(F.lit(1), "copies")).alias("copy")).drop("copy")
