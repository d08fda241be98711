"""Token-id files of directly addressable codes.

The ids of a file are split into chunks of CHUNK_BITS bits. Level 0 holds the lowest chunk of every id and a bitmap that
tells which ids continue; level 1 holds the next chunk of those, and so on. A rank directory counts the set bits before
each block of a bitmap, so the place of an id's next chunk is known at once and any token is read without decoding its
neighbours. A file also lists its documents and where each begins.

Layout, little-endian: MAGIC, header length (8 bytes), header (JSON: counts and the place of each array), arrays.

A reader takes the documents' places and the rank directories of a file, and of the chunks and bitmaps only the ranges
that it is asked for: `Codes[i]` a few bytes for one token, `Codes.between(a, b)` a document or a few.

Documents are range-partitioned and sorted by id; each task writes files one after another, and a file's ids begin where
those of all files before it end. Rows: a null text counts as empty; each document ends with `end_id`, so an empty text
has one token; rows that share an id follow each other in the order of the table and may lie in several partitions; a
null id comes first; a very long text is one document in one file; an empty table has no files; extra columns are
ignored. Files that a lost or repeated task attempt leaves are in no manifest and are never read.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from riskloom.llm.bpe import PIECE, tokenizer
from riskloom.llm.common import materialize, shared_dir, short_batches, shuffle_partitions, slices

MAGIC = b"DACIDS01"
CHUNK_BITS, RANK_BLOCK = 8, 512
FILE_BYTES = 24 << 20
#: Documents are read back together up to so many ids.
READ_IDS = 1 << 20


class Codes:
    """Directly addressable codes of a sequence of ids."""

    def __init__(self, levels: list[tuple[np.ndarray, np.ndarray, np.ndarray]], n: int):
        self.levels, self.n = levels, n

    @classmethod
    def encode(cls, ids: np.ndarray) -> Codes:
        levels, rest = [], ids.astype(np.uint32)
        while True:
            more = rest >> CHUNK_BITS
            go = more > 0
            bits = np.packbits(go, bitorder="little")
            blocks = np.add.reduceat(go, np.arange(0, len(go), RANK_BLOCK), dtype=np.uint32) if len(go) else np.zeros(0, np.uint32)
            levels.append(((rest & ((1 << CHUNK_BITS) - 1)).astype(np.uint8), bits, np.cumsum(blocks, dtype=np.uint32) - blocks))
            if not go.any():
                return cls(levels, len(ids))
            rest = more[go]

    def rank(self, depth: int, at: int) -> int:
        """The set bits of a level before one of its places: those before its block, from the directory, and those in the block."""
        _, bits, ranks = self.levels[depth]
        block = at // RANK_BLOCK
        part = bits[block * RANK_BLOCK // 8 : (at >> 3) + 1]
        before = np.unpackbits(part, bitorder="little")[: at - block * RANK_BLOCK]
        return int(ranks[block]) + int(np.count_nonzero(before))

    def between(self, a: int, b: int) -> np.ndarray:
        """The ids from place a up to b; no others are decoded."""
        parts: list[tuple[np.ndarray, np.ndarray]] = []
        while b > a:
            chunk, bits, _ = self.levels[len(parts)]
            go = np.unpackbits(bits[a >> 3 : (b + 7) >> 3], bitorder="little")[a & 7 :][: b - a].view(bool)
            parts.append((chunk[a:b], go))
            more = int(np.count_nonzero(go))
            a = self.rank(len(parts) - 1, a) if more else b
            b = a + more
        out = np.zeros(0, np.uint32)
        for chunk, go in reversed(parts):
            ids = chunk.astype(np.uint32)
            ids[go] |= out << CHUNK_BITS
            out = ids
        return out

    def decode(self) -> np.ndarray:
        return self.between(0, self.n)

    def __getitem__(self, at: int) -> int:
        """One id by rank queries; no other id is decoded."""
        if not 0 <= at < self.n:
            raise IndexError(at)
        value = 0
        for depth, (chunk, bits, _) in enumerate(self.levels):
            value |= int(chunk[at]) << CHUNK_BITS * depth
            if not int(bits[at >> 3]) >> (at & 7) & 1:
                return value
            at = self.rank(depth, at)
        raise ValueError("a last level that continues")


class Stored:
    """An array in an open file, of which only what is asked for is read."""

    def __init__(self, file, kind: str, n: int, at: int):
        self.file, self.kind, self.n, self.at = file, np.dtype(kind), n, at

    def __len__(self) -> int:
        return self.n

    def __getitem__(self, key):
        if isinstance(key, slice):
            a, b, _ = key.indices(self.n)
            return np.frombuffer(self.file.read_at(max(0, b - a) * self.kind.itemsize, self.at + a * self.kind.itemsize), self.kind)
        return self[key : key + 1][0]


def pack(doc_ids: list[int | None], starts: np.ndarray, ids: np.ndarray) -> bytes:
    """A file's bytes. starts: where each document begins, and the end of the last."""
    codes = Codes.encode(ids)
    names = np.array([0 if d is None else d for d in doc_ids], np.int64)
    arrays = [names, np.array([d is not None for d in doc_ids], np.uint8), starts.astype(np.int64), *(a for level in codes.levels for a in level)]
    places, at = [], 0
    for a in arrays:
        places.append([str(a.dtype), len(a), at])
        at += a.nbytes
    head = json.dumps({"documents": len(doc_ids), "ids": len(ids), "arrays": places}).encode()
    return b"".join([MAGIC, len(head).to_bytes(8, "little"), head, *(a.tobytes() for a in arrays)])


def unpack(file: pa.NativeFile) -> tuple[np.ndarray, np.ndarray, np.ndarray, Codes]:
    """(ids of documents, which of them are known, where each begins, codes that read from the file)."""
    start = file.read_at(16, 0)
    if start[:8] != MAGIC:
        raise ValueError("not a token-id file")
    size = int.from_bytes(start[8:16], "little")
    head = json.loads(file.read_at(size, 16))
    arrays = [Stored(file, kind, n, 16 + size + at) for kind, n, at in head["arrays"]]
    names, known, starts, *rest = arrays
    levels = [(rest[i], rest[i + 1], rest[i + 2][:]) for i in range(0, len(rest), 3)]
    return names[:], known[:].view(bool), starts[:], Codes(levels, head["ids"])


def write_tokens(docs: DataFrame, folder: str, vocab: str, end_id: int, partitions: int, id_col: str = "doc_id", text_col: str = "text", file_bytes: int = FILE_BYTES) -> DataFrame:
    """Writes the files; returns the manifest: part, nth (file of a part), path, documents, ids, bytes."""
    short_batches(docs.sparkSession)
    rows = docs.select(F.col(id_col).cast("bigint").alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"), F.monotonically_increasing_id().alias("nth"))
    order = [F.asc_nulls_first("id"), F.col("nth")]  # nth splits ids that many rows share
    ordered = rows.repartitionByRange(partitions, *order).sortWithinPartitions(*order).select("id", "text", F.spark_partition_id().alias("part"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, path = fs.FileSystem.from_uri(folder)
        store.create_dir(path, recursive=True)
        bpe, part, held, size, made = tokenizer(vocab), 0, [], 0, []

        def flush() -> None:
            doc_ids = [d for h in held for d in h[0]]
            counts, ids = np.concatenate([h[1] for h in held]), np.concatenate([h[2] for h in held])
            data = pack(doc_ids, np.concatenate([[0], np.cumsum(counts)]), ids)
            name = f"{path}/{uuid.uuid4().hex}.dac"
            with store.open_output_stream(name, compression=None) as out:
                out.write(data)
            made.append((part, len(made), name, len(doc_ids), len(ids), len(data)))
            held.clear()

        for batch in slices(batches, 4096, PIECE):
            part = batch["part"][0].as_py()
            flat, at = bpe.encode_batch(batch["text"])
            ends = np.insert(flat, at[1:], end_id)
            held.append((batch["id"].to_pylist(), np.diff(at) + 1, ends))
            size += 4 * len(ends)
            if size >= 2 * file_bytes:
                flush()
                size = 0
        if held:
            flush()
        if made:
            yield pa.record_batch([pa.array(c) for c in zip(*made)], ["part", "nth", "path", "documents", "ids", "bytes"])

    return materialize(ordered.mapInArrow(run, "part bigint, nth bigint, path string, documents bigint, ids bigint, bytes bigint"), "token-files")


def read_tokens(manifest: DataFrame, folder: str) -> DataFrame:
    """id, start, n_tokens, ids (binary, unsigned 32-bit) of every document, read back from the files."""
    up_to_here = lambda w: w.rowsBetween(Window.unboundedPreceding, -1)
    parts = manifest.groupBy("part").agg(F.sum("ids").alias("ids"))  # a row for each partition of the writer
    parts = parts.select("part", F.coalesce(F.sum("ids").over(up_to_here(Window.orderBy("part"))), F.lit(0)).alias("base"))
    inside = F.coalesce(F.sum("ids").over(up_to_here(Window.partitionBy("part").orderBy("nth"))), F.lit(0))
    files = manifest.withColumn("inside", inside).join(parts, "part").select("path", (F.col("base") + F.col("inside")).alias("start"))
    files = files.repartition(shuffle_partitions(manifest.sparkSession), "path")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, _ = fs.FileSystem.from_uri(folder)
        for batch in batches:
            for path, start in zip(batch["path"].to_pylist(), batch["start"].to_pylist()):
                with store.open_input_file(path) as file:
                    names, known, starts, codes = unpack(file)
                    a = 0
                    while a < len(names):
                        b = min(a + 4096, max(a + 1, int(np.searchsorted(starts, starts[a] + READ_IDS, "right")) - 1))
                        at = starts[a : b + 1]
                        ids = codes.between(int(at[0]), int(at[-1]))
                        blob = pa.LargeBinaryArray.from_buffers(pa.large_binary(), b - a, [None, pa.py_buffer(np.ascontiguousarray(at - at[0]) * 4), pa.py_buffer(ids)])
                        yield pa.record_batch([pa.array(names[a:b], mask=~known[a:b]), pa.array(at[:-1] + start), pa.array(np.diff(at)), blob.cast(pa.binary())], ["id", "start", "n_tokens", "ids"])
                        a = b

    return files.mapInArrow(run, "id bigint, start bigint, n_tokens bigint, ids binary")


def store_and_read(spark: SparkSession, docs: DataFrame, vocab: str, end_id: int, partitions: int | None = None, id_col: str = "doc_id") -> DataFrame:
    """Writes all documents as token files and reads them back."""
    folder = shared_dir(spark, "tokens")
    n = partitions or shuffle_partitions(spark)
    return read_tokens(write_tokens(docs, folder, vocab, end_id, n, id_col), folder).withColumnRenamed("id", id_col)
