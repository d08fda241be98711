import zlib

import numpy as np
import pyarrow as pa
import pytest
from tokenizers import Tokenizer

from riskloom.llm import token_store as ts
from riskloom.llm.queries import VOCAB, op10_token_store


def brute(docs):
    theirs, at, out = Tokenizer.from_file(VOCAB), 0, []
    for doc_id, text in sorted(docs, key=lambda d: (d[0] is not None, d[0] or 0)):
        ids = [*theirs.encode(text or "", add_special_tokens=False).ids, 2]
        out.append((doc_id, at, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        at += len(ids)
    return out


def test_query(spark):
    docs = [tuple(r) for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text").collect()]
    assert sorted(map(tuple, op10_token_store(spark, "/root/testdata/sf0.001").collect())) == brute(docs)


def test_edges(spark):
    docs = [(5, "b"), (1, None), (2, ""), (5, "a"), (None, "x"), (9, "long words " * 20000), (-3, "<|endoftext|>"), (7, "same"), (7, "same")]
    frame = spark.createDataFrame([(*d, "x") for d in docs], "doc_id bigint, text string, ids string")
    out = ts.store_and_read(spark, frame, VOCAB, 2, partitions=3).selectExpr("doc_id", "start", "n_tokens", "crc32(ids) as c").collect()
    assert sorted(map(tuple, out), key=repr) == sorted(brute(docs), key=repr)
    assert ts.store_and_read(spark, frame.limit(0), VOCAB, 2).count() == 0


@pytest.mark.parametrize("n", [0, 1, 511, 512, 5000])
def test_random_access(n):
    ids = np.random.default_rng(n).choice([0, 1, 255, 256, 70000, 2**24, 2**32 - 1], n).astype(np.uint32)
    names, known, starts, codes = ts.unpack(pa.BufferReader(ts.pack([4, None], np.array([0, n // 2, n]), ids)))
    assert names.tolist() == [4, 0] and known.tolist() == [True, False] and starts.tolist() == [0, n // 2, n]
    assert (codes.decode() == ids).all()
    assert [codes[i] for i in range(n)] == ids.tolist()
    for a, b in [(0, 0), (n // 3, n // 2), (n // 2, n), (n, n)]:
        assert (codes.between(a, b) == ids[a:b]).all()
    with pytest.raises(IndexError):
        codes[n]


def test_ids_that_most_rows_share(spark):
    """A third of the rows have one id, a third none; partitions split both, and the order is that of the table."""
    docs = [((7, None, 100 + i)[i % 3], f"word {i}") for i in range(900)]
    out = ts.store_and_read(spark, spark.createDataFrame(docs, "doc_id bigint, text string"), VOCAB, 2, partitions=6).selectExpr("doc_id", "start", "n_tokens", "crc32(ids) as c").collect()
    assert sorted(map(tuple, out), key=repr) == sorted(brute(docs), key=repr)
