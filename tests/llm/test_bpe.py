import os
import random

import numpy as np
import public_tokenizers
from tokenizers import Tokenizer

from riskloom.llm.bpe import LONG_WORD, ByteBPE, encode_decode
from riskloom.llm.queries import VOCAB, op7_bpe

os.environ["TOKENIZERS_PARALLELISM"] = "false"
PIECES = [" ", "  ", "\n", " \n", "\t", "a", "bc", "'s", "'re", "é", "ß", "1", "²", "%%", "<|endoftext|>", "\x1c", "\x85", "\xa0", "日本", "😀", "½", "Ⅷ", "x" * 300, "\r\n", "\x00", "'", "'ll", "ve", "s", "\u2003", "\u3000"]


def test_same_ids_as_the_library():
    theirs, ours = Tokenizer.from_file(VOCAB), ByteBPE(VOCAB, cached=64)
    random.seed(3)
    texts = ["".join(random.choices(PIECES, k=random.randint(0, 12))) for _ in range(2000)] + ["ab" * LONG_WORD * 4, "the" * 2000]
    for text in texts:
        want, got = theirs.encode(text, add_special_tokens=False).ids, ours.encode(text)
        assert np.frombuffer(got, "<u4").tolist() == want, text
        assert ours.decode(np.frombuffer(got, "<u4")) == theirs.decode(want, skip_special_tokens=False)


def test_batches_agree_with_single_texts():
    import pyarrow as pa

    random.seed(9)
    bpe = ByteBPE(VOCAB, cached=500)
    texts = [None, "", " ", "a", "x" * 700, *("".join(random.choices([*PIECES, " word", " Wörter", "the", " " + "long" * 30], k=random.randint(0, 30))) for _ in range(1500))]
    for part in (texts, texts[::-1], texts[:1], []):
        flat, at = bpe.encode_batch(pa.array(part, pa.string()))
        assert [flat[a:b].tobytes() for a, b in zip(at[:-1], at[1:])] == [ByteBPE.encode(bpe, t or "") for t in part]


def test_pieces_of_long_texts(monkeypatch):
    import pyarrow as pa

    from riskloom.llm import bpe as module

    random.seed(4)
    bpe = ByteBPE(VOCAB, cached=5000)
    texts = ["", "".join(random.choices([" word", "'s", "é", "  ", "\n", "12", " Wörter"], k=3000)), "", "x" * 900, "", *["a b c"] * 40, ""]
    want = bpe.encode_batch(pa.array(texts))
    for piece in (10, 64, 1000):
        monkeypatch.setattr(module, "PIECE", piece)
        got = bpe.encode_batch(pa.array(texts))
        assert (got[0] == want[0]).all() and (got[1] == want[1]).all()


def test_query(spark):
    import hashlib

    theirs = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    texts = dict(spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text").collect())
    rows = op7_bpe(spark, "/root/testdata/sf0.001").collect()
    assert len(rows) == len(texts)
    for r in rows:
        ids = theirs.encode(texts[r.doc_id], add_special_tokens=False).ids
        assert (r.n_tokens, r.ids_sha256) == (len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest())
        assert r.decoded_sha256 == hashlib.sha256(theirs.decode(ids, skip_special_tokens=False).encode()).hexdigest()


def test_edges(spark):
    docs = spark.createDataFrame([(1, None, 5), (2, "", 5), (None, "a b", 5), (3, "a b", 5), (3, "a b", 5), (4, "long " * 50000, 5)], "doc_id bigint, text string, ids int")
    out = encode_decode(docs, VOCAB).collect()
    assert sorted((r.doc_id or 0, r.n_tokens, len(r.ids), len(r.decoded)) for r in out) == [(0, 2, 8, 3), (1, 0, 0, 0), (2, 0, 0, 0), (3, 2, 8, 3), (3, 2, 8, 3), (4, 50001, 200004, 250000)]
    assert encode_decode(docs.limit(0), VOCAB).count() == 0
