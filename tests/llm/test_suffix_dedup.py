import hashlib
import random
from collections import Counter

from riskloom.llm import suffix_dedup
from riskloom.llm.queries import op5_suffix_dedup

SF = "/root/testdata/sf0.001"


def brute(docs, span):
    raws = [(i, (t or "").encode()) for i, t in docs]
    seen = Counter(r[k : k + span] for _, r in raws for k in range(len(r) - span + 1))
    out = []
    for i, r in raws:
        gone = bytearray(len(r))
        for k in range(len(r) - span + 1):
            if seen[r[k : k + span]] > 1:
                gone[k : k + span] = b"\1" * span
        kept = bytes(b for b, g in zip(r, gone) if not g)
        n_spans = sum(1 for k in range(len(r)) if gone[k] and (k == 0 or not gone[k - 1]))
        out.append((i, len(r), sum(gone), n_spans, hashlib.sha256(kept).hexdigest()))
    return sorted(out, key=str)


def test_query_against_brute_force(spark):
    docs = [tuple(r) for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()]
    got = [tuple(r) for r in op5_suffix_dedup(spark, SF).collect()]
    assert sorted(got, key=str) == brute(docs, 200)
    assert sum(r[2] for r in got) > 0


def test_edges(spark):
    random.seed(5)
    word = lambda: "".join(random.choices("abcdefgé", k=random.randint(1, 7)))
    prose = lambda n: " ".join(word() for _ in range(n))
    shared, line = prose(60), prose(4) + "\n"
    docs = [(1, None), (2, ""), (3, "short"), (None, prose(40)), (4, prose(9) + shared + prose(9)), (5, shared[10:] + prose(5)), (5, shared[10:] + prose(5)), (6, "a" * 300), (7, line * 30), (8, prose(700) + shared[:90]), (9, prose(3000)), (9, "other")]
    docs += [(20 + i, prose(3) + shared[: 60 + i] + prose(3)) for i in range(25)]
    frame = spark.createDataFrame([(*d, 7, "x") for d in docs], "doc_id bigint, text string, row int, kept string")
    for hot, chunk in ((1000, 4 << 20), (3, 1500)):
        out = suffix_dedup.drop_repeats(frame, span=50, gram=12, hot_spans=hot, chunk=chunk).collect()
        got = [(r.doc_id, r.n_bytes, r.n_bytes - len(r.kept), len(r.removed_from), hashlib.sha256(r.kept).hexdigest()) for r in out]
        assert sorted(got, key=str) == brute(docs, 50)
    assert suffix_dedup.drop_repeats(frame.limit(0)).count() == 0


def test_levels_grow_geometrically():
    index = suffix_dedup.SuffixLevels(8)
    import numpy as np

    for i in range(64):
        index.insert([f"{i:04d}-unique-{i * 7919:08d}".encode()], np.array([13]))
    assert len(index.levels) <= 7
    assert all(a >= b for a, b in zip(map(len, index.levels), list(map(len, index.levels))[1:]))
