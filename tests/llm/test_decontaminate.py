import hashlib
import re

import duckdb

from riskloom.llm import decontaminate
from riskloom.llm.queries import op9_decontaminate

SF = "/root/testdata/sf0.001"
WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def brute(docs, items, width=10):
    lower = lambda t: re.sub("[A-Z]", lambda m: m[0].lower(), t or "")
    out = []
    for doc_id, text in docs:
        ws = WORD.findall(lower(text))
        hit, found = set(), set()
        for item_id, item in items:
            iw = WORD.findall(lower(item))
            k = min(width, len(iw))
            windows = {tuple(iw[i : i + k]) for i in range(len(iw) - k + 1)} if iw else set()
            for i in range(len(ws) - k + 1):
                if tuple(ws[i : i + k]) in windows:
                    hit.update(range(i, i + k))
                    found.add(item_id)
        out.append((doc_id, len(ws), len(hit), len(found), hashlib.sha256(",".join(sorted(map(str, found))).encode()).hexdigest(), bool(hit)))
    return sorted(out, key=str)


def test_query_against_brute_force(spark):
    con = duckdb.connect()
    docs = con.sql(f"select doc_id, text from '{SF}/documents.parquet'").fetchall()
    items = con.sql(f"select item_id, text from '{SF}/benchmark.parquet'").fetchall()
    got = [tuple(r) for r in op9_decontaminate(spark, SF).collect()]
    assert sorted(got, key=str) == brute(docs, items)
    assert sum(r[-1] for r in got) > 0


def test_edges_and_parts(spark):
    ten = "a b c d e f g h i j"
    docs = [(1, f"x {ten.upper()}, k"), (2, None), (3, ""), (4, "short item"), (4, "short item"), (5, "Ä.b"), (None, ten), (6, ten + " " + ten), (7, "w " * 30000 + ten)]
    items = [(1, ten), (2, "SHORT item!"), (3, None), (4, "..."), (5, ten + " k"), (6, "ä b"), (10, ten)]
    d = spark.createDataFrame([(*x, "extra", 0) for x in docs], "doc_id bigint, text string, items string, n_words int")
    b = spark.createDataFrame(items, "item_id bigint, text string")
    want = [(i, n, h, k) for i, n, h, k, *_ in brute(docs, items)]
    for size in (8 << 20, 12):
        out = decontaminate.contaminated(d, b, part_bytes=size).collect()
        got = [(r.doc_id, r.n_words, sum(y - x for x, y in zip(r.hit_from, r.hit_to)), len(r["items"])) for r in out]
        assert sorted(got, key=str) == sorted(want, key=str)
    assert decontaminate.contaminated(d.limit(0), b).count() == 0
    assert all(not r["items"] for r in decontaminate.contaminated(d, b.limit(0)).collect())
