import hashlib
import zlib

import pytest
from pyspark.sql import functions as F

from riskloom.llm import merkle
from riskloom.llm.queries import QUERIES, SQL
from tests.llm.oracle import assert_same

SF = "/root/testdata/sf0.001"


def sha(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def leaf(values):
    return sha(*["-" if v is None else f"{len(str(v).encode())}:{v}" for v in values])


def tree(nodes, arity):
    """(root, for each node the runs above it: (digests before, digests after))."""
    paths, owner = [[] for _ in nodes], [[i] for i in range(len(nodes))]
    while len(nodes) > 1:
        up, own = [], []
        for a in range(0, len(nodes), arity):
            run = nodes[a : a + arity]
            for j in range(len(run)):
                for i in owner[a + j]:
                    paths[i].append((run[:j], run[j + 1 :]))
            up.append(sha(*run))
            own.append([i for x in owner[a : a + arity] for i in x])
        nodes, owner = up, own
    return nodes[0], paths


def brute(rows, arity=2):
    """rows: (doc_id, source, lang, n_chars, text)."""
    groups = {}
    for r in rows:
        groups.setdefault(r[2], []).append((r[0] is not None, r[0] or 0, leaf(r), r))
    langs = sorted(groups, key=lambda g: (g is not None, (g or "").encode()))
    made = {g: tree([x[2] for x in sorted(groups[g], key=lambda x: x[:3])], arity) for g in langs}
    root, above = tree([made[g][0] for g in langs], arity) if langs else (None, [])
    out = []
    for g, top in zip(langs, above):
        for (_, _, own, r), path in zip(sorted(groups[g], key=lambda x: x[:3]), made[g][1]):
            bad = r[0] is not None and zlib.crc32(str(r[0]).encode()) % 7 == 0 and r[3] is not None
            at = leaf((*r[:3], r[3] + 1, r[4])) if bad else own
            for before, after in path + top:
                at = sha(*before, at, *after)
            out.append((r[0], own, made[g][0], root, sha(*[d for b, a in path + top for d in b + a]), at, at == root))
    return sorted(out, key=repr)


def found(spark, rows, arity=2):
    docs = spark.createDataFrame([(*r, 1, "x") for r in rows], "doc_id bigint, source string, lang string, n_chars bigint, text string, idx int, grp string")
    fields = {c: docs[c] for c in ("doc_id", "source", "lang", "n_chars", "text")}
    bad = F.crc32(docs.doc_id.cast("string")) % 7 == 0
    out = merkle.manifest(docs, "lang", "doc_id", fields, {"n_chars": F.when(bad, docs.n_chars + 1).otherwise(docs.n_chars)}, arity)
    text = lambda c: F.lower(F.hex(c))
    out = out.select("doc_id", text("leaf"), text("subroot"), text("root"), merkle.proof_digest(F.col("path")), text("folded_root"), F.col("folded_root") == F.col("root"))
    return sorted(map(tuple, out.collect()), key=repr)


def test_query_against_sql_and_brute_force(spark):
    got = assert_same(spark, QUERIES["op11_merkle"], SQL["op11_merkle"], SF)
    rows = [tuple(r) for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "source", "lang", "n_chars", "text").collect()]
    want = brute(rows)
    assert sorted((r[0], r[2], r[5], r[4], r[3], r[1], r[6]) for r in got) == sorted(want)
    assert 0 < sum(not r[-1] for r in want) < len(want)


@pytest.mark.parametrize("arity", [2, 3, 5])
def test_edges(spark, arity):
    rows = [(7 * i, f"s{i}", "big", i, "é" * i) for i in range(41)]
    rows += [(i, None, None, None, None) for i in range(6)] + [(3, "a", "one", 1, "")] + [(1, "x", "", 5, "t")] * 3 + [(None, "x", "", 2**63 - 2, "t"), (None, None, "", 1, "-")]
    rows += [(2, "tie", "é", 1, "a"), (2, "tie", "é", 1, "b"), (3, "long", "é", 9, "word " * 200_000)]
    assert found(spark, rows, arity) == brute(rows, arity)


def test_few_rows(spark):
    assert found(spark, []) == []
    assert found(spark, [(1, "s", "en", 3, "abc")]) == brute([(1, "s", "en", 3, "abc")])
    only = [(i, "s", f"lang{i}", i, "t") for i in range(9)]  # every group has one leaf
    assert found(spark, only) == brute(only)
