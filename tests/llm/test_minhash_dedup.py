import random

import numpy as np

from riskloom.llm import minhash_dedup as m
from riskloom.llm.decontaminate import split_words
from riskloom.llm.queries import op8_minhash_dedup

SF = "/root/testdata/sf0.001"


def brute(docs, threshold=0.8):
    """(class of each row, similarity of each pair) by all pairs of exact shingle sets."""
    sets = []
    for _, t in docs:
        w = split_words(t)
        sets.append({tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else {("", t or "")})
    parent = list(range(len(docs)))

    def root(i):
        while parent[i] != i:
            parent[i] = parent[parent[i]]
            i = parent[i]
        return i

    for i in range(len(docs)):
        for j in range(i):
            common = len(sets[i] & sets[j])
            if docs[i][0] == docs[j][0] or common and common >= threshold * (len(sets[i]) + len(sets[j]) - common):
                parent[root(i)] = root(j)
    least = {}
    for i, (d, _) in enumerate(docs):
        least[root(i)] = min(d, least.get(root(i), d))
    return sorted((d, least[root(i)]) for i, (d, _) in enumerate(docs))


def test_query_against_brute_force(spark):
    docs = [tuple(r) for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()]
    got = sorted(map(tuple, op8_minhash_dedup(spark, SF).collect()))
    assert got == brute(docs)
    assert any(a != b for a, b in got)


def test_edges(spark):
    random.seed(2)
    prose = lambda n: [f"w{random.randrange(10**6)}" for _ in range(n)]
    base = prose(300)
    copies = []
    for i in range(60):
        c = list(base)
        for _ in range(3):
            c[random.randrange(300)] = f"new{i}"
        copies.append((100 + i, " ".join(c)))
    docs = [(1, ""), (2, None), (3, "..."), (4, "..."), (5, "one two"), (6, "One, two!"), (7, " ".join(prose(50))), (8, " ".join(prose(50))), (8, "other text that is quite different"), (9, " ".join(prose(40000))), *copies, copies[0]]
    frame = spark.createDataFrame([(*d, "x", 1) for d in docs], "doc_id bigint, text string, same string, id int")
    assert sorted(map(tuple, m.classes(frame).collect())) == brute(docs)
    out = m.classes(spark.createDataFrame([(None, "a b"), (1, "a b")], "doc_id bigint, text string")).collect()
    assert sorted((r.doc_id or 0, r.class_id or 0) for r in out) == [(0, 0), (1, 1)]
    assert m.classes(frame.limit(0)).count() == 0


def test_twins_among_documents_of_one_template(spark):
    rng = random.Random(6)
    base = [f"w{i}" for i in range(1200)]
    docs = []
    for i in range(120):
        shared = dict.fromkeys(rng.sample(range(1200), 9), f"s{i}")
        for j in (i, 120 + rng.randrange(10**6) * 120 + i):
            own = shared | dict.fromkeys(rng.sample(range(1200), 8), f"o{j}")
            docs.append((j, " ".join(own.get(at, w) for at, w in enumerate(base))))
    want = brute(docs)
    assert len({c for _, c in want}) == 120
    assert sorted(map(tuple, m.classes(spark.createDataFrame(docs, "doc_id bigint, text string")).collect())) == want


def test_share_of_twins_found_in_large_buckets(spark):
    """300 pairs of twins (0.9) among documents of one template (0.74), whose buckets are split before all in them are compared."""
    rng = random.Random(8)
    base, docs = [f"w{i}" for i in range(1200)], []
    for i in range(300):
        shared = dict.fromkeys(rng.sample(range(1200), 12), f"s{i}")
        docs += [(j, " ".join((shared | dict.fromkeys(rng.sample(range(1200), 6), f"o{j}")).get(at, w) for at, w in enumerate(base))) for j in (i, 1000 + i)]
    got = dict(map(tuple, m.classes(spark.createDataFrame(docs, "doc_id bigint, text string")).collect()))
    assert sum(got[i] == got[1000 + i] for i in range(300)) >= 0.95 * 300
    assert len(set(got.values())) <= 102 + 10  # brute force finds 102 classes


def test_a_large_cluster_of_near_copies(spark):
    """20,000 near copies of one text, each with its own words, meet in tasks of bounded size."""
    base = " ".join(f"w{i}" for i in range(60))
    docs = spark.range(20_000).selectExpr("id AS doc_id", f"concat('{base}', ' own', id) AS text")
    rows = m.classes(docs).groupBy("class_id").count().collect()
    assert [(r["class_id"], r["count"]) for r in rows] == [(0, 20_000)]


def test_signatures_estimate_weighted_similarity():
    rng = np.random.default_rng(1)
    dart = m.DartMinHash(512)
    x = rng.integers(0, 2**63, 300, dtype=np.uint64)
    u, v = rng.uniform(0.1, 3, 300), rng.uniform(0.1, 3, 300)
    u[:60] = v[200:] = 0
    a, b = dart.signature(x[u > 0], u[u > 0]), dart.signature(x[v > 0], v[v > 0])
    assert abs((a == b).mean() - np.minimum(u, v).sum() / np.maximum(u, v).sum()) < 0.08


def test_shingles_of_long_texts_do_not_depend_on_parts():
    text = np.frombuffer((" ".join(f"w{i % 977}, é{i}" for i in range(3000))).encode(), np.uint8)
    assert (m.Shingler(part=100).hashes(text) == m.Shingler().hashes(text)).all()


def test_links_within_small_buckets(spark):
    """Buckets that run over Arrow batches, sets counted in several blocks, a class that must not link to itself."""
    rng = np.random.default_rng(4)
    base = rng.integers(0, 2**62, 300, dtype=np.int64)
    sets = [np.unique(np.concatenate([base[: 300 - 15 * (i % 4)], rng.integers(0, 2**62, 10 * (i % 5), dtype=np.int64)])) for i in range(24)]
    share = lambda x, y: len(np.intersect1d(x, y)) / len(np.union1d(x, y))
    brute = np.array([[share(x, y) >= 0.8 for y in sets] for x in sets])
    assert 24 < brute.sum() < brute.size
    views = [s.view(np.uint64) for s in sets]
    assert (m.alike(views, 0.8, block=7) == brute).all() and (m.alike(views, 0.8) == brute).all()
    rows = [(i, len(sets[i]), i % 6, i % 2, 5) for i in range(24)]  # id, n, label, band, value
    small = spark.createDataFrame(rows, "id bigint, n int, label bigint, band int, value bigint")
    known = spark.createDataFrame([(i, s.tolist()) for i, s in enumerate(sets)], "id bigint, shingles array<bigint>")
    found = {tuple(sorted(r)) for r in m.within(small, known, 0.8).collect()}
    assert found == {(i, j) for i in range(24) for j in range(i + 1, 24) if i % 2 == j % 2 and i % 6 != j % 6 and brute[i, j]}
    assert m.within(small.limit(0), known, 0.8).count() == 0


def template(n, seed, shared, own):
    rng = random.Random(seed)
    base, docs = [f"w{i}" for i in range(1200)], []
    for i in range(n):
        pair = dict.fromkeys(rng.sample(range(1200), shared), f"s{i}")
        docs += [(j, " ".join((pair | dict.fromkeys(rng.sample(range(1200), own), f"o{j}")).get(at, w) for at, w in enumerate(base))) for j in (i, 1000 + i)]
    return docs


def test_no_link_is_lost_in_large_buckets(spark, monkeypatch):
    """All links among documents of one template, in one block and in pairs of small ones."""
    docs = template(300, 8, 12, 6)
    want = brute(docs)
    assert len({c for _, c in want}) == 102
    frame = spark.createDataFrame(docs, "doc_id bigint, text string")
    assert sorted(map(tuple, m.classes(frame).collect())) == want
    monkeypatch.setattr(m, "BLOCK", 100)
    assert sorted(map(tuple, m.classes(frame).collect())) == want


def test_classes_larger_than_a_block(spark, monkeypatch):
    """Classes with blocks of their own are compared with all others, pairs of documents within a class never."""
    monkeypatch.setattr(m, "BLOCK", 8)
    rng = np.random.default_rng(9)
    core = rng.integers(0, 2**62, 90, dtype=np.int64)
    sets = [np.unique(np.concatenate([core[i % 5 :], rng.integers(0, 2**62, 4 + i % 13, dtype=np.int64)])) for i in range(80)]
    near = m.alike([s.view(np.uint64) for s in sets], 0.8)
    labels = [0] * 30 + [30] * 20 + list(range(50, 80))
    large = spark.createDataFrame([(i, len(sets[i]), labels[i], 0, 5, 80, 0) for i in range(80)], "id bigint, n int, label bigint, band int, value bigint, size bigint, lo bigint")
    known = spark.createDataFrame([(i, s.tolist()) for i, s in enumerate(sets)], "id bigint, shingles array<bigint>")
    found = [tuple(r) for r in m.between(large, known, 0.8).collect()]
    assert found and all(near[a, b] and labels[a] != labels[b] for a, b in found)

    def joined(links):
        of = dict(enumerate(labels))
        for a, b in links:
            of = {k: of[a] if v == of[b] else v for k, v in of.items()}
        return {frozenset(k for k in of if of[k] == c) for c in set(of.values())}

    assert joined(found) == joined([(a, b) for a in range(80) for b in range(80) if near[a, b]])
