import random
import re

import numpy as np
import xxhash

from riskloom.llm import simhash_dedup as m
from riskloom.llm.queries import op12_simhash_dedup

SF = "/root/testdata/sf0.001"


def brute(docs):
    """(id, fingerprint, smallest id reached) of every row, by all pairs."""
    prints = []
    for _, text in docs:
        words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda x: x[0].lower(), text or ""))
        runs = [" ".join(words[i : i + 3]) for i in range(max(1, len(words) - 2))] if words else []
        hashes = [xxhash.xxh64_intdigest(r.encode(), 42) for r in runs]
        prints.append(sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes)))
    return [(i, f"{f:016x}", c) for (i, _), f, c in zip(docs, prints, reached([i for i, _ in docs], prints))]


def reached(ids, prints):
    parent = list(range(len(ids)))

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i in range(len(ids)):
        for j in range(i):
            if (prints[i] ^ prints[j]).bit_count() <= 3:
                parent[root(i)] = root(j)
    least = {}
    for i, name in enumerate(ids):
        if name is not None:
            least[root(i)] = min(name, least.get(root(i), name))
    return [least.get(root(i)) for i in range(len(ids))]


def found(frame, **how):
    return sorted(((r.doc_id, f"{r.fp % 2**64:016x}", r.component) for r in m.fuzzy_classes(frame, **how).collect()), key=repr)


def test_query_against_brute_force(spark):
    docs = [tuple(r) for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()]
    got = sorted(map(tuple, op12_simhash_dedup(spark, SF).select("doc_id", "fingerprint", "component_id").collect()))
    assert got == sorted(brute(docs))
    assert sum(i != c for i, _, c in got) > 5


def test_edges(spark):
    rng = random.Random(3)
    prose = [f"w{rng.randrange(10**4)}" for _ in range(400)]
    copies = []
    for i in range(40):
        c = list(prose)
        c[rng.randrange(400)] = f"New{i}"
        copies.append((100 + i, " ".join(c)))
    docs = [(5, None), (3, ""), (9, " \t\n"), (4, "one"), (4, "ONE"), (6, "one two"), (7, "one two three"), (8, "One\x0btwo\x1cthree four"), (None, "a b c"), (None, None), (11, "É e É"), *copies, copies[3], (1, "long word " * 30_000)]
    frame = spark.createDataFrame([(*d, 1, "x") for d in docs], "doc_id bigint, text string, fp int, component string")
    want = sorted(brute(docs), key=repr)
    assert found(frame) == want
    assert found(frame, part=50, small=1) == want  # texts in parts, groups by search
    assert found(frame, big=1) == want  # groups by the words between
    assert found(frame.limit(0)) == []
    assert found(spark.createDataFrame([(None, "a")], "doc_id bigint, text string"))[0][2] is None


def planted(n, seed):
    """Fingerprints in chains and clouds of few differing bits, and unrelated ones."""
    rng = random.Random(seed)
    flip = lambda x, k: x ^ sum(1 << b for b in rng.sample(range(64), k))
    out = [0, 2**64 - 1, 2**63]
    while len(out) < n:
        at = rng.getrandbits(64)
        for _ in range(rng.randrange(1, 30)):
            out.append(at)
            at = flip(at if rng.random() < 0.5 else out[-1], rng.randrange(1, 6))
    return sorted(set(out))


def test_no_link_is_lost(spark):
    prints = planted(1500, 1)
    want = reached(list(range(len(prints))), prints)
    assert 20 < len(set(want)) < len(prints)
    nodes = spark.createDataFrame([(int(np.array([x], np.uint64).view(np.int64)[0]),) for x in prints], "fp bigint")
    place = {int(np.array([x], np.uint64).view(np.int64)[0]): i for i, x in enumerate(prints)}
    for small, big in ((32, 1 << 15), (1, 1 << 15), (2, 3)):
        rows = m.matches(m.keyed(nodes), small, big).collect()
        links = [(r.a, r.b) for r in rows if r.b is not None]
        handed = {(r.a,) for r in rows if r.b is None}
        assert bool(handed) == (big == 3)
        links += map(tuple, m.between(spark.createDataFrame(sorted(handed), "fp bigint")).collect()) if handed else []
        parent = list(range(len(prints)))

        def root(i):
            while parent[i] != i:
                i = parent[i]
            return i

        for a, b in links:
            a, b = place[a], place[b]
            assert (prints[a] ^ prints[b]).bit_count() <= 3
            a, b = root(a), root(b)
            parent[max(a, b)] = min(a, b)
        assert [root(i) for i in range(len(prints))] == want


def test_code_words():
    code = m.Golay()
    rng = np.random.default_rng(2)
    words = np.concatenate([rng.integers(0, 1 << 23, 20_000), np.arange(64)])
    keys = code.keys(words)
    count = (keys >= 0).sum(1)
    assert set(count.tolist()) == {1, 6}
    whole = lambda k: k << 11 | code.rest[k]
    far = np.bitwise_count((whole(np.maximum(keys, 0)) ^ words[:, None]).astype(np.uint64))
    assert (far[:, 0] <= 3).all() and ((far[:, 1:] == 4) | (keys[:, 1:] < 0)).all() and ((count == 6) == (far[:, 0] == 3)).all()
    for bit in range(23):
        assert (keys == code.keys(words ^ (1 << bit))[:, :1]).any(1).all()


def test_groups_over_batches_and_forests():
    values = np.array(planted(400, 5), np.uint64)
    keys = np.sort(np.random.default_rng(1).integers(0, 5, len(values)).astype(np.int32))
    for small in (1, 1000):
        pairs = m.linked(keys, values, small)
        a, b = (np.concatenate([p[i] for p in pairs]) for i in (0, 1))
        assert (np.bitwise_count(a ^ b) <= 3).all()
    links = m.forest(values)
    a, b = (np.concatenate([p[i] for p in links]) for i in (0, 1))
    assert len(a) == len(values) - len(set(reached(list(range(len(values))), values.tolist())))


def test_links_followed_in_one_task_and_in_rounds(spark):
    rng = random.Random(9)
    pairs = [(i, i + 1) for i in range(300)] + [(rng.randrange(400, 900), rng.randrange(400, 900)) for _ in range(250)] + [(1000 + i, 1000) for i in range(1, 200)]
    rng.shuffle(pairs)
    links = spark.createDataFrame([(b, a) if i % 2 else (a, b) for i, (a, b) in enumerate(pairs) if a != b], "a bigint, b bigint")
    one, many = (sorted(map(tuple, m.connected(links, most).collect())) for most in (10**6, 10))
    assert one == many and dict(one)[300] == 0 and dict(one)[1100] == 1000
    assert m.connected(links.limit(0)).count() == 0
