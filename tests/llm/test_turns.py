import hashlib
import itertools
import random
import re
import zlib

import pytest

from riskloom.llm import turns as m
from riskloom.llm.queries import QUERIES, SQL
from tests.llm.oracle import assert_same

SF = "/root/testdata/sf0.001"


def plain(rows, most):
    """The least (cost, letters, lines) over all strings of edits of at most so many inserted turns."""
    found = []
    for kinds in itertools.product("DKR", repeat=len(rows)):
        for places in itertools.chain.from_iterable(itertools.combinations_with_replacement(range(len(rows) + 1), k) for k in range(most + 1)):
            letters = "".join("I" * places.count(i) + (kinds[i] if i < len(rows) else "") for i in range(len(rows) + 1))
            cost, roles, lines, at, ok = 0, "", [], 0, True
            for x in letters:
                new = "a" if roles.endswith("u") else "u"
                name = {"a": "assistant", "u": "user"}[new]
                if x == "I":
                    cost, roles = cost + 3, roles + new
                    lines.append(name + ":")
                    continue
                role, text, goes, short = rows[at]
                at += 1
                if x == "D":
                    cost += 4
                    continue
                ok &= not goes
                cost += 3 * short + 3 * (x == "R")
                roles += new if x == "R" else role[:1] or "?"
                lines.append(f"{name if x == 'R' else role}:{text}")
            if ok and re.fullmatch("(s?(ua)+)?", roles):
                found.append((cost, letters, lines))
    return min(found, key=lambda f: f[:2])


def brute(rows, repairer):
    convs = {}
    for conv, turn, role, text in rows:
        own = convs.setdefault(conv, [])
        kind = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20
        role, text = " " if role is None else role, " " if text is None else text
        text = "" if kind == 1 else re.sub("[.!?]", "", text) if kind == 2 else text
        own += [(turn is not None, turn or 0, ("user" if kind == 4 else role).encode(), text.encode(), turn)] * (0 if kind == 0 else 2 if kind == 3 else 1)
    out = []
    for conv, own in convs.items():
        seen, told, counts = set(), [], [0, 0, 0]
        for _, _, role, text, _ in sorted(own, key=lambda x: x[:4]):
            role, text = role.decode(), text.decode()
            inner = text.rstrip(" \t\n\x0b\x0c\r")
            fault = 0 if not inner else 1 if (role, text) in seen else 2 if inner[-1] not in ".!?" else None
            if fault is not None:
                counts[fault] += 1
            seen.add((role, text))
            told.append((role, text, fault in (0, 1), fault == 2))
        known = {x[4] for x in own} - {None}
        gaps = max(known) - min(known) + 1 - len(known) if known else 0
        illegal = sum(a[0][:1] + b[0][:1] not in ("su", "ua", "au") for a, b in zip(told, told[1:]))
        cost, letters, lines = repairer(told)
        out.append((conv, gaps, *counts, illegal, cost, letters, hashlib.sha256("\n".join(lines).encode()).hexdigest()))
    return sorted(out, key=repr)


def by_table(rows):
    """Costs of all suffixes in one table, each with its least letters, kept as text."""
    step = {"": "u", "s": "u", "u": "a", "a": "u"}
    best = {"": (0, "", []), "a": (0, "", []), "u": (3, "I", ["assistant:"]), "s": (6, "II", ["user:", "assistant:"])}
    for role, text, goes, short in reversed(rows):
        new = {}
        for q in step:
            ways = [(4 + best[q][0], "D" + best[q][1], best[q][2])]
            if not goes:
                name = {"a": "assistant", "u": "user"}[step[q]]
                c, e, t = best[step[q]]
                ways.append((3 + 3 * short + c, "R" + e, [f"{name}:{text}", *t]))
                if role[:1] == step[q] or role[:1] == "s" and q == "":
                    c, e, t = best[role[0]]
                    ways.append((3 * short + c, "K" + e, [f"{role}:{text}", *t]))
            new[q] = min(ways, key=lambda w: w[:2])
        for _ in range(2):  # turns inserted before the row
            for q, n in step.items():
                c, e, t = new[n]
                new[q] = min(new[q], (3 + c, "I" + e, [{"a": "assistant:", "u": "user:"}[n], *t]), key=lambda w: w[:2])
        best = new
    return best[""]


def read(frame, **how):
    return sorted(map(tuple, m.repair(m.damaged(frame), **how).collect()), key=repr)


def test_query_against_sql_and_brute_force(spark):
    got = assert_same(spark, QUERIES["op13_conversations"], SQL["op13_conversations"], SF)
    assert sum(r[3] for r in got) > 10  # costs, by name the fourth
    rows = [tuple(r) for r in spark.read.parquet(f"{SF}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    assert sorted(map(tuple, QUERIES["op13_conversations"](spark, SF).collect()), key=repr) == brute(rows, by_table)


def test_least_edits_against_all_edits():
    rng = random.Random(4)
    for _ in range(150):
        rows = [(rng.choice(["user", "assistant", "system", "tool", "", "user"]), f"t{i}", rng.random() < 0.2, rng.random() < 0.2) for i in range(rng.randrange(5))]
        want = plain(rows, 4)
        assert by_table(rows)[:2] == want[:2] and by_table(rows)[2] == want[2]
        codes = [("sua".find(r[:1]) if r[:1] in ("s", "u", "a") else 3) + (8 if goes else 4 if short else 0) for r, _, goes, short in rows]
        letters, cost = m.edits(codes)
        assert (cost, letters, list(m.lines(letters, [(r, t) for r, t, _, _ in rows], 0))) == want


def sample(seed):
    rng = random.Random(seed)
    rows = []
    for conv in [None, *range(25)]:
        for turn in range(rng.randrange(1, 40)):
            rows.append((conv, rng.choice([turn, turn, turn, turn + 3, None]), rng.choice(["user", "assistant", "user", "assistant", "system", "tool", "", None]), rng.choice(["Hello.", "Yes!\n", "no end", " \t", "", None, "é?", f"own {turn}.", "x" * 3000])))
    rows += [(99, 1, "user", "a.")] * 30 + [(98, None, "user", "b."), (98, None, "assistant", "c.")]
    lost = next(i for i in range(1000, 2000) if zlib.crc32(f"{i}:0".encode()) % 20 == 0)
    return rows + [(lost, 0, "user", "gone.")] * 8


@pytest.mark.parametrize("long_rows", [100_000, 6])
def test_edges_and_long_conversations(spark, long_rows):
    rows = sample(1)
    frame = spark.createDataFrame([(*r, 1, "x") for r in rows], "conv_id bigint, turn bigint, role string, text string, code int, lost string")
    assert read(frame, long_rows=long_rows) == brute(rows, by_table)


def test_sizes(spark):
    empty = spark.createDataFrame([], "conv_id bigint, turn bigint, role string, text string")
    assert read(empty) == []
    rows = [(1, i, "user" if i % 2 == 0 else "assistant", f"t{i}." if i % 11 else "t") for i in range(2000)] + [(2, 0, "user", "word " * 300_000 + "."), (2, 1, "assistant", "b.")]
    frame = spark.createDataFrame(rows, empty.schema)
    assert read(frame) == read(frame, long_bytes=1_000_000, long_rows=500) == brute(rows, by_table)
