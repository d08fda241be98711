"""Structure repair of conversations: the cheapest edits that make roles alternate, found by a checkpointed recursion.

Rows of a conversation go by turn. Each row's first fault counts: blank, duplicate (role and text seen earlier in the
conversation), truncated (its last character isn't a mark that ends a sentence). Edits: K keeps a row (0), R gives it
the role that fits, user or assistant (3), D deletes it (4; the only choice for blank and duplicate rows), I inserts an
empty turn (3). A truncated row that stays adds 3. The initials of the roles that remain must be an `s` at most, then
pairs of `u` and `a`, or nothing. Of all cheapest edits those whose letters come first in ASCII order are taken.

Four states tell where in that pattern one is. Going backwards, a vector holds the least cost to the end from every
state. Vectors are stored at every square root of n rows only; going forwards, a block's vectors are made again from the
checkpoint at its end, and the first letter that keeps the cost is emitted.

A conversation of up to `long_rows` rows and `long_bytes` bytes is repaired where its rows meet, sorted, one at a time.
A longer one is never gathered: its rows get positions by range partitions and are cut into blocks of about the square
root of its length. A block is summed up as a matrix of least costs between states; these are multiplied from the end to
give the checkpoints (as many as blocks), blocks walk forwards from each of four states, and a chain over blocks picks
the state. Earlier copies of a row are found by a grouped minimum. Only the digest of the whole repaired text, which
must see it in order, is a stream through one task for each long conversation, in bounded memory; the letters of the
edits are one string, as the result asks, which Spark bounds at 2 GB.

Rows: a null counts as one blank, in a role, a text and in the key of the damage; null turns come first; rows of equal turns go by
role and text; a null conversation id is a conversation; roles are told by their first letter, so an empty role fits
nowhere; conversations that lose all rows give zeros, no letters and the digest of an empty text; an empty table gives
an empty table; extra columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from math import isqrt

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from riskloom.functions.ranking import running
from riskloom.llm.common import materialize, short_batches, slices

LONG_ROWS, LONG_BYTES = 100_000, 32 << 20
DELETE, INSERT, REROLE, TRUNCATED = 4, 3, 3, 3
NEVER = 1 << 60
#: States: at the start, after a system turn, after a user's, after an assistant's; what a row with initial s, u, a leads to.
NEXT = ((1, 2, None), (None, 2, None), (None, None, 3), (None, 2, None))
FORCED = (2, 2, 3, 2)
#: Least costs after the last row.
END = (0, 2 * INSERT, INSERT, 0)
ROLES = {2: "user", 3: "assistant"}
BLANKS = " \t\n\x0b\x0c\r"
RESULT = "conv_id bigint, gaps bigint, blank bigint, duplicate bigint, truncated bigint, illegal bigint, cost bigint, audit string, repaired_sha256 string"
#: A row's code: its initial (0 s, 1 u, 2 a, 3 other) and these.
IS_TRUNCATED, MUST_GO = 4, 8

Vector = tuple[int, int, int, int]


def damaged(rows: DataFrame) -> DataFrame:
    """conv_id, turn, role, text, lost: rows with faults by crc32 of `conv_id:turn` modulo 20 (0 lost, 1 emptied, 2 without marks, 3 twice, 4 said by the user)."""
    shown = lambda c: F.coalesce(rows[c].cast("string"), F.lit(" "))
    kind = F.crc32(F.concat(shown("conv_id"), F.lit(":"), shown("turn"))) % 20
    text = F.when(kind <= 1, F.lit("")).when(kind == 2, F.translate(shown("text"), ".!?", "")).otherwise(shown("text"))
    role = F.when(kind == 4, F.lit("user")).otherwise(shown("role"))
    times = F.array_repeat(kind == 0, F.when(kind == 3, 2).otherwise(1))
    return rows.select(rows["conv_id"].cast("bigint").alias("conv_id"), rows["turn"].cast("bigint").alias("turn"), role.alias("role"), text.alias("text"), F.explode(times).alias("lost"))


def code() -> Column:
    """What the recursion needs to know of a row, except whether it is a duplicate."""
    inner = F.rtrim(F.col("text"), F.lit(BLANKS))
    initial = F.substring("role", 1, 1)
    letter = F.when(initial == "s", 0).when(initial == "u", 1).when(initial == "a", 2).otherwise(3)
    fault = F.when(inner == "", MUST_GO).when(F.right(inner, F.lit(1)).isin(".", "!", "?"), 0).otherwise(IS_TRUNCATED)
    return (letter + fault).cast("int")


def back(row: int, after: Vector) -> Vector:
    """Least costs before a row from those after it."""
    out = [DELETE + c for c in after]
    if row < MUST_GO:
        extra, letter = (TRUNCATED if row & IS_TRUNCATED else 0), row & 3
        for q in range(4):
            best = REROLE + after[FORCED[q]]
            if letter < 3 and (to := NEXT[q][letter]) is not None:
                best = min(best, after[to])
            out[q] = min(out[q], extra + best)
    u, a = min(out[2], INSERT + out[3]), min(out[3], INSERT + out[2])
    return min(out[0], INSERT + u), min(out[1], INSERT + u), u, a


def walk(rows: list[int], vectors: list[Vector], state: int) -> tuple[str, int]:
    """The letters for some rows and the state after them; vectors: before each row and after the last."""
    out = []
    for i, row in enumerate(rows):
        here, after = vectors[i], vectors[i + 1]
        while True:
            if DELETE + after[state] == here[state]:
                out.append("D")
                break
            if INSERT + here[FORCED[state]] == here[state]:
                out.append("I")
                state = FORCED[state]
                continue
            extra, letter = (TRUNCATED if row & IS_TRUNCATED else 0), row & 3
            to = NEXT[state][letter] if letter < 3 else None
            kept = to is not None and extra + after[to] == here[state]
            out.append("K" if kept else "R")
            state = to if kept else FORCED[state]
            break
    return "".join(out), state


def finish(state: int) -> str:
    """Letters after the last row."""
    return "I" * (END[state] // INSERT)


def block(rows: list[int], after: Vector) -> list[Vector]:
    out = [after]
    for row in reversed(rows):
        out.append(back(row, out[-1]))
    return out[::-1]


def edits(rows: list[int]) -> tuple[str, int]:
    """(letters, cost) of a whole conversation."""
    n = len(rows)
    step = isqrt(n) + 1
    checkpoints, vector = {}, END
    for i in range(n, 0, -1):
        if i % step == 0 or i == n:
            checkpoints[i] = vector
        vector = back(rows[i - 1], vector)
    out, state = [], 0
    for at in range(0, n, step):
        own = rows[at : at + step]
        letters, state = walk(own, block(own, checkpoints[min(at + step, n)]), state)
        out.append(letters)
    return "".join(out) + (finish(state) if n else ""), vector[0]


def lines(letters: str, rows: list[tuple[str, str]], state: int) -> Iterator[str]:
    """The repaired turns, as role:text."""
    at = 0
    for letter in letters:
        if letter == "D":
            at += 1
            continue
        if letter == "I":
            state = FORCED[state]
            yield ROLES[state] + ":"
            continue
        role, text = rows[at]
        at += 1
        if letter == "R":
            state = FORCED[state]
            role = ROLES[state]
        else:
            state = NEXT[state]["sua".index(role[0])]
        yield f"{role}:{text}"


def bad_pairs(letters: list[int]) -> int:
    """Neighbours that don't follow each other as su, ua or au."""
    return sum((a, b) not in ((0, 1), (1, 2), (2, 1)) for a, b in zip(letters, letters[1:]))


def repaired(conv: int | None, turns: list, roles: list[str], texts: list[str], codes: list[int]) -> tuple:
    """The result's row of a conversation whose rows are sorted."""
    seen, counts = set(), [0, 0, 0]
    rows = []
    for role, text, c in zip(roles, texts, codes):
        if c >= MUST_GO:
            counts[0] += 1
        elif (role, text) in seen:
            counts[1] += 1
            c = c & 3 | MUST_GO
        elif c & IS_TRUNCATED:
            counts[2] += 1
        seen.add((role, text))
        rows.append(c)
    letters, cost = edits(rows)
    digest = hashlib.sha256("\n".join(lines(letters, list(zip(roles, texts)), 0)).encode("utf-8", "surrogatepass"))
    known = {t for t in turns if t is not None}
    gaps = min(max(known) - min(known) + 1 - len(known), 2**63 - 1) if known else 0
    return conv, gaps, *counts, bad_pairs([c & 3 for c in rows]), cost, letters, digest.hexdigest()


def table_of(rows: list[tuple]) -> pa.RecordBatch:
    names = [c.split()[0] for c in RESULT.split(", ")]
    kinds = [pa.int64()] * 7 + [pa.string()] * 2
    return pa.record_batch([pa.array([r[i] for r in rows], k) for i, k in enumerate(kinds)], names)


def short(rows: DataFrame) -> DataFrame:
    """Results of conversations whose rows fit in a worker, one conversation at a time."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        conv, held = None, None
        for batch in slices(batches, 4096, 8 << 20):
            out = []
            for name, turn, role, text, lost, c in zip(*(batch[k].to_pylist() for k in ("conv_id", "turn", "role", "text", "lost", "code"))):
                if held is None or name != conv:
                    if held is not None:
                        out.append(repaired(conv, *held))
                    conv, held = name, ([], [], [], [])
                if not lost:
                    for column, value in zip(held, (turn, role, text, c)):
                        column.append(value)
            yield table_of(out)
        yield table_of([] if held is None else [repaired(conv, *held)])

    dealt = rows.withColumn("code", code()).repartition("conv_id")
    return dealt.sortWithinPartitions("conv_id", "turn", "role", "text").mapInArrow(run, RESULT)


def times(matrix: list[int], after: Vector) -> Vector:
    return tuple(min(matrix[4 * q + e] + after[e] for e in range(4)) for q in range(4))


def long(rows: DataFrame, sizes: DataFrame) -> DataFrame:
    """Results of conversations that are cut into blocks. sizes: conv_id, n of each."""
    named = materialize(sizes.select("conv_id", F.ceil(F.sqrt("n")).cast("bigint").alias("step"), F.monotonically_increasing_id().alias("cid")), "long-conversations")
    there = rows.filter(~F.col("lost")).select("*", code().alias("code"))
    keyed = there.join(named.withColumnRenamed("conv_id", "name"), F.col("conv_id").eqNullSafe(F.col("name"))).select("cid", "step", "turn", "role", "text", "code", F.lit(1).alias("one"))
    placed = running(keyed, "turn", {"pos": F.col("one")}, by=("cid",), ties=("role", "text"))
    placed = materialize(placed.select("cid", "turn", "role", "text", "code", F.col("pos").cast("bigint").alias("pos"), F.expr("(pos - 1) div step").alias("chunk"), F.sha2("text", 256).alias("same")), "long-rows")
    firsts = placed.groupBy("cid", "role", "same").agg(F.min("pos").alias("first"))
    again = (F.col("first") < F.col("pos")) & (F.col("code") < MUST_GO)
    flagged = placed.join(firsts, ["cid", "role", "same"]).select("cid", "turn", "chunk", "pos", "role", "text", again.alias("again"), F.when(again, F.col("code").bitwiseAND(F.lit(3)) + MUST_GO).otherwise(F.col("code")).alias("code"))
    flagged = materialize(flagged, "long-rows")

    def summed(group: pd.DataFrame) -> pd.DataFrame:
        codes = group.sort_values("pos")["code"].tolist()
        columns = [block(codes, tuple(0 if e == x else NEVER for x in range(4)))[0] for e in range(4)]
        matrix = [min(columns[e][q], NEVER) for q in range(4) for e in range(4)]
        return pd.DataFrame({"cid": group["cid"].iloc[:1], "chunk": group["chunk"].iloc[:1], "matrix": [matrix], "first": codes[0] & 3, "last": codes[-1] & 3, "illegal": bad_pairs([c & 3 for c in codes])})

    def checkpoints(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values("chunk")
        after, vectors = END, []
        for matrix in reversed(group["matrix"].tolist()):
            vectors.append(list(after))
            after = times(list(matrix), after)
        firsts, lasts = group["first"].tolist(), group["last"].tolist()
        illegal = int(group["illegal"].sum()) + sum(bad_pairs([a, b]) for a, b in zip(lasts, firsts[1:]))
        n = len(group)
        return pd.DataFrame({"cid": group["cid"], "chunk": group["chunk"], "after": vectors[::-1], "final": [False] * (n - 1) + [True], "cost": [after[0]] * n, "illegal": [illegal] * n})

    def walked(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values("pos")
        codes, after = group["code"].tolist(), tuple(map(int, group["after"].iloc[0]))
        vectors = block(codes, after)
        exits, letters = [], []
        for state in range(4):
            made, end = walk(codes, vectors, state)
            exits.append(end)
            letters.append(made + (finish(end) if group["final"].iloc[0] else ""))
        return pd.DataFrame({"cid": group["cid"].iloc[:1], "chunk": group["chunk"].iloc[:1], "exits": [exits], "letters": [letters]})

    def chained(group: pd.DataFrame) -> pd.DataFrame:
        group, state, states = group.sort_values("chunk"), 0, []
        for exits in group["exits"].tolist():
            states.append(state)
            state = int(exits[state])
        return pd.DataFrame({"cid": group["cid"], "chunk": group["chunk"], "state": states})

    def written(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values("pos")
        turns = list(zip(group["role"].tolist(), group["text"].tolist()))
        made = list(lines(group["letters"].iloc[0], turns, int(group["state"].iloc[0])))
        return pd.DataFrame({"cid": group["cid"].iloc[:1], "chunk": group["chunk"].iloc[:1], "some": [bool(made)], "piece": ["\n".join(made)]})

    def digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cid, digest, begun = None, None, False
        for batch in batches:
            out = []
            for name, some, piece in zip(*(batch[k].to_pylist() for k in ("cid", "some", "piece"))):
                if name != cid:
                    if digest is not None:
                        out.append((cid, digest.hexdigest()))
                    cid, digest, begun = name, hashlib.sha256(), False
                if some:
                    digest.update((b"\n" if begun else b"") + piece.encode("utf-8", "surrogatepass"))
                    begun = True
            yield pa.record_batch([pa.array([r[0] for r in out], pa.int64()), pa.array([r[1] for r in out], pa.string())], ["cid", "repaired_sha256"])
        last = [] if digest is None else [(cid, digest.hexdigest())]
        yield pa.record_batch([pa.array([r[0] for r in last], pa.int64()), pa.array([r[1] for r in last], pa.string())], ["cid", "repaired_sha256"])

    blocks = flagged.select("cid", "chunk", "pos", "code")
    sums = blocks.groupBy("cid", "chunk").applyInPandas(summed, "cid bigint, chunk bigint, matrix array<bigint>, first int, last int, illegal bigint")
    ends = materialize(sums.groupBy("cid").applyInPandas(checkpoints, "cid bigint, chunk bigint, after array<bigint>, final boolean, cost bigint, illegal bigint"), "long-checkpoints")
    ways = blocks.join(ends, ["cid", "chunk"]).groupBy("cid", "chunk").applyInPandas(walked, "cid bigint, chunk bigint, exits array<bigint>, letters array<string>")
    ways = materialize(ways, "long-letters")
    states = ways.select("cid", "chunk", "exits").groupBy("cid").applyInPandas(chained, "cid bigint, chunk bigint, state bigint")
    taken = materialize(ways.join(states, ["cid", "chunk"]).select("cid", "chunk", "state", F.element_at("letters", (F.col("state") + 1).cast("int")).alias("letters")), "long-letters")
    pieces = flagged.select("cid", "chunk", "pos", "role", "text").join(taken, ["cid", "chunk"]).groupBy("cid", "chunk").applyInPandas(written, "cid bigint, chunk bigint, some boolean, piece string")
    whole = pieces.repartition("cid").sortWithinPartitions("cid", "chunk").mapInArrow(digests, "cid bigint, repaired_sha256 string")
    audit = taken.groupBy("cid").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("chunk", "letters"))), lambda x: x["letters"]), "").alias("audit"))
    spread = F.max("turn").cast("decimal(20,0)") - F.min("turn") + 1 - F.count_distinct("turn")
    faults = flagged.groupBy("cid").agg(F.coalesce(F.least(spread, F.lit(2**63 - 1)), F.lit(0)).cast("bigint").alias("gaps"), F.count_if((F.col("code") >= MUST_GO) & ~F.col("again")).alias("blank"), F.count_if("again").alias("duplicate"), F.count_if((F.col("code") >= IS_TRUNCATED) & (F.col("code") < MUST_GO)).alias("truncated"))
    costs = ends.filter("final").select("cid", "illegal", "cost")
    # a long conversation that has lost all its rows has no block
    out = named.select("conv_id", "cid").join(faults, "cid", "left").join(costs, "cid", "left").join(audit, "cid", "left").join(whole, "cid", "left")
    counts = [F.coalesce(c, F.lit(0)).cast("bigint").alias(c) for c in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")]
    return out.select("conv_id", *counts, F.coalesce("audit", F.lit("")).alias("audit"), F.coalesce("repaired_sha256", F.lit(hashlib.sha256().hexdigest())).alias("repaired_sha256"))


def repair(rows: DataFrame, long_rows: int = LONG_ROWS, long_bytes: int = LONG_BYTES) -> DataFrame:
    """One row for each conversation of rows (conv_id, turn, role, text, lost), in the columns of RESULT. Rows that are lost only name their conversation."""
    short_batches(rows.sparkSession)
    sizes = rows.groupBy("conv_id").agg(F.count("*").alias("n"), F.sum(F.octet_length("text")).alias("size"))
    large = materialize(sizes.filter((F.col("n") > long_rows) | (F.col("size") > long_bytes)).select(F.col("conv_id").alias("long_id"), "n"), "long-conversations")
    if large.isEmpty():
        return short(rows)
    same = F.col("conv_id").eqNullSafe(F.col("long_id"))
    apart = rows.join(large, same, "left_anti")
    return short(apart).unionByName(long(rows.join(large, same, "left_semi"), large.withColumnRenamed("long_id", "conv_id")))
