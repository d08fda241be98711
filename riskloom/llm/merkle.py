"""Merkle manifest of a table: every row's leaf, its group's root, the root of all groups, and a proof for each row.

A leaf is the SHA-256 of the row's fields, each `-` if null, else its UTF-8 byte count, a colon and its value. Leaves of
a group ascend by the order column. Trees grow by sibling-shift self-joins: at every level a node is equijoined with the
nodes at its computed sibling indices (index XOR 1 for runs of two, slot offsets within the run otherwise), then rows at
slot zero emit the parents. Keys are (group, index), so one group with most of the rows is spread like any other. Each
level is written to the shared folder before the next reads it. What remains of a group is its subroot; subroots, ordered by group, give the root in the same way. Proofs
are handed down from the roots, one equijoin with the parents' proofs for each level, so all of them cost twice the
number of leaves in rows, and no row meets more than its own run.

Positions come from range partitions (`functions.ranking.running`), not from one sorted task.

Rows: each row is a leaf, repeated ones too; equal order values ascend by leaf; nulls come first, as values, groups and
positions; invalid UTF-8 is hashed as it is; texts are hashed where they are read and never shuffled; columns that aren't
listed are ignored; an empty table gives an empty table. Numbers are written as decimals.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from riskloom.functions.ranking import running
from riskloom.llm.common import materialize

ARITY = 2


def field(c: Column) -> Column:
    text = c.cast("string")
    return F.when(text.isNull(), F.lit("-")).otherwise(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text))


def leaf(values: list[Column]) -> Column:
    """The digest of a row, 32 bytes."""
    return F.unhex(F.sha2(F.concat(*[field(c) for c in values]), 256))


def hashed(raw: Column) -> Column:
    """The digest of some digests that follow each other; they count as lowercase hex text."""
    return F.unhex(F.sha2(F.lower(F.hex(raw)), 256))


def joined_digests(found: list[Column]) -> Column:
    return F.concat(*[F.coalesce(c, F.lit(b"")) for c in found])


def with_siblings(nodes: DataFrame, arity: int) -> DataFrame:
    """nodes (grp, idx, n, digest and others), with before and after: the digests of its run's other nodes on either side, one after the other. n: how many nodes the group has at this level; a group's only node has no run."""
    if arity == 2:
        offsets = [F.col("idx").bitwiseXOR(F.lit(1).cast("bigint"))]
    else:
        offsets = [F.col("idx") - F.col("idx") % arity + (F.col("idx") + j) % arity for j in range(1, arity)]
    out = nodes.filter("n > 1").withColumns({f"at_{j}": c for j, c in enumerate(offsets)})
    for j in range(len(offsets)):
        other = nodes.select(F.col("grp").alias("other_grp"), F.col("idx").alias(f"idx_{j}"), F.col("digest").alias(f"digest_{j}"))
        out = out.join(other, (F.col("grp") == F.col("other_grp")) & (F.col(f"at_{j}") == F.col(f"idx_{j}")), "left").drop("other_grp", f"idx_{j}")
    # siblings are offset by 1, 2, ... slots and wrap around: those that wrap come first
    slot = F.col("idx") % arity
    wraps = [slot + j + 1 >= arity for j in range(len(offsets))]
    before = [F.when(w, F.col(f"digest_{j}")) for j, w in enumerate(wraps)]
    after = [F.when(~w, F.col(f"digest_{j}")) for j, w in enumerate(wraps)]
    out = out.select(*nodes.columns, joined_digests(before).alias("before"), joined_digests(after).alias("after"))
    alone = nodes.filter("n = 1").select("*", F.lit(b"").alias("before"), F.lit(b"").alias("after"))
    return out.unionByName(alone)


def levels(nodes: DataFrame, arity: int = ARITY) -> list[DataFrame]:
    """The nodes of every level with their siblings, leaves first."""
    most = nodes.agg(F.max("n")).first()[0] or 0
    out = []
    while most:
        out.append(materialize(with_siblings(nodes, arity), "merkle-level"))
        whole = hashed(F.concat("before", "digest", "after"))
        nodes = out[-1].filter((F.col("n") > 1) & (F.col("idx") % arity == 0))
        nodes = nodes.select("grp", F.expr(f"idx div {arity}").alias("idx"), F.expr(f"(n + {arity - 1}) div {arity}").alias("n"), whole.alias("digest"))
        most = -(-most // arity) if most > 1 else 0
    return out


def subroots(found: list[DataFrame]) -> DataFrame:
    """level, grp, digest: the last node of every group and the level where it stands alone."""
    out = None
    for i, rows in enumerate(found):
        own = rows.filter("n = 1").select(F.lit(i).alias("level"), "grp", "digest")
        out = own if out is None else out.unionByName(own)
    return out


def proofs(found: list[DataFrame], tops: DataFrame, arity: int = ARITY) -> DataFrame:
    """The leaves with path (before and after of each level, from the leaf up) and what tops (level, grp, path and others) hold."""
    handed = [c for c in tops.columns if c not in ("level", "grp")]
    up = None
    for i in range(len(found) - 1, -1, -1):
        rows, top = found[i], tops.filter(F.col("level") == i).select(F.col("grp").alias("top_grp"), *handed)
        last = rows.filter("n = 1").join(top, F.col("grp") == F.col("top_grp")).select(*rows.columns, *handed)
        if up is None:
            up = last
            continue
        parents = up.select(F.col("grp").alias("up_grp"), F.col("idx").alias("up_idx"), *handed)
        inner = rows.filter("n > 1").join(parents, (F.col("grp") == F.col("up_grp")) & (F.expr(f"idx div {arity}") == F.col("up_idx")))
        path = F.concat(F.array(F.struct("before", "after")), "path").alias("path")
        up = inner.select(*rows.columns, *[path if c == "path" else c for c in handed]).unionByName(last)
    return up


def folded(path: Column, start: Column) -> Column:
    """The root that a leaf's digest and its siblings give."""
    return F.aggregate(path, start, lambda digest, step: hashed(F.concat(step["before"], digest, step["after"])))


def proof_digest(path: Column) -> Column:
    """Lowercase hex SHA-256 of all siblings' digests, as hex text, from the leaf to the root and left to right."""
    return F.sha2(F.array_join(F.transform(path, lambda step: F.lower(F.hex(F.concat(step["before"], step["after"])))), ""), 256)


def manifest(rows: DataFrame, group: str, order: str, fields: dict[str, Column], changed: dict[str, Column] | None = None, arity: int = ARITY) -> DataFrame:
    """order column, leaf, subroot, root (32 bytes each), path, other (the leaf with some fields changed), folded_root (from that leaf).

    fields: the columns that a leaf holds, in order; changed: values that other has in place of them.
    """
    both = [leaf(list(fields.values())).alias("digest"), leaf(list((fields | (changed or {})).values())).alias("other")]
    leaves = materialize(rows.select(rows[group].alias("part_of"), rows[order].alias("place"), *both), "merkle-leaves")
    sizes = materialize(leaves.groupBy("part_of").agg(F.count("*").alias("n")), "merkle-groups")
    numbered = running(sizes.withColumn("one", F.lit(1)), "part_of", {"grp": F.col("one")}, whole=True)
    groups = materialize(numbered.select("part_of", "n", F.col("grp").cast("bigint").alias("grp"), F.col("all_grp").cast("bigint").alias("groups")), "merkle-groups")
    placed = running(leaves.withColumn("one", F.lit(1)), "place", {"pos": F.col("one")}, by=("part_of",), ties=("digest",))
    named = groups.select(F.col("part_of").alias("group_name"), "n", "grp")
    placed = placed.join(named, F.col("part_of").eqNullSafe(F.col("group_name")))
    trees = levels(materialize(placed.select("grp", (F.col("pos") - 1).cast("bigint").alias("idx"), "n", "digest", "place", "other"), "merkle-leaves"), arity)
    if not trees:
        return leaves.select(F.col("place").alias(order), F.col("digest").alias("leaf"), F.col("digest").alias("subroot"), F.col("digest").alias("root"), F.expr("array(named_struct('before', digest, 'after', digest))").alias("path"), "other", F.col("digest").alias("folded_root"))
    tops = materialize(subroots(trees), "merkle-subroots")
    top = tops.join(groups.select("grp", "groups"), "grp").select(F.lit(0).cast("bigint").alias("grp"), (F.col("grp") - 1).alias("idx"), F.col("groups").alias("n"), "digest")
    above = levels(materialize(top, "merkle-groups"), arity)
    nothing = F.expr("cast(array() AS array<struct<before: binary, after: binary>>)")
    root = subroots(above).select("level", "grp", nothing.alias("path"), F.col("digest").alias("root"))
    paths = proofs(above, root, arity).select((F.col("idx") + 1).alias("own"), "path", "root")
    tops = tops.join(paths, F.col("grp") == F.col("own")).select("level", "grp", "path", F.col("digest").alias("subroot"), "root")
    out = proofs(trees, materialize(tops, "merkle-subroots"), arity)
    return out.select(F.col("place").alias(order), F.col("digest").alias("leaf"), "subroot", "root", "path", "other", folded(F.col("path"), F.col("other")).alias("folded_root"))
