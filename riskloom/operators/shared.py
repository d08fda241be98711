"""What terms learn from rows, for all terms and all segments in the same passes.

Each pass is one grouped aggregate whose result has a few rows for each segment, so the number of jobs depends neither
on the number of columns nor on that of segments:

1. counts, means, spreads and ends of all columns;
2. moments of all polynomials about the means of pass 1;
3. order statistics of all columns: counts by (segment, column, value), running counts, and the values at the wanted ranks;
4. counts by (segment, column, bin), for given edges and for the fine bins of pass 3, which merged bins are summed from;
5. levels of categorical columns, the rare ones merged before they leave Spark;
6. split trees: running counts by (segment, column, value). Few values are split on the driver; else every round finds
   the best split of all open nodes of all segments and columns in one aggregate, and rounds are as many as leaves.

Rows with several columns are stacked (a row for each column) and pre-aggregated in their task. What depends on a
segment (means, edges) is joined to the rows as a table with a row for each segment.
"""

from __future__ import annotations

import math
from collections import defaultdict

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from riskloom.functions.ranking import release, running
from riskloom.operators.binning import Categorical, Manual, Monotonic, Tree, bin_index, missing, result_of
from riskloom.operators.terms import BSpline, NaturalSpline, Poly, Product, Term, Woe, increasing, inner_shares
from riskloom.sources.store import discard, stored

SEG = "_seg"
#: Bytes of a table that is sent to all tasks; larger ones are joined by a shuffle.
SENT_BYTES = 64 << 20

States = dict[str, tuple]


def leaves_of(terms) -> list[Term]:
    """The terms that learn, operands of products included, each once."""
    out: list[Term] = []
    for t in terms:
        found = leaves_of(t.terms) if isinstance(t, Product) else [t]
        out += [x for x in found if x not in out]
    return [t for t in out if t.packed and not (isinstance(t, Woe) and t.fitted is not None)]


def state_of(term: Term, learned: dict[Term, object]):
    if isinstance(term, Product):
        return tuple(state_of(t, learned) for t in term.terms)
    return term.fitted if isinstance(term, Woe) and term.fitted is not None else learned.get(term)


def learn(terms, df: DataFrame, target: str | None = None, weights: str | None = None, by: Column | None = None) -> States:
    """States of some terms by segment ("" if there is no `by`). Terms of other kinds that override fit() are fitted one by one, but not by segment."""
    terms = tuple(terms)
    rows = df.withColumn(SEG, F.lit("") if by is None else by.cast("string"))
    learning = leaves_of(terms)
    if by is None and not learning:
        return {"": tuple(own_state(t, df, target, weights, {}) for t in terms)}
    sizes = base_figures(learning, rows)
    if not sizes:
        raise ValueError("there are no rows")
    learned: dict[str, dict[Term, object]] = defaultdict(dict)
    polynomials(learning, rows, sizes, learned)
    wanted = {t: shares for t in learning if (shares := shares_of(t))}
    ranks = order_statistics(wanted, rows)
    for t in learning:
        if isinstance(t, (BSpline, NaturalSpline)):
            for seg, figures in sizes.items():
                i = learning.index(t)
                inner = list(t.knots) if t.knots is not None else ranks.get((seg, t), [])
                learned[seg][t] = increasing(t.col, figures[f"low{i}"], inner, figures[f"high{i}"])
    bins = [t for t in learning if isinstance(t, Woe)]
    edged(bins, rows, sizes, ranks, target, weights, learned)
    levels(bins, rows, sizes, target, weights, learned)
    trees(bins, rows, sizes, target, weights, learned)
    if by is not None:
        return {seg: tuple(state_of(t, learned[seg]) for t in terms) for seg in sizes}
    return {"": tuple(own_state(t, df, target, weights, learned[""]) for t in terms)}


def own_state(term: Term, df: DataFrame, target: str | None, weights: str | None, learned: dict):
    if isinstance(term, (Product, Poly, BSpline, NaturalSpline, Woe)):
        return state_of(term, learned)
    return term.fit(df, target, weights)


def joined(rows: DataFrame, values: dict[str, tuple], kind: str) -> DataFrame:
    """rows with the columns of a table that has a row for each segment; rows of other segments go."""
    table = rows.sparkSession.createDataFrame([(seg, *v) for seg, v in values.items()], f"_of string, {kind}")
    size = sum(64 + 16 * sum(len(x) if hasattr(x, "__len__") else 1 for x in v) for v in values.values())
    return rows.join(F.broadcast(table) if size <= SENT_BYTES else table, F.col(SEG) == F.col("_of")).drop("_of")


def base_figures(learning: list[Term], rows: DataFrame) -> dict[str, dict]:
    """Rows of each segment, and what polynomials and splines need of their columns."""
    figures = [F.count("*").alias("n")]
    for i, t in enumerate(learning):
        if isinstance(t, Woe):
            continue
        x = F.col(t.col).cast("double")
        figures += [F.min(x).alias(f"low{i}"), F.max(x).alias(f"high{i}"), F.count_if(x.isNull() | F.isnan(x) | (F.abs(x) == math.inf)).alias(f"bad{i}")]
        if isinstance(t, Poly):
            figures += [F.avg(x).alias(f"mean{i}"), F.stddev_pop(x).alias(f"sd{i}")]
    out = {r[SEG]: r.asDict() for r in rows.groupBy(SEG).agg(*figures).collect()}
    for i, t in enumerate(learning):
        if not isinstance(t, Woe) and any(f[f"bad{i}"] for f in out.values()):
            raise ValueError(f"{t.col} has missing or infinite values")
    return out


def polynomials(learning: list[Term], rows: DataFrame, sizes: dict, learned: dict) -> None:
    polys = [(i, t) for i, t in enumerate(learning) if isinstance(t, Poly)]
    if not polys:
        return
    for i, t in polys:
        if not all(f[f"sd{i}"] for f in sizes.values()):
            raise ValueError(f"poly({t.col}): the column is constant")
    at = joined(rows, {seg: ([v for i, _ in polys for v in (f[f"mean{i}"], f[f"sd{i}"])],) for seg, f in sizes.items()}, "_at array<double>")
    sums = [F.array(*t.moments(F.col("_at")[2 * j], F.col("_at")[2 * j + 1])).alias(f"m{j}") for j, (_, t) in enumerate(polys)]
    for r in at.groupBy(SEG).agg(*sums).collect():
        for j, (i, t) in enumerate(polys):
            figures = sizes[r[SEG]]
            learned[r[SEG]][t] = t.settle(figures[f"mean{i}"], figures[f"sd{i}"], r[f"m{j}"])


def shares_of(term: Term) -> list[float]:
    if isinstance(term, Woe):
        return term.bins.shares() if isinstance(term.bins, Monotonic) else []
    if isinstance(term, (BSpline, NaturalSpline)) and term.knots is None:
        return inner_shares(term.df - (term.degree if isinstance(term, BSpline) else 1))
    return []


def order_statistics(wanted: dict[Term, list[float]], rows: DataFrame) -> dict[tuple[str, Term], list[float]]:
    """Linear quantiles of each term's column in each segment; none where a segment has no value."""
    if not wanted:
        return {}
    columns = list(dict.fromkeys(t.col for t in wanted))
    shares = [sorted({s for t, own in wanted.items() if t.col == c for s in own}) for c in columns]
    stack = F.explode(F.array(*[F.struct(F.lit(i).alias("col"), F.col(c).cast("double").alias("v")) for i, c in enumerate(columns)])).alias("x")
    steps = rows.select(SEG, stack).select(SEG, "x.col", "x.v").filter(F.col("v").isNotNull() & ~F.isnan("v")).groupBy(SEG, "col", "v").agg(F.count("*").alias("c"))
    ranked = running(steps, "v", {"upto": F.col("c")}, by=(SEG, "col"), whole=True)
    own = F.get(F.array(*[F.array(*[F.lit(s) for s in x]) for x in shares]), F.col("col"))
    places = F.transform(own, lambda s: s * (F.col("all_upto") - 1))
    inside = lambda k: (k >= F.col("upto") - F.col("c")) & (k < F.col("upto"))
    hits = F.filter(places, lambda p: inside(F.floor(p)) | inside(F.ceil(p)))
    found = ranked.select(SEG, "col", "v", "upto", "c", F.explode(hits).alias("place")).collect()
    release(ranked)
    ends: dict = {}
    for r in found:
        for k in {math.floor(r.place), math.ceil(r.place)}:
            if r.upto - r.c <= k < r.upto:
                ends.setdefault((r[SEG], r["col"], r.place), {})[k] = r.v
    values: dict = defaultdict(dict)
    for (seg, col, place), at in ends.items():
        low, high = at[math.floor(place)], at[math.ceil(place)]
        values[seg, col][place] = low + (high - low) * (place - math.floor(place))
    out = {}
    for (seg, col), by_place in values.items():
        ordered = dict(zip(shares[col], (by_place[p] for p in sorted(by_place)))) if len(by_place) == len(shares[col]) else None
        for t, asked in wanted.items():
            if t.col == columns[col]:
                out[seg, t] = [ordered[s] for s in asked] if ordered else [by_place[min(by_place)] for _ in asked]
    return out


def masses(target: str, weights: str | None) -> list[Column]:
    w = F.col(weights).cast("double") if weights else F.lit(1.0)
    y = F.col(target).cast("double")
    return [(w * y).alias("e"), (w * (1 - y)).alias("o")]


def sums() -> list[Column]:
    return [F.count("*").alias("n"), F.sum("e").alias("e"), F.sum("o").alias("o")]


def edged(bins: list[Woe], rows: DataFrame, sizes: dict, ranks: dict, target: str, weights: str | None, learned: dict) -> None:
    """Columns with given edges, and those whose fine bins are merged."""
    own = [t for t in bins if isinstance(t.bins, (Manual, Monotonic))]
    if not own:
        return
    cut = [t for t in own if isinstance(t.bins, Monotonic)]
    edges = {seg: {t: sorted(set(ranks.get((seg, t), []))) for t in cut} for seg in sizes}
    if len(sizes) > 1 and cut:
        rows = joined(rows, {seg: tuple(edges[seg][t] for t in cut) for seg in sizes}, ", ".join(f"_e{i} array<double>" for i in range(len(cut))))

    def key(t: Woe) -> Column:
        x = F.col(t.col).cast("double")
        if isinstance(t.bins, Manual):
            at = bin_index(x, t.bins.edges)
        elif len(sizes) == 1:
            at = bin_index(x, tuple(next(iter(edges.values()))[t]))
        else:
            at = F.lit(0)
            for i in range(t.bins.most_edges()):
                at = at + F.coalesce((x > F.get(F.col(f"_e{cut.index(t)}"), F.lit(i))).cast("int"), F.lit(0))
        return F.when(missing(t.col), F.lit(-1)).otherwise(at)

    stack = F.explode(F.array(*[F.struct(F.lit(i).alias("term"), key(t).alias("k")) for i, t in enumerate(own)])).alias("x")
    counted: dict = defaultdict(dict)
    for r in rows.select(SEG, *masses(target, weights), stack).groupBy(SEG, "x.term", "x.k").agg(*sums()).collect():
        counted[r[SEG], r.term][r.k] = r.asDict()
    for i, t in enumerate(own):
        for seg in sizes:
            fine = counted[seg, i]
            learned[seg][t] = result_of(t.bins.edges, list(fine.values())) if isinstance(t.bins, Manual) else t.bins.settle(edges[seg][t], fine)


def levels(bins: list[Woe], rows: DataFrame, sizes: dict, target: str, weights: str | None, learned: dict) -> None:
    own = [t for t in bins if isinstance(t.bins, Categorical)]
    if not own:
        return
    stack = F.explode(F.array(*[F.struct(F.lit(i).alias("term"), F.col(t.col).cast("string").alias("k")) for i, t in enumerate(own)])).alias("x")
    counted = rows.select(SEG, *masses(target, weights), stack).groupBy(SEG, "x.term", "x.k").agg(*sums())
    counted = joined(counted, {seg: (f["n"],) for seg, f in sizes.items()}, "_total bigint")
    kind = F.lit(0)
    for i, t in enumerate(own):
        kind = F.when(F.col("term") == i, t.bins.kind(F.col("_total"))).otherwise(kind)
    merged = counted.withColumn("kind", kind).groupBy(SEG, "term", "kind", F.when(F.col("kind") == 0, F.col("k")).alias("k")).agg(*[F.sum(c).alias(c) for c in ("n", "e", "o")])
    found: dict = defaultdict(list)
    for r in merged.collect():
        found[r[SEG], r.term].append(r)
    for i, t in enumerate(own):
        for seg in sizes:
            learned[seg][t] = t.bins.settle(found[seg, i])


def trees(bins: list[Woe], rows: DataFrame, sizes: dict, target: str, weights: str | None, learned: dict) -> None:
    own = [t for t in bins if isinstance(t.bins, Tree)]
    if not own:
        return
    value = lambda t: F.when(~missing(t.col), F.col(t.col).cast("double")).alias("k")
    stack = F.explode(F.array(*[F.struct(F.lit(i).alias("term"), value(t)) for i, t in enumerate(own)])).alias("x")
    steps = stored(rows.select(SEG, *masses(target, weights), stack).groupBy(SEG, "x.term", "x.k").agg(*sums()), "tree-values")
    none = {(r[SEG], r.term): r.asDict() | {"k": -1} for r in steps.filter("k is null").collect()}
    steps_there = steps.filter("k is not null")
    if steps_there.count() <= min(t.bins.fine_values for t in own):
        cuts = near(own, steps_there)
    else:
        cuts = far(own, steps_there)
    discard(steps)
    for i, t in enumerate(own):
        for seg in sizes:
            edges, counts = cuts.get((seg, i), ((), []))
            learned[seg][t] = result_of(tuple(edges), counts + ([none[seg, i]] if (seg, i) in none else []))


Cuts = dict[tuple[str, int], tuple[list[float], list[dict]]]


def near(own: list[Woe], steps: DataFrame) -> Cuts:
    values: dict = defaultdict(list)
    for r in steps.collect():
        values[r[SEG], r.term].append(r)
    out = {}
    for (seg, i), rows in values.items():
        rows.sort(key=lambda r: r.k)
        edges = sorted(map(float, own[i].bins.near_cuts(rows)))
        counts = [{"k": b, "e": 0.0, "o": 0.0} for b in range(len(edges) + 1)]
        for r in rows:
            at = sum(r.k > e for e in edges)
            counts[at]["e"] += r.e
            counts[at]["o"] += r.o
        out[seg, i] = edges, counts
    return out


def far(own: list[Woe], steps: DataFrame) -> Cuts:
    """The same splits over a table that stays in Spark. A node is the values above one up to another, with running counts at both."""
    spark = steps.sparkSession
    cum = running(steps, "k", {"n_": F.col("n"), "e_": F.col("e"), "o_": F.col("o")}, by=(SEG, "term"))
    table = stored(cum.select(SEG, "term", "k", F.col("n_").alias("n"), F.col("e_").alias("e"), F.col("o_").alias("o")), "tree-table")
    release(cum)
    ends = {(r[SEG], r.term): r.m for r in table.groupBy(SEG, "term").agg(F.max(F.struct("k", "n", "e", "o")).alias("m")).collect()}
    start = (None, 0, 0.0, 0.0)
    leaves = {key: [[None, start, tuple(m)]] for key, m in ends.items()}  # best split, lower end, upper end
    kind = f"{SEG} string, term int, node int, least double, k0 double, n0 bigint, e0 double, o0 double, k1 double, n1 bigint, e1 double, o1 double"

    def impurity(e: Column, o: Column) -> Column:
        return F.when(e + o > 0, 2 * e * o / (e + o)).otherwise(0.0)

    def search(nodes: list[tuple]) -> dict:
        asked = F.broadcast(spark.createDataFrame(nodes, kind))  # two for each segment and column at most
        inside = table.join(asked, [SEG, "term"]).filter((F.col("k0").isNull() | (F.col("k") > F.col("k0"))) & (F.col("k") < F.col("k1")) & (F.col("n") - F.col("n0") >= F.col("least")) & (F.col("n1") - F.col("n") >= F.col("least")))
        gain = impurity(F.col("e1") - F.col("e0"), F.col("o1") - F.col("o0")) - impurity(F.col("e") - F.col("e0"), F.col("o") - F.col("o0")) - impurity(F.col("e1") - F.col("e"), F.col("o1") - F.col("o"))
        best = inside.groupBy(SEG, "term", "node").agg(F.max(F.struct(gain.alias("gain"), (-F.col("k")).alias("minus"), "k", "n", "e", "o")).alias("b"))
        return {(r[SEG], r.term, r.node): r.b for r in best.collect()}

    fresh = [(*key, 0) for key in leaves]
    while fresh:
        nodes = []
        for seg, i, at in fresh:
            _, a, b = leaves[seg, i][at]
            nodes.append((seg, i, at, float(math.floor(own[i].bins.min_samples_leaf * ends[seg, i].n)), *a, *b))
        found = search(nodes)
        fresh_next = []
        for seg, i, at in fresh:
            b = found.get((seg, i, at))
            leaves[seg, i][at][0] = (b.gain, (b.k, b.n, b.e, b.o)) if b else (-math.inf, None)
        for (seg, i) in {(s, t) for s, t, _ in fresh}:
            own_leaves = leaves[seg, i]
            gains = [leaf[0][0] for leaf in own_leaves]
            at = max(range(len(gains)), key=gains.__getitem__)
            if len(own_leaves) < own[i].bins.max_leaves and math.isfinite(gains[at]):
                (_, cut), a, b = own_leaves[at]
                own_leaves[at : at + 1] = [[None, a, cut], [None, cut, b]]
                fresh_next += [(seg, i, at), (seg, i, at + 1)]
        fresh = fresh_next
    cuts = [(seg, i, j, leaf[2][0]) for (seg, i), own_leaves in leaves.items() for j, leaf in enumerate(own_leaves[:-1])]
    above: dict = {}
    if cuts:
        asked = F.broadcast(spark.createDataFrame(cuts, f"{SEG} string, term int, node int, cut double"))
        rows = table.join(asked, [SEG, "term"]).filter("k > cut").groupBy(SEG, "term", "node").agg(F.min("k").alias("k")).collect()
        above = {(r[SEG], r.term, r.node): r.k for r in rows}
    discard(table)
    out = {}
    for (seg, i), own_leaves in leaves.items():
        edges = [(leaf[2][0] + above[seg, i, j]) / 2 for j, leaf in enumerate(own_leaves[:-1])]
        counts = [{"k": j, "e": leaf[2][2] - leaf[1][2], "o": leaf[2][3] - leaf[1][3]} for j, leaf in enumerate(own_leaves)]
        out[seg, i] = edges, counts
    return out
