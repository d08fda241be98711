"""Document quality by a linear-chain conditional random field over lines.

Every line is good or bad. The potential of a line's label comes from features of the line and of its two neighbours
(shares of letters, capitals, digits, marks and blanks, lengths, line ends, each in steps), that of two labels in a row
from a transition matrix. Forward-backward gives each line's marginal; their mean, weighted by line length, is the
document's value, which a logistic curve fitted on the same labelled rows maps to a score.

Training maximises the likelihood of labelled documents all of whose lines bear the document's label. It uses a bounded
sample of labelled rows: about `fit_rows`, drawn by hash of the id, balanced by label, and of these, in the order of the
draw, each that fits into what is left of `fit_lines` lines. So once the bound is near, long texts are passed over and
shorter ones are still taken. Every line of a row that is taken is learned from; the driver gets line features only. Scores always read whole texts and all lines.

Rows: null and empty texts are one empty line; very long texts are chains that are swept in blocks; labels that are null
are never learned from; repeated rows get repeated results and are learned from once; rows that share an id are scored
each by its own text; an empty table gives an empty table; extra columns are ignored; without labels of both kinds every
score is the share of label 1 (1 without any).
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from riskloom.llm.common import short_batches, slices, utf8

LOWER, UPPER, DIGIT, BLANK, STOP, MARK, BAR, OTHER = range(8)
CLASSES = 8


def byte_classes() -> np.ndarray:
    out = np.full(256, MARK)
    out[ord("a") : ord("z") + 1] = LOWER
    out[ord("A") : ord("Z") + 1] = UPPER
    out[ord("0") : ord("9") + 1] = DIGIT
    out[[9, 10, 11, 12, 13, 32]] = BLANK
    out[[ord(c) for c in ".,;:?'\"()-"]] = STOP
    out[ord("|")] = BAR
    out[128:] = OTHER
    return out


TABLE = byte_classes()
#: Steps of the shares of byte classes, of the mean word length and of the line length.
SHARES = np.array([0.0, 0.01, 0.03, 0.08, 0.2, 0.5])
WORDS, LENGTHS = np.array([3.0, 4.5, 6.0, 8.0, 11.0]), np.array([0.0, 8, 30, 90, 270, 800])
OWN = CLASSES * (len(SHARES) + 1) + len(WORDS) + 1 + len(LENGTHS) + 1 + 4
WIDTH = 3 * OWN + 1


def lines(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(document, begin, end) of every line; each document has one line at least."""
    breaks = np.flatnonzero(data == 10)
    begins = np.sort(np.concatenate([offsets[:-1], breaks + 1]), kind="stable")
    doc = np.sort(np.concatenate([np.arange(len(offsets) - 1), np.searchsorted(offsets, breaks, "right") - 1]), kind="stable")
    ends = np.empty_like(begins)
    last = np.append(doc[1:] != doc[:-1], True) if len(doc) else np.zeros(0, bool)
    ends[~last] = begins[1:][~last[:-1]] - 1 if len(doc) else ends[~last]
    ends[last] = offsets[1:][doc[last]]
    return doc, begins, ends


def own_features(data: np.ndarray, begins: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """The columns (of OWN) that hold for each line, a fixed number of them."""
    kinds, n = TABLE[data], len(begins)
    size = ends - begins
    line = np.repeat(np.arange(n), size)
    inside = np.arange(size.sum()) + np.repeat(begins - (np.cumsum(size) - size), size)
    counts = np.bincount(line * CLASSES + kinds[inside], minlength=n * CLASSES).reshape(n, CLASSES)
    share = counts / np.maximum(1, size)[:, None]
    columns, at = [], 0
    for c in range(CLASSES):
        columns.append(at + np.searchsorted(SHARES, share[:, c], "left"))
        at += len(SHARES) + 1
    words = 1 + counts[:, BLANK]
    columns.append(at + np.searchsorted(WORDS, size / words))
    at += len(WORDS) + 1
    columns.append(at + np.searchsorted(LENGTHS, size, "left"))
    at += len(LENGTHS) + 1
    end = np.where(size > 0, kinds[np.minimum(np.maximum(ends - 1, 0), len(kinds) - 1)] if len(kinds) else BLANK, BLANK)
    columns.append(at + np.select([end == STOP, end == MARK, end == BAR], [0, 1, 2], 3))
    return np.stack(columns, 1)


def with_neighbours(own: np.ndarray, doc: np.ndarray) -> np.ndarray:
    """Columns (of WIDTH) of each line and of the lines before and after it; WIDTH - 1 marks a missing neighbour."""
    none = np.full((1, own.shape[1]), WIDTH - 1)
    before, after = np.concatenate([none, own[:-1] + OWN]), np.concatenate([own[1:] + 2 * OWN, none])
    edge = np.append(True, doc[1:] != doc[:-1])
    before[edge] = WIDTH - 1
    after[np.append(edge[1:], True)] = WIDTH - 1
    return np.concatenate([own, before, after], 1)


def sweep(emit: np.ndarray, starts: np.ndarray, sizes: np.ndarray, transition: np.ndarray, before: np.ndarray | None, out: np.ndarray) -> None:
    """Forward messages of pieces of chains into out; before: the message ahead of every piece, None where pieces begin chains."""
    order = np.argsort(-sizes, kind="stable")
    start, longest = starts[order], int(sizes.max(initial=0))
    live = np.searchsorted(-sizes[order], -np.arange(longest), "left")  # pieces longer than t
    state = None if before is None else np.broadcast_to(before, (len(sizes), 2))
    for t in range(longest):
        k = live[t]
        at = start[:k] + t
        state = emit[at] if state is None else emit[at] + np.logaddexp(state[:k, :1] + transition[0], state[:k, 1:] + transition[1])
        out[at] = state


def forward(emit: np.ndarray, sizes: np.ndarray, transition: np.ndarray, block: int = 1024) -> np.ndarray:
    """Forward messages of chains laid end to end. Chains are cut into blocks that are swept side by side, from both labels, and then joined one after another, so a long chain takes few steps."""
    cuts = -(-sizes // block)
    chain = np.repeat(np.arange(len(sizes)), cuts)
    nth = np.arange(len(chain)) - np.repeat(np.cumsum(cuts) - cuts, cuts)
    starts = (np.cumsum(sizes) - sizes)[chain] + nth * block
    lengths = np.minimum(block, sizes[chain] - nth * block)
    out = np.empty_like(emit)
    lead = nth == 0
    sweep(emit, starts[lead], lengths[lead], transition, None, out)
    if lead.all():
        return out
    sides = []
    for one in ([0.0, -np.inf], [-np.inf, 0.0]):
        sides.append(np.empty_like(emit))
        sweep(emit, starts[~lead], lengths[~lead], transition, np.array([one]), sides[-1])
    by_nth = np.argsort(nth, kind="stable")
    ends = np.searchsorted(nth[by_nth], np.arange(nth.max() + 2))
    for i in range(1, nth.max() + 1):
        own = by_nth[ends[i] : ends[i + 1]]
        n = lengths[own]
        at = np.arange(n.sum()) + np.repeat(starts[own] - (np.cumsum(n) - n), n)
        last = np.repeat(out[starts[own] - 1], n, 0)
        out[at] = np.logaddexp(last[:, :1] + sides[0][at], last[:, 1:] + sides[1][at])
    return out


def forward_backward(unary: np.ndarray, sizes: np.ndarray, transition: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(P(good) of each line, summed pair marginals of each document, log normaliser of each document) of chains laid end to end. unary: score of `good` against `bad`, whose score is 0."""
    emit = np.stack([np.zeros_like(unary), unary], 1)
    ahead = forward(emit, sizes, transition)
    back = forward(emit[::-1], sizes[::-1], transition.T)[::-1]  # with the line's own score
    tail = np.cumsum(sizes) - 1
    log_z = np.logaddexp(ahead[tail, 0], ahead[tail, 1])
    z = np.repeat(log_z, sizes)
    inner = np.ones(len(unary), bool)
    inner[tail] = False
    at = np.flatnonzero(inner)
    joint = np.exp(ahead[at][:, :, None] + transition + back[at + 1][:, None, :] - z[at, None, None])
    doc = np.repeat(np.arange(len(sizes)), sizes)[at]
    pairs = np.stack([np.bincount(doc, joint[:, i, j], len(sizes)) for i in (0, 1) for j in (0, 1)], 1).reshape(-1, 2, 2)
    return np.exp(ahead[:, 1] + back[:, 1] - unary - z), pairs, log_z


@dataclass(frozen=True)
class LineModel:
    weights: np.ndarray  # of each feature column, for good against bad
    transition: np.ndarray
    slope: float
    intercept: float

    def values(self, columns: np.ndarray, sizes: np.ndarray, lengths: np.ndarray) -> np.ndarray:
        """Length-weighted mean of the lines' marginals, for each document."""
        good = forward_backward(self.weights[columns].sum(1), sizes, self.transition)[0]
        starts = np.cumsum(sizes) - sizes
        weigh = lengths + 1.0
        return np.add.reduceat(good * weigh, starts) / np.add.reduceat(weigh, starts)

    def scores(self, values: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-(self.slope * (2 * values - 1) + self.intercept)))


def fit(columns: np.ndarray, sizes: np.ndarray, lengths: np.ndarray, labels: np.ndarray, prior: float, steps: int = 150, rate: float = 0.1, shrink: float = 2e-3) -> LineModel:
    """Gradient ascent (Adam) on the mean log likelihood by line; then the logistic curve by Newton steps."""
    y = np.repeat(labels, sizes)
    weights, transition = np.zeros(WIDTH), np.zeros((2, 2))
    flat, per_line = columns.ravel(), columns.shape[1]
    seen = np.zeros((len(sizes), 2, 2))
    seen[np.arange(len(sizes)), labels, labels] = sizes - 1
    moment = [np.zeros(WIDTH + 4), np.zeros(WIDTH + 4)]
    weigh = np.where(labels == 1, 0.5 / max(1, (labels == 1).sum()), 0.5 / max(1, (labels == 0).sum())) / sizes
    by_line = np.repeat(weigh, sizes)
    for step in range(1, steps + 1):
        good, pairs, _ = forward_backward(weights[columns].sum(1), sizes, transition)
        to_weights = np.bincount(flat, np.repeat((y - good) * by_line, per_line), WIDTH)
        to_pairs = ((seen - pairs) * weigh[:, None, None]).sum(0)
        slope = np.concatenate([to_weights - shrink * weights / 10, (to_pairs - shrink * transition).ravel()])
        moment[0] = 0.9 * moment[0] + 0.1 * slope
        moment[1] = 0.99 * moment[1] + 0.01 * slope**2
        move = rate * moment[0] / (1 - 0.9**step) / (np.sqrt(moment[1] / (1 - 0.99**step)) + 1e-9)
        weights, transition = weights + move[:WIDTH], transition + move[WIDTH:].reshape(2, 2)
    model = LineModel(weights, transition, 1.0, 0.0)
    x = 2 * model.values(columns, sizes, lengths) - 1
    case = np.where(labels == 1, prior / max(1e-9, labels.mean()), (1 - prior) / max(1e-9, 1 - labels.mean()))
    design, beta = np.stack([x, np.ones_like(x)], 1), np.zeros(2)
    for _ in range(30):
        p = 1 / (1 + np.exp(-design @ beta))
        hessian = (design * (case * p * (1 - p))[:, None]).T @ design + 1e-3 * np.eye(2)
        beta = beta + np.clip(np.linalg.solve(hessian, design.T @ (case * (labels - p)) - 1e-3 * beta), -2, 2)
    return LineModel(weights, transition, float(beta[0]), float(beta[1]))


def line_table(batch_text: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(columns, lines of each document, bytes of each line)."""
    data, offsets = utf8(batch_text)
    doc, begins, ends = lines(data, offsets)
    return with_neighbours(own_features(data, begins, ends), doc), np.bincount(doc, minlength=len(offsets) - 1), ends - begins


def learn(docs: DataFrame, labels: DataFrame, fit_rows: int = 4000, fit_lines: int = 400_000) -> LineModel | float:
    """Fits to the texts of docs (id, text) that labels (id, label) name; a share of label 1 where there are no two kinds. The rows are drawn from the labels, so at most 2 * fit_rows ids are broadcast to the texts."""
    short_batches(docs.sparkSession)
    usable = labels.filter("label in (0, 1) and id is not null")
    counts = {r["label"]: r["count"] for r in usable.groupBy("label").count().collect()}
    prior = counts.get(1, 0) / sum(counts.values()) if counts else 1.0
    if len(counts) < 2:
        return prior
    draw = F.pmod(F.xxhash64("id", F.lit(23)), F.lit(1 << 20)) / float(1 << 20)
    drawn = usable.filter(draw < F.when(F.col("label") == 1, 0.5 * fit_rows / counts[1]).otherwise(0.5 * fit_rows / counts[0]))
    drawn = drawn.select(F.col("id").alias("_id"), draw.alias("draw"), F.col("label").cast("int").alias("label")).orderBy("draw", "_id", "label").limit(2 * fit_rows)
    texts = docs.select("id", F.coalesce("text", F.lit("")).alias("text"))
    texts = texts.select("id", "text", F.xxhash64("text").alias("hash"))
    chosen = texts.join(F.broadcast(drawn), F.col("id") == F.col("_id"))
    sizes = chosen.select("draw", "id", "hash", "label", (F.length("text") - F.length(F.replace("text", F.lit("\n"), F.lit(""))) + 1).alias("n"))
    picked, lines = {}, 0
    for r in sizes.orderBy("draw", "id", "hash", "label").limit(2 * fit_rows).collect():
        if (r.id, r.hash) not in picked and lines + r.n <= fit_lines:
            picked[r.id, r.hash] = (r.draw, r.label)
            lines += r.n
    if len({label for _, label in picked.values()}) < 2:
        return prior
    known = docs.sparkSession.createDataFrame([(i, h, d, x) for (i, h), (d, x) in picked.items()], "_id bigint, _hash bigint, draw double, label int")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, 256, 4 << 20):
            columns, sizes, lengths = line_table(batch["text"])
            ends = np.cumsum(sizes).tolist()
            parts = [slice(a, b) for a, b in zip([0, *ends], ends)]
            features = [pa.array([x[p].astype(kind).tobytes() for p in parts], pa.binary()) for x, kind in ((columns, np.int16), (lengths, np.int64))]
            yield pa.record_batch([batch["draw"], batch["id"], batch["label"], *features], ["draw", "id", "label", "columns", "lengths"])

    rows = texts.join(F.broadcast(known), (F.col("id") == F.col("_id")) & (F.col("hash") == F.col("_hash"))).select("draw", "id", "hash", "label", "text").dropDuplicates(["id", "hash"])
    held = sorted(rows.select("draw", "id", "label", "text").mapInArrow(run, "draw double, id bigint, label int, columns binary, lengths binary").collect())
    lengths = [np.frombuffer(r.lengths, np.int64) for r in held]
    columns = np.frombuffer(b"".join(r.columns for r in held), np.int16).reshape(sum(map(len, lengths)), -1)
    labels = np.array([r.label for r in held])
    return fit(columns.astype(np.int64), np.array([len(x) for x in lengths]), np.concatenate(lengths), labels, prior)


def score(docs: DataFrame, model: LineModel | float, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id column and score of every document."""
    short_batches(docs.sparkSession)
    held = docs.sparkSession.sparkContext.broadcast(model)
    rows = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = held.value
        for batch in slices(batches, 1024, 2 << 20):
            if isinstance(model, float):
                out = np.full(batch.num_rows, model)
            else:
                out = model.scores(model.values(*line_table(batch["text"])))
            yield pa.record_batch([batch["id"], pa.array(out, pa.float64())], ["id", "score"])

    return rows.mapInArrow(run, f"id {rows.schema['id'].dataType.simpleString()}, score double").withColumnRenamed("id", id_col)
