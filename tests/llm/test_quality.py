import itertools

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from riskloom.llm import quality
from riskloom.llm.common import is_held_out
from riskloom.llm.queries import op4_quality

SF = "/root/testdata/sf0.1"


def test_held_out_ranking(spark):
    truth = dict(spark.read.parquet(f"{SF}/labels.parquet").select("doc_id", "quality").collect())
    rows = [r for r in op4_quality(spark, SF).collect() if r.held_out and r.doc_id in truth]
    good = np.array([r.score for r in rows if truth[r.doc_id] == 1])
    bad = np.array([r.score for r in rows if truth[r.doc_id] == 0])
    assert (good[:, None] > bad).mean() > 0.98
    assert all(r.predicted == (r.score >= 0.3) and 0 <= r.score <= 1 for r in rows)


def test_marginals_against_enumeration():
    rng = np.random.default_rng(0)
    sizes, transition = np.array([3, 1, 5]), rng.normal(size=(2, 2))
    unary = rng.normal(size=9)
    good, pairs, log_z = quality.forward_backward(unary, sizes, transition)
    for d, (n, at) in enumerate(zip(sizes, [0, 3, 4])):
        weight, mean, joint = 0.0, np.zeros(n), np.zeros((2, 2))
        for y in itertools.product((0, 1), repeat=int(n)):
            w = np.exp(sum(unary[at + i] * y[i] for i in range(n)) + sum(transition[a, b] for a, b in zip(y, y[1:])))
            weight, mean = weight + w, mean + w * np.array(y)
            for a, b in zip(y, y[1:]):
                joint[a, b] += w
        assert np.allclose(good[at : at + n], mean / weight) and np.allclose(pairs[d], joint / weight) and np.isclose(log_z[d], np.log(weight))


def test_lines_and_edges(spark):
    columns, sizes, lengths = quality.line_table(pa.array(["a\nbc\n", None, "", "x", "\n\nlast"]))
    assert sizes.tolist() == [3, 1, 1, 1, 3] and lengths.tolist() == [1, 2, 0, 0, 0, 1, 0, 0, 4]
    assert columns.shape == (9, 33)
    rows = [(i, ("A fine line of words, with more words.\n" if i % 3 else "%%% ### |||\n") * (1 + i % 5), int(i % 3 > 0)) for i in range(90)]
    frame = spark.createDataFrame([(*r, "x") for r in [*rows, (99, None, None), (98, "?", 7)]], "id bigint, text string, label int, draw string")
    parts = lambda f: (f.select("id", "text"), f.select("id", "label"))
    model = quality.learn(*parts(frame))
    docs = spark.createDataFrame([(1, None), (2, ""), (3, "A fine line of words."), (3, "A fine line of words."), (None, "||| ###"), (5, "### |||\n" * 30_000)], "doc_id bigint, text string")
    got = {r.doc_id: r.score for r in quality.score(docs, model).collect()}
    assert got[3] > 0.7 and got[None] < 0.3 and got[5] < 0.3 and all(0 <= s <= 1 for s in got.values())
    assert quality.score(docs, model).count() == 6 and quality.score(docs.limit(0), model).count() == 0
    assert quality.learn(*parts(frame.filter("label = 1"))) == 1.0 and quality.learn(*parts(frame.limit(0))) == 1.0
    assert {r.score for r in quality.score(docs, 1.0).collect()} == {1.0}


def test_blocks_of_long_chains():
    rng = np.random.default_rng(5)
    sizes, transition = np.array([1, 700, 2, 64, 65, 129]), rng.normal(size=(2, 2))
    emit = rng.normal(size=(sizes.sum(), 2))
    whole, cut = (quality.forward(emit, sizes, transition, block) for block in (10_000, 64))
    assert np.allclose(whole, cut)
    unary = rng.normal(size=3_000_000)  # one text of three million lines
    good, _, _ = quality.forward_backward(unary, np.array([len(unary)]), transition)
    assert np.isfinite(good).all() and ((good >= 0) & (good <= 1 + 1e-9)).all()


def test_every_line_of_a_drawn_row_is_learned_from(spark):
    """Signs of a label that only stand beyond the 200th line."""
    rows = [(i, "plain words here\n" * 250 + ("GOOD,,\n" if i % 2 else "|||###\n") * 250, i % 2) for i in range(40)]
    frame = spark.createDataFrame(rows, "id bigint, text string, label int")
    model = quality.learn(frame.select("id", "text"), frame.select("id", "label"))
    got = {r.id: r.score for r in quality.score(frame, model, id_col="id").collect()}
    assert min(got[i] for i in range(1, 40, 2)) > max(got[i] for i in range(0, 40, 2))
    few = quality.learn(frame.select("id", "text"), frame.select("id", "label"), fit_lines=3000)
    assert isinstance(few, quality.LineModel) and quality.learn(frame.select("id", "text"), frame.select("id", "label"), fit_lines=600) == 0.5


def test_scores_recomputed_plainly(spark):
    """The whole score of every document of the small table, line by line and label by label."""
    sf = "/root/testdata/sf0.001"
    docs, labels = spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/labels.parquet")
    learned = labels.filter(~is_held_out(F.col("doc_id"))).select(F.col("doc_id").alias("id"), F.col("quality").alias("label"))
    model = quality.learn(docs.select(F.col("doc_id").alias("id"), "text"), learned)
    steps = lambda cuts, x: sum(c < x for c in cuts)

    def own(line):
        kinds = [int(quality.TABLE[b]) for b in line]
        out, at = [], 0
        for c in range(quality.CLASSES):
            out.append(at + steps(quality.SHARES, kinds.count(c) / max(1, len(kinds))))
            at += len(quality.SHARES) + 1
        out.append(at + steps(quality.WORDS, len(kinds) / (1 + kinds.count(quality.BLANK))))
        at += len(quality.WORDS) + 1
        out.append(at + steps(quality.LENGTHS, len(kinds)))
        at += len(quality.LENGTHS) + 1
        end = kinds[-1] if kinds else quality.BLANK
        return [*out, at + {quality.STOP: 0, quality.MARK: 1, quality.BAR: 2}.get(end, 3)]

    def plain(text):
        lines = (text or "").encode().split(b"\n")
        owns, missing = [own(x) for x in lines], [quality.WIDTH - 1] * len(own(b""))
        score = []
        for i in range(len(lines)):
            near = [x + quality.OWN for x in owns[i - 1]] if i else missing
            after = [x + 2 * quality.OWN for x in owns[i + 1]] if i + 1 < len(lines) else missing
            score.append(float(model.weights[[*owns[i], *near, *after]].sum()))
        ahead = [np.array([0.0, score[0]])]
        for x in score[1:]:
            ahead.append(np.array([0.0, x]) + np.logaddexp(ahead[-1][0] + model.transition[0], ahead[-1][1] + model.transition[1]))
        back = [np.zeros(2)]
        for x in score[:0:-1]:
            to = back[-1] + np.array([0.0, x])
            back.append(np.logaddexp(model.transition[:, 0] + to[0], model.transition[:, 1] + to[1]))
        both = [a + b for a, b in zip(ahead, back[::-1])]
        good = [float(np.exp(x[1] - np.logaddexp(x[0], x[1]))) for x in both]
        value = np.average(good, weights=[len(x) + 1 for x in lines])
        return 1 / (1 + np.exp(-(model.slope * (2 * value - 1) + model.intercept)))

    got = {r.doc_id: r.score for r in op4_quality(spark, sf).collect()}
    for doc_id, text in docs.select("doc_id", "text").collect():
        assert abs(got[doc_id] - plain(text)) < 1e-6
