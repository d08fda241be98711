import numpy as np
from pyspark.sql import functions as F

from riskloom.llm import langid
from riskloom.llm.common import is_held_out
from riskloom.llm.queries import op6_langid

SF = "/root/testdata/sf0.01"


def test_held_out_accuracy(spark):
    truth = dict(spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "lang").collect())
    rows = op6_langid(spark, SF).collect()
    assert len(rows) == len(truth) and all(0 <= r.score <= 1 for r in rows)
    held = [r for r in rows if r.held_out]
    assert np.mean([truth[r.doc_id] == r.lang_pred for r in held]) > 0.98


def test_kernel_is_the_blended_presence_kernel():
    a, b = "the cat", "the bat"
    grams = lambda t, n: {t[i : i + n] for i in range(len(t) - n + 1)}
    want = np.mean([len(grams(a, n) & grams(b, n)) / np.sqrt(len(grams(a, n)) * len(grams(b, n))) for n in (1, 2, 3)])
    x = langid.features(langid.presence([a, b]))
    assert abs(float(x[0] @ x[1]) - want) < 1e-6
    assert (langid.presence(["The  cat!"]) == langid.presence(["the cat?"])).all()


def test_edges(spark):
    train = [(i, "the of and with that " * (1 + i % 3) if i % 2 else "der die und mit das " * (1 + i % 3), "en" if i % 2 else "de") for i in range(40)]
    train += [(100, None, "en"), (101, "no language", None), (102, "rare words", "xx")]
    frame = spark.createDataFrame([(*t, "x") for t in train], "id bigint, text string, lang string, draw string")
    model = langid.learn(frame)
    assert model.languages == ["de", "en", "xx"]
    docs = spark.createDataFrame([(1, None), (2, ""), (3, "12 !?"), (4, "and with that"), (4, "and with that"), (None, "und mit\0 das"), (5, "der und die " * 50_000)], "doc_id bigint, text string")
    got = sorted((r.doc_id or 0, r.lang_pred, r.score > 0) for r in langid.identify(docs, model).collect())
    assert got == [(0, "de", True), (1, "und", False), (2, "und", False), (3, "und", False), (4, "en", True), (4, "en", True), (5, "de", True)]
    assert langid.learn(frame.limit(0)) is None
    assert {r.lang_pred for r in langid.identify(docs, None).collect()} == {"und"}
    assert langid.identify(docs.limit(0), model).count() == 0


def test_scores_recomputed_plainly(spark):
    """The whole score of every document of the small table, n-gram by n-gram."""
    sf = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    model = langid.learn(docs.filter(~is_held_out(F.col("doc_id"))).select(F.col("doc_id").alias("id"), "text", "lang"))
    got = {r.doc_id: (r.lang_pred, r.score) for r in op6_langid(spark, sf).collect()}

    def plain(text):
        t = "".join(" " if (c < "\u00c0" and not "a" <= c <= "z") or "\u2000" <= c < "\u2070" else c for c in text.lower())
        while "  " in t:
            t = t.replace("  ", " ")
        z, before = model.bias.astype(float), 0
        for order, places in enumerate(langid.PLACES):
            seen = set()
            for i in range(len(t) - order):
                h = ord(t[i])
                for c in t[i + 1 : i + order + 1]:
                    h = (h * 0x9E3779B1 + ord(c) * 0x85EBCA77) % 2**32
                mixed = (h ^ h >> 15) * 0x2C1B3C6D % 2**32
                seen.add(before + (mixed >> 12 & places - 1))
            z = z + model.weights[sorted(seen)].astype(float).sum(0) / np.sqrt(3 * max(1, len(seen)))
            before += places
        e = np.exp(6 * z - (6 * z).max())
        return model.languages[int(e.argmax())], float(e.max() / e.sum())

    for doc_id, text in docs.select("doc_id", "text").collect():
        if text and langid.LETTER.search(text):
            lang, score = plain(text)
            assert got[doc_id][0] == lang and abs(got[doc_id][1] - score) < 1e-3
        else:
            assert got[doc_id] == ("und", 0.0)
