import corpus_pipeline as cp
from riskloom.llm.common import table
from tests.llm.test_decontaminate import brute as hits
from tests.llm.test_minhash_dedup import brute as classes
from tests.llm.test_suffix_dedup import brute as repeats

SF = "/root/testdata/sf0.001"


def test_stages_in_turn(spark):
    docs = table(spark, SF, "documents")
    texts = {}
    for name, stage in cp.STAGES[:-1]:
        before = [tuple(r) for r in docs.select("doc_id", "text").collect()]
        docs = spark.createDataFrame(stage(spark, docs, SF).collect(), docs.schema)
        assert docs.columns == cp.COLUMNS
        after = dict(docs.select("doc_id", "text").collect())
        if name == "near duplicates":
            assert sorted(after) == sorted({c for _, c in classes(before)})
        elif name == "repeated passages":
            gone = {r[0]: r[2] for r in repeats(before, 200)}
            assert sorted(after) == sorted(gone) and any(gone.values())
            assert all((after[i] == t) == (gone[i] == 0) for i, t in before)
            assert all(r.n_chars == len(r.text) for r in docs.collect())
        elif name == "benchmark":
            items = [tuple(r) for r in table(spark, SF, "benchmark").collect()]
            assert sorted(after) == sorted(r[0] for r in hits(before, items) if not r[-1])
        else:
            assert len(after) > 0.98 * len(before)
        texts = after
    out = cp.STAGES[-1][1](spark, docs, SF).collect()
    assert {r.doc_id for r in out} == set(texts)


def test_odd_rows(spark):
    rows = [(1, None, "en", "s", 0), (2, "", "en", "s", 0), (None, "some words of a text " * 20, None, None, None), (3, "same text with words", "de", "s", 20), (3, "same text with words", "de", "s", 20), (4, "same text with words", "de", "s", 20)]
    schema = "doc_id bigint, text string, lang string, source string, n_chars bigint"
    frame = spark.createDataFrame(rows, schema)
    kept = cp.distinct(spark, frame, SF).collect()
    assert sorted((r.doc_id or 0) for r in kept) == [0, 1, 3]
    for name, stage in cp.STAGES:
        assert stage(spark, frame.limit(0), SF).count() == 0, name
        plain = sorted(map(tuple, stage(spark, frame, SF).collect()), key=repr)
        extra = frame.selectExpr("*", "1 AS row", "'x' AS class_id", "2 AS carried", "3 AS bad_id", "4 AS id")
        assert sorted(map(tuple, stage(spark, extra, SF).collect()), key=repr) == plain, name
        assert len(plain) == {"language": 4, "near duplicates": 3, "repeated passages": 6, "benchmark": 6, "tokens": 6}[name], name


def test_null_and_shared_ids(spark):
    item = table(spark, SF, "benchmark").filter("size(split(text, ' ')) > 12").first().text
    prose = lambda k: " ".join(f"{k}word{i}" for i in range(80))
    rows = [(None, prose("a")), (None, prose("a")), (None, prose("b")), (5, prose("c")), (5, prose("d")), (5, prose("d") + " more"), (7, prose("d")), (3, prose("e")), (None, prose("e")), (None, item), (5, item + " end")]
    frame = spark.createDataFrame([(d, t, "en", "s", len(t)) for d, t in rows], "doc_id bigint, text string, lang string, source string, n_chars bigint")
    kept = cp.distinct(spark, frame, SF).collect()
    assert sorted((r.doc_id or 0, r.text[:5]) for r in kept if "word" in r.text[:5]) == [(0, "aword"), (0, "bword"), (3, "eword"), (5, "cword"), (5, "dword")]
    clean = cp.clean(spark, frame, SF).collect()
    assert sorted((r.doc_id or 0, r.text) for r in clean) == sorted((d or 0, t) for d, t in rows[:-2])


def test_near_duplicates_of_one_template(spark):
    """One row stays of each of the 102 classes that brute force finds in large buckets."""
    from tests.llm.test_minhash_dedup import template

    docs = spark.createDataFrame([(*d, "en", "web", 1) for d in template(300, 8, 12, 6)], "doc_id bigint, text string, lang string, source string, n_chars bigint")
    assert cp.distinct(spark, docs, "").count() == 102
