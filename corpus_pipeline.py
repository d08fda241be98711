"""A corpus pipeline of training-data operators. Each stage takes (spark, docs, sf_dir); its rows are written as Parquet
and read again as the next stage's documents, which keep the columns doc_id, text, lang, source and n_chars until the
last stage turns them into tokens.

Rows, in every stage: rows are judged each by its own text, also where ids are null or shared; a null text counts as
empty; other columns, whatever their names, are dropped; an empty table gives an empty table; very long texts are read
whole; of equal candidates to stay, the row with the smallest id does, null ids last, then the first by position."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from riskloom.llm import bpe, decontaminate, langid, minhash_dedup, suffix_dedup
from riskloom.llm.common import is_held_out, materialize, table
from riskloom.llm.queries import VOCAB

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]
#: A document goes if its language is undetermined or less sure than this.
LEAST_SURE = 0.3
#: Words and chunks whose ids a worker keeps; few, as workers also serve the other stages.
WORDS_KEPT = 80_000


def identified(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents whose language can't be told: no letter (so null and empty texts go), or a share below LEAST_SURE."""
    model = langid.learn(docs.filter(~is_held_out(F.col("doc_id"))).select(F.col("doc_id").alias("id"), "text", "lang"))
    found = langid.identify(docs, model, keep=COLUMNS)
    return found.filter((F.col("lang_pred") != langid.UNDETERMINED) & (F.col("score") >= LEAST_SURE)).select(*COLUMNS)


def distinct(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one row of each class of near duplicates: the one with the smallest id, null last. Where ids are null or repeated, a copy of the rows gets numbers, and classes are those of rows."""
    odd = docs.groupBy("doc_id").count().filter("count > 1 or doc_id is null")
    if odd.isEmpty():
        gone = materialize(minhash_dedup.classes(docs).filter("doc_id != class_id").select("doc_id").distinct(), "near-duplicates")
        return docs.select(*COLUMNS).join(gone, "doc_id", "left_anti").select(*COLUMNS)
    rows = materialize(docs.select(*COLUMNS, F.monotonically_increasing_id().alias("row")), "rows")  # ids don't tell rows apart
    found = minhash_dedup.classes(rows, id_col="row").join(rows.select("row", "doc_id"), "row")
    first = F.min(F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "row"))
    kept = materialize(found.groupBy("class_id").agg(first.alias("first")).select("first.row"), "near-duplicates")
    return rows.join(kept, "row", "left_semi").select(*COLUMNS)


def without_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Cuts passages that repeat, in this row or any other (all occurrences go); a character that a cut splits becomes a replacement character; a text that is cut whole stays as an empty one."""
    out = suffix_dedup.drop_repeats(docs, keep=["doc_id", "lang", "source"])
    text = F.make_valid_utf8(F.col("kept").cast("string"))
    return out.select("doc_id", text.alias("text"), "lang", "source").withColumn("n_chars", F.length("text").cast("bigint")).select(*COLUMNS)


def clean(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents that hold a window of a benchmark item; id and text together tell rows apart."""
    keyed = docs.select(*COLUMNS, F.struct("doc_id", F.xxhash64("text").alias("hash")).alias("row"))
    found = decontaminate.contaminated(keyed, table(spark, sf_dir, "benchmark"), id_col="row")
    bad = materialize(found.filter(F.size("items") > 0).select(F.col("row.doc_id").alias("bad_id"), F.col("row.hash").alias("bad_hash")).distinct(), "contaminated")
    same = F.col("doc_id").eqNullSafe(F.col("bad_id")) & (F.xxhash64("text") == F.col("bad_hash"))
    return docs.select(*COLUMNS).join(bad, same, "left_anti").select(*COLUMNS)


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The ids of every document, with digests of ids and decoded text: a row for each row, also for empty texts."""
    out = bpe.encode_decode(docs, VOCAB, cached=WORDS_KEPT)
    return out.select("doc_id", "n_tokens", F.sha2("ids", 256).alias("ids_sha256"), F.sha2(F.encode("decoded", "utf-8"), 256).alias("decoded_sha256"))


STAGES = [("language", identified), ("near duplicates", distinct), ("repeated passages", without_repeats), ("benchmark", clean), ("tokens", tokens)]

#: Trained models, suffix arrays and BPE can't be said in SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the table documents, in order; each one's rows are written before the next reads them."""
    docs = table(spark, sf_dir, "documents")
    for i, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i + 1 < len(STAGES):
            docs = materialize(docs, "stage-" + name.replace(" ", "-"))
    return docs
