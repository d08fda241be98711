"""Registered queries of this subpackage and, where SQL can express them, their SQL twins."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from riskloom.llm import bpe, decontaminate, inner_product, langid, licenses, merkle, minhash_dedup, quality, simhash_dedup, suffix_dedup, token_store, turns, warc
from riskloom.llm.common import is_held_out, table

VOCAB = public_tokenizers.path("byte_bpe_50k.json")

Query = Callable[[SparkSession, str], DataFrame]


def op1_inner_product(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = inner_product.scaled(table(spark, sf_dir, "embeddings"), "vec_id", "embedding", 256)
    return inner_product.top_k(vectors.filter("id % 50 = 0"), vectors, 5)


def op2_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.archive_and_read(spark, table(spark, sf_dir, "pages")).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op3_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = licenses.scan(table(spark, sf_dir, "documents"))
    return out.withColumn("notices", F.array_join("notices", ","))


def op4_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    learned = labels.filter(~is_held_out(F.col("doc_id"))).select(F.col("doc_id").alias("id"), F.col("quality").alias("label"))
    model = quality.learn(docs.select(F.col("doc_id").alias("id"), "text"), learned)
    out = quality.score(docs, model)
    return out.select("doc_id", is_held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= 0.3).cast("int").alias("predicted"))


def op5_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = suffix_dedup.drop_repeats(table(spark, sf_dir, "documents"))
    n_removed = F.col("n_bytes") - F.octet_length("kept")
    return out.select("doc_id", "n_bytes", n_removed.cast("bigint").alias("n_removed"), F.size("removed_from").cast("bigint").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"))


def op6_langid(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = langid.learn(docs.filter(~is_held_out(F.col("doc_id"))).select(F.col("doc_id").alias("id"), "text", "lang"))
    return langid.identify(docs, model).select("doc_id", is_held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score")


def op7_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = bpe.encode_decode(table(spark, sf_dir, "documents"), VOCAB)
    return out.select("doc_id", "n_tokens", F.sha2("ids", 256).alias("ids_sha256"), F.sha2(F.encode("decoded", "utf-8"), 256).alias("decoded_sha256"))


def op8_minhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash_dedup.classes(table(spark, sf_dir, "documents"))


def op9_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = decontaminate.contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    n_hit = F.aggregate(F.zip_with("hit_from", "hit_to", lambda a, b: b - a), F.lit(0).cast("bigint"), lambda x, y: x + y)
    names = F.array_join(F.array_sort(F.col("items").cast("array<string>")), ",")
    return out.select("doc_id", "n_words", n_hit.alias("n_hit"), F.size("items").cast("bigint").alias("n_items"), F.sha2(names, 256).alias("items_sha256"), (n_hit > 0).alias("contaminated"))


def op10_token_store(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = token_store.store_and_read(spark, table(spark, sf_dir, "documents"), VOCAB, end_id=2)
    return out.select("doc_id", "start", "n_tokens", F.crc32("ids").alias("ids_crc32"))


def op11_merkle(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    fields = {c: docs[c] for c in ("doc_id", "source", "lang", "n_chars", "text")}
    tampered = F.crc32(docs["doc_id"].cast("string")) % 7 == 0
    more = docs["n_chars"].cast("decimal(20,0)")
    changed = {"n_chars": F.when(tampered, more + 1).otherwise(more).cast("decimal(20,0)")}
    out = merkle.manifest(docs, "lang", "doc_id", fields, changed)
    text = lambda c: F.lower(F.hex(c)).alias(c)
    return out.select("doc_id", text("leaf"), text("subroot"), text("root"), merkle.proof_digest(F.col("path")).alias("proof_sha256"), text("folded_root"), (F.col("folded_root") == F.col("root")).alias("verified"))


def op12_simhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = simhash_dedup.fuzzy_classes(table(spark, sf_dir, "documents"))
    return out.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), F.col("component").alias("component_id"))


def op13_conversations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return turns.repair(turns.damaged(table(spark, sf_dir, "conversations")))


QUERIES: dict[str, Query] = {
    "op10_token_store": op10_token_store,
    "op11_merkle": op11_merkle,
    "op12_simhash_dedup": op12_simhash_dedup,
    "op13_conversations": op13_conversations,
    "op1_inner_product": op1_inner_product,
    "op2_warc": op2_warc,
    "op3_licenses": op3_licenses,
    "op4_quality": op4_quality,
    "op5_suffix_dedup": op5_suffix_dedup,
    "op6_langid": op6_langid,
    "op7_bpe": op7_bpe,
    "op8_minhash_dedup": op8_minhash_dedup,
    "op9_decontaminate": op9_decontaminate,
}

SQL: dict[str, str] = {
    "op1_inner_product": """
        WITH v AS (
            SELECT vec_id, list_transform(embedding, lambda x: floor(256 * CAST(x AS DOUBLE))) AS v FROM embeddings
            WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
        ), s AS (
            SELECT q.vec_id AS query_id, c.vec_id, CAST(list_dot_product(q.v, c.v) AS BIGINT) AS score
            FROM (SELECT DISTINCT vec_id, v FROM v) q JOIN v c ON q.vec_id <> c.vec_id AND len(q.v) = len(c.v) WHERE q.vec_id % 50 = 0
        )
        SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank, vec_id, score
        FROM s QUALIFY rank <= 5
    """,
    "op2_warc": """
        WITH p AS (
            SELECT page_id, sha1(coalesce(html, '')) AS h, strlen(coalesce(html, '')) AS n,
                min(page_id) OVER (PARTITION BY sha1(coalesce(html, ''))) AS first FROM pages
        ), b AS (
            SELECT *, array_to_string(list_transform(range(1, 41), lambda i: ['0000', '0001', '0010', '0011', '0100', '0101', '0110', '0111', '1000', '1001', '1010', '1011', '1100', '1101', '1110', '1111'][instr('0123456789abcdef', substr(h, i, 1))]), '') AS bits FROM p
        )
        SELECT page_id, CAST(n AS BIGINT) AS payload_bytes,
            array_to_string(list_transform(range(0, 32), lambda j: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', CAST(1 + 16 * CAST(substr(bits, 5 * j + 1, 1) AS INTEGER) + 8 * CAST(substr(bits, 5 * j + 2, 1) AS INTEGER) + 4 * CAST(substr(bits, 5 * j + 3, 1) AS INTEGER) + 2 * CAST(substr(bits, 5 * j + 4, 1) AS INTEGER) + CAST(substr(bits, 5 * j + 5, 1) AS INTEGER) AS BIGINT), 1)), '') AS payload_digest,
            CASE WHEN page_id > first THEN 'revisit' ELSE 'response' END AS record_type,
            CASE WHEN page_id > first THEN first END AS refers_to
        FROM b
    """,
    "op3_licenses": licenses.scan_sql(),
    "op11_merkle": """
        WITH RECURSIVE f AS (
            SELECT doc_id, lang, n_chars, CASE WHEN crc % 7 = 0 THEN CAST(n_chars AS HUGEINT) + 1 ELSE n_chars END AS changed,
                concat(coalesce(strlen(CAST(doc_id AS VARCHAR)) || ':' || doc_id, '-'), coalesce(strlen(source) || ':' || source, '-'), coalesce(strlen(lang) || ':' || lang, '-')) AS head,
                coalesce(strlen(text) || ':' || text, '-') AS tail
            FROM (SELECT *, xor(4294967295, list_reduce(list_transform(range(1, strlen(CAST(doc_id AS VARCHAR)) + 1), lambda i: CAST(ascii(substr(CAST(doc_id AS VARCHAR), i, 1)) AS BIGINT)),
                lambda c, b: list_reduce(range(8), lambda d, i: xor(d >> 1, 3988292384 * (d & 1)), xor(c, b)), 4294967295)) AS crc FROM documents)
        ), l AS (
            SELECT doc_id, lang, sha256(head || coalesce(strlen(CAST(n_chars AS VARCHAR)) || ':' || n_chars, '-') || tail) AS leaf,
                sha256(head || coalesce(strlen(CAST(changed AS VARCHAR)) || ':' || changed, '-') || tail) AS other FROM f
        ), d AS (
            SELECT *, row_number() OVER (PARTITION BY lang ORDER BY doc_id NULLS FIRST, leaf) - 1 AS idx, count(*) OVER (PARTITION BY lang) AS n, row_number() OVER () AS id FROM l
        ), nodes(level, lang, idx, n, h) AS (
            SELECT 0, lang, idx, n, leaf FROM d
            UNION ALL
            SELECT level + 1, lang, idx // 2, (min(n) + 1) // 2, sha256(string_agg(h, '' ORDER BY idx)) FROM nodes WHERE n > 1 GROUP BY level, lang, idx // 2
        ), tops AS (
            SELECT lang, level AS height, h AS subroot, row_number() OVER (ORDER BY lang NULLS FIRST) - 1 AS g, count(*) OVER () AS m FROM nodes WHERE n = 1
        ), above(level, idx, n, h) AS (
            SELECT 0, g, m, subroot FROM tops
            UNION ALL
            SELECT level + 1, idx // 2, (min(n) + 1) // 2, sha256(string_agg(h, '' ORDER BY idx)) FROM above WHERE n > 1 GROUP BY level, idx // 2
        ), last AS (SELECT level AS height, h AS root FROM above WHERE n = 1
        ), steps AS (
            SELECT d.id, s.level, s.h, s.idx < (d.idx >> s.level) AS before FROM d JOIN tops t ON t.lang IS NOT DISTINCT FROM d.lang
            JOIN nodes s ON s.lang IS NOT DISTINCT FROM d.lang AND s.idx = xor(d.idx >> s.level, 1) AND s.level < t.height
            UNION ALL
            SELECT d.id, t.height + s.level, s.h, s.idx < (t.g >> s.level) FROM d JOIN tops t ON t.lang IS NOT DISTINCT FROM d.lang
            JOIN above s ON s.idx = xor(t.g >> s.level, 1), last WHERE s.level < last.height
        ), every AS (
            SELECT d.id, t.subroot, last.root, r.level FROM d JOIN tops t ON t.lang IS NOT DISTINCT FROM d.lang, last, range(t.height + last.height) r(level)
        ), paths AS (
            SELECT e.id, string_agg(coalesce(s.h, ''), '' ORDER BY e.level) AS proof, list(CASE WHEN s.h IS NULL THEN '-' WHEN s.before THEN '<' || s.h ELSE '>' || s.h END ORDER BY e.level) AS path
            FROM every e LEFT JOIN steps s ON s.id = e.id AND s.level = e.level GROUP BY e.id
        ), out AS (
            SELECT d.doc_id, d.leaf, t.subroot, last.root, sha256(coalesce(p.proof, '')) AS proof_sha256,
                list_reduce(coalesce(p.path, []), lambda a, x: sha256(CASE x[1] WHEN '-' THEN a WHEN '<' THEN x[2:] || a ELSE a || x[2:] END), d.other) AS folded_root
            FROM d JOIN tops t ON t.lang IS NOT DISTINCT FROM d.lang LEFT JOIN paths p ON p.id = d.id, last
        )
        SELECT *, folded_root = root AS verified FROM out
    """,
    "op13_conversations": r"""
        WITH RECURSIVE given AS (
            SELECT *, xor(4294967295, list_reduce(list_transform(range(1, strlen(k) + 1), lambda i: CAST(ascii(substr(k, i, 1)) AS BIGINT)),
                lambda c, b: list_reduce(range(8), lambda d, i: xor(d >> 1, 3988292384 * (d & 1)), xor(c, b)), 4294967295)) % 20 AS kind
            FROM (SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text, concat(coalesce(CAST(conv_id AS VARCHAR), ' '), ':', coalesce(CAST(turn AS VARCHAR), ' ')) AS k FROM conversations)
        ), convs AS (
            SELECT conv_id, row_number() OVER () AS c FROM (SELECT DISTINCT conv_id FROM conversations)
        ), hurt AS (
            SELECT c, turn, CASE WHEN kind = 4 THEN 'user' ELSE role END AS role, CASE kind WHEN 1 THEN '' WHEN 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text
            FROM given JOIN convs ON given.conv_id IS NOT DISTINCT FROM convs.conv_id, range(CASE WHEN kind = 3 THEN 2 ELSE 1 END) WHERE kind <> 0
        ), placed AS (
            SELECT *, row_number() OVER (PARTITION BY c ORDER BY turn NULLS FIRST, role, text) AS i, count(*) OVER (PARTITION BY c) AS n FROM hurt
        ), told AS (
            SELECT *, role[1] AS r, lag(role[1]) OVER (PARTITION BY c ORDER BY i) AS before,
                CASE WHEN NOT regexp_matches(text, '[^\x20\x09-\x0D]') THEN 'blank' WHEN row_number() OVER (PARTITION BY c, role, text ORDER BY i) > 1 THEN 'duplicate'
                    WHEN NOT regexp_matches(text, '[.!?][\x20\x09-\x0D]*$') THEN 'truncated' ELSE '' END AS fault FROM placed
        ), steps AS (
            SELECT *, fault IN ('blank', 'duplicate') AS goes, CASE WHEN fault = 'truncated' THEN 3 ELSE 0 END AS extra FROM told
        ), best(c, i, v) AS (
            SELECT c, max(n) + 1, [0, 6, 3, 0] FROM steps GROUP BY c
            UNION ALL
            SELECT c, i, [least(w[1], 3 + u), least(w[2], 3 + u), u, least(w[4], 3 + w[3])] FROM (
                SELECT *, least(w[3], 3 + w[4]) AS u FROM (
                    SELECT s.c, s.i, CASE WHEN goes THEN list_transform(v, lambda x: 4 + x) ELSE [
                        least(4 + v[1], extra + 3 + v[3], CASE r WHEN 's' THEN extra + v[2] WHEN 'u' THEN extra + v[3] ELSE 99 + v[1] END),
                        least(4 + v[2], extra + 3 + v[3], CASE r WHEN 'u' THEN extra + v[3] ELSE 99 + v[2] END),
                        least(4 + v[3], extra + 3 + v[4], CASE r WHEN 'a' THEN extra + v[4] ELSE 99 + v[3] END),
                        least(4 + v[4], extra + 3 + v[3], CASE r WHEN 'u' THEN extra + v[3] ELSE 99 + v[4] END)] END AS w
                    FROM best b JOIN steps s ON s.c = b.c AND s.i = b.i - 1))
        ), walked(c, i, q, audit, said) AS (
            SELECT c, CAST(1 AS BIGINT), 1, '', CAST([] AS VARCHAR[]) FROM convs
            UNION ALL
            SELECT c, CASE WHEN e = 'I' THEN i ELSE i + 1 END, CASE e WHEN 'D' THEN q WHEN 'K' THEN kept ELSE forced END, audit || e,
                CASE e WHEN 'D' THEN said WHEN 'K' THEN list_append(said, role || ':' || text)
                    WHEN 'I' THEN list_append(said, CASE forced WHEN 3 THEN 'user:' ELSE 'assistant:' END) ELSE list_append(said, CASE forced WHEN 3 THEN 'user:' ELSE 'assistant:' END || text) END
            FROM (SELECT *, CASE WHEN 4 + a[q] = h[q] THEN 'D' WHEN 3 + h[forced] = h[q] THEN 'I' WHEN extra + a[kept] = h[q] THEN 'K' ELSE 'R' END AS e FROM (
                SELECT w.*, s.role, s.text, s.extra, b.v AS h, x.v AS a, CASE q WHEN 3 THEN 4 ELSE 3 END AS forced,
                    CASE WHEN q = 1 AND r = 's' THEN 2 WHEN q <> 3 AND r = 'u' THEN 3 WHEN q = 3 AND r = 'a' THEN 4 END AS kept
                FROM walked w JOIN best b ON b.c = w.c AND b.i = w.i LEFT JOIN best x ON x.c = w.c AND x.i = w.i + 1 LEFT JOIN steps s ON s.c = w.c AND s.i = w.i
                WHERE x.i IS NOT NULL OR q IN (2, 3)))
        ), done AS (
            SELECT w.* FROM walked w LEFT JOIN (SELECT c, max(n) AS n FROM steps GROUP BY c) l ON l.c = w.c WHERE w.i = coalesce(l.n, 0) + 1 AND q IN (1, 4)
        ), counted AS (
            SELECT c, max(turn) - min(turn) + 1 - count(DISTINCT turn) AS gaps, count(*) FILTER (fault = 'blank') AS blank, count(*) FILTER (fault = 'duplicate') AS duplicate, count(*) FILTER (fault = 'truncated') AS truncated,
                count(*) FILTER (i > 1 AND before || r NOT IN ('su', 'ua', 'au')) AS illegal FROM steps GROUP BY c
        )
        SELECT conv_id, CAST(coalesce(gaps, 0) AS BIGINT) AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate, coalesce(truncated, 0) AS truncated, coalesce(illegal, 0) AS illegal,
            CAST(coalesce(b.v[1], 0) AS BIGINT) AS cost, d.audit, sha256(array_to_string(d.said, chr(10))) AS repaired_sha256
        FROM convs LEFT JOIN counted n ON n.c = convs.c LEFT JOIN best b ON b.c = convs.c AND b.i = 1 JOIN done d ON d.c = convs.c
    """,
}
