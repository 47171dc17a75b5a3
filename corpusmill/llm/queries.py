"""The queries of this subpackage: each applies one operator with production parameters to its whole table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusmill.llm import bpe, decontam, hard_negatives, jaccard_join, langid, licenses, pii, sharding, snapshot_diff, token_files, topk, url_filter, warc
from corpusmill.llm.common import table


def op1_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = langid.train(docs, learn=~langid.held_out(F.col("doc_id")))
    found = langid.identify(docs, model)
    return found.select("doc_id", langid.held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score")


def op2_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_join.jaccard_groups(table(spark, sf_dir, "documents"), k=3, num=90)


def op3_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.digests(table(spark, sf_dir, "documents"))


def op4_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = topk.quantised(table(spark, sf_dir, "embeddings"))
    return topk.top_k(vectors, vectors.filter("vec_id % 20 = 0"), k=20)


def op5_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.digests(table(spark, sf_dir, "documents"))


def op6_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    archives = warc.write_archives(table(spark, sf_dir, "pages"))
    return warc.read_archives(spark, archives).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op7_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_filter.judge(table(spark, sf_dir, "pages")).select("page_id", "host", "path", "rule", "verdict")


def op8_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    manifest = token_files.write_files(table(spark, sf_dir, "documents"))
    return token_files.read_files(manifest, ids=False).select("doc_id", "start", "n_tokens", "ids_crc32")


def op9_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    placed = sharding.shard(sharding.measured(table(spark, sf_dir, "documents")), 16)
    return placed.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


def op10_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontam.contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op11_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scan(table(spark, sf_dir, "documents")).select("doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score")


def op12_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    key, label = F.col("vec_id"), F.col("label")
    rows = hard_negatives.labelled_vectors(table(spark, sf_dir, "embeddings"), F.when(key % 7 == 0, (label + 1) % 10).otherwise(label))
    return hard_negatives.hard_negatives(rows, F.col("id") % 100 == 0)


def op13_snapshot_diff(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return snapshot_diff.difference(docs, snapshot_diff.later_snapshot(docs))


QUERIES = {f.__name__: f for f in (op1_language_id, op2_jaccard_join, op3_pii, op4_top_k, op5_bpe, op6_warc, op7_url_filter, op8_token_files, op9_sharding, op10_decontamination, op11_license_scan, op12_hard_negatives, op13_snapshot_diff)}

#: The others have no SQL: a trained model, a tokenizer or a file format decides; tests hold them against brute force.
ORACLE_SQL = {
    "op4_top_k": """
        WITH v AS (
            SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(64 * CAST(x AS DOUBLE)) AS BIGINT)) AS v FROM embeddings
            WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
        ), s AS (
            SELECT q.vec_id AS query_id, c.vec_id, CAST(list_sum(list_transform(list_zip(q.v, c.v), lambda p: p[1] * p[2])) AS BIGINT) AS score
            FROM v q JOIN v c ON q.vec_id <> c.vec_id WHERE q.vec_id % 20 = 0
        ), r AS (SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank FROM s)
        SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 20""",
    "op12_hard_negatives": """
        WITH v AS (
            SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS v FROM embeddings
            WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
        ), s AS (
            SELECT a.vec_id AS anchor_id, c.vec_id, a.label = c.label AS same, CAST(list_sum(list_transform(list_zip(a.v, c.v), lambda p: p[1] * p[2])) AS BIGINT) AS score
            FROM v a JOIN v c ON a.vec_id <> c.vec_id WHERE a.vec_id % 100 = 0
        ), p AS (SELECT *, row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, vec_id) AS i FROM s WHERE same),
        n AS (
            SELECT p.anchor_id, p.vec_id AS positive_id, CAST(row_number() OVER (PARTITION BY p.anchor_id, p.vec_id ORDER BY s.score DESC, s.vec_id) AS INTEGER) AS rank, s.vec_id AS negative_id, p.score AS positive_score, s.score AS negative_score
            FROM p JOIN s ON p.anchor_id = s.anchor_id AND NOT s.same AND 80 * p.score <= 100 * s.score AND s.score <= p.score WHERE p.i <= 5
        )
        SELECT * FROM n WHERE rank <= 5""",
    "op13_snapshot_diff": """
        WITH t AS (SELECT list_transform(range(256), lambda n: list_reduce([n, 0, 0, 0, 0, 0, 0, 0, 0], lambda c, x: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END)) AS t
        ), d AS (
            SELECT doc_id, text, lang, source, xor(list_reduce([4294967295] || list_transform(string_split(CAST(doc_id AS VARCHAR), ''), lambda x: CAST(unicode(x) AS BIGINT)), lambda c, x: xor(c >> 8, t[(xor(c, x) & 255) + 1])), 4294967295) % 25 AS r
            FROM documents, t
        ), l AS (
            SELECT CASE WHEN r IN (3, 4) THEN -1 - doc_id ELSE doc_id END AS doc_id, CASE WHEN r = 1 THEN coalesce(text, '') || '+' ELSE text END AS text,
                CASE WHEN r = 2 THEN source ELSE lang END AS lang, CASE r WHEN 2 THEN lang WHEN 4 THEN NULL ELSE source END AS source
            FROM d WHERE r <> 0
            UNION ALL SELECT -1 - doc_id, text, lang, source FROM d WHERE r = 5
        ), a AS (SELECT *, row_number() OVER (PARTITION BY text, lang ORDER BY doc_id) AS i FROM d WHERE NOT EXISTS (SELECT 1 FROM l WHERE l.doc_id = d.doc_id)
        ), b AS (SELECT *, row_number() OVER (PARTITION BY text, lang ORDER BY doc_id DESC) AS i FROM l WHERE NOT EXISTS (SELECT 1 FROM d WHERE d.doc_id = l.doc_id)
        ), p AS (
            SELECT d.doc_id AS old_key, l.doc_id AS new_key, d.text AS t1, d.lang AS l1, d.source AS s1, l.text, l.lang, l.source FROM d JOIN l ON d.doc_id = l.doc_id
            UNION ALL SELECT a.doc_id, b.doc_id, a.text, a.lang, a.source, b.text, b.lang, b.source FROM a FULL JOIN b ON a.text IS NOT DISTINCT FROM b.text AND a.lang IS NOT DISTINCT FROM b.lang AND a.i = b.i
        ), c AS (
            SELECT *, CASE WHEN old_key IS NULL OR new_key IS NULL THEN '' ELSE concat_ws(',', CASE WHEN t1 IS DISTINCT FROM text THEN 'text' END, CASE WHEN l1 IS DISTINCT FROM lang THEN 'lang' END, CASE WHEN s1 IS DISTINCT FROM source THEN 'source' END) END AS changed FROM p
        )
        SELECT coalesce(new_key, old_key) AS key, old_key, CASE WHEN old_key IS NULL THEN 'insert' WHEN new_key IS NULL THEN 'delete' WHEN old_key <> new_key THEN 'rekey' WHEN changed = '' THEN 'same' ELSE 'update' END AS op, changed,
            CASE WHEN new_key IS NOT NULL THEN sha256(coalesce(text, '~') || chr(10) || coalesce(lang, '~') || chr(10) || coalesce(source, '~')) END AS row_sha256 FROM c""",
}
