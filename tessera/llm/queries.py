"""The queries opN_<name>: each operator, with its production parameters, over its whole table."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm import audit, bpe, chat, html_extract, langid, lines, minhash, packing, search, simhash, toxicity, vectors, warc
from tessera.llm.common import fold, shared_dir


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(_table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))


def op2_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.round_trip(_table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)


def op3_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.near_duplicates(_table(spark, sf_dir, "documents"))
    return found.select("doc_id", simhash.hex_of(F.col("fp")).alias("fingerprint"), "component_id")


def op4_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    part = fold(F.col("doc_id"), 3)
    found = toxicity.classify(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"), part != 1)
    return found.select("doc_id", F.coalesce(part == 1, F.lit(False)).alias("held_out"), "score", "predicted")


def op5_html(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_extract.main_text(_table(spark, sf_dir, "pages"))


def op6_langid(spark: SparkSession, sf_dir: str) -> DataFrame:
    part = fold(F.col("doc_id"), 4)
    found = langid.identify(_table(spark, sf_dir, "documents"), part != 2)
    return found.select("doc_id", F.coalesce(part == 2, F.lit(False)).alias("held_out"), "lang_pred", "score")


def op7_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chat.repair(_table(spark, sf_dir, "conversations"))


def op8_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vectors.near_duplicates(_table(spark, sf_dir, "embeddings"))


def op9_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash.compare_edited(_table(spark, sf_dir, "documents"))


def minhash_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bands joined and Jaccard similarities verified: the groups of near-duplicates that the fingerprints of op9 find."""
    return minhash.near_duplicates(_table(spark, sf_dir, "documents"))


def op10_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = warc.round_trip(_table(spark, sf_dir, "pages"), shared_dir(spark))
    return found.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op11_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search.top(search.build(_table(spark, sf_dir, "documents")), _table(spark, sf_dir, "benchmark"))


def op12_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audit.interactions(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


def op13_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = lines.dedup(_table(spark, sf_dir, "documents"))
    return found.select("doc_id", "n_lines", "n_dropped", F.sha2("text", 256).alias("kept_sha256"))


QUERIES = {f.__name__: f for f in (op1_packing, op2_bpe, op3_simhash, op4_toxicity, op5_html, op6_langid, op7_chat, op8_vectors, op9_minhash, op10_warc, op11_search, op12_filter_audit, op13_line_dedup, minhash_groups)}

ORACLES = {
    "op8_vectors": """
        WITH RECURSIVE v AS (
            SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS x FROM embeddings
        ), u AS (
            SELECT vec_id, label, x, sqrt(list_dot_product(x, x)) AS norm FROM v
            WHERE label IS NOT NULL AND len(list_filter(x, lambda e: e IS NULL OR NOT isfinite(e))) = 0
              AND list_dot_product(x, x) > 0
        ), link AS (
            SELECT a.vec_id AS a, b.vec_id AS b FROM u a JOIN u b ON a.label = b.label AND a.vec_id <> b.vec_id
            WHERE list_dot_product(a.x, b.x) / (a.norm * b.norm) >= 0.98
        ), reach(a, b) AS (
            SELECT vec_id, vec_id FROM v UNION SELECT r.a, l.b FROM reach r JOIN link l ON l.a = r.b
        )
        SELECT v.vec_id, CAST((SELECT count(*) FROM link WHERE link.a = v.vec_id) AS BIGINT) AS n_links,
               min(r.b) AS component_id, min(r.b) = v.vec_id AS kept
        FROM v JOIN reach r ON r.a = v.vec_id GROUP BY v.vec_id
    """,
    "op10_warc": """
        WITH p AS (SELECT page_id, coalesce(html, '') AS html, sha1(coalesce(html, '')) AS h FROM pages),
        m AS (SELECT *, max(page_id) OVER (PARTITION BY html) AS top FROM p)
        SELECT page_id, CAST(strlen(html) AS BIGINT) AS payload_bytes,
               list_aggregate(list_transform(range(0, 32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567',
                   ((('0x' || substr(h, CAST(5 * (i // 4) + 1 AS INT), 5))::INT >> CAST(15 - 5 * (i % 4) AS INT)) & 31) + 1, 1)),
                   'string_agg', '') AS payload_digest,
               CASE WHEN top > page_id THEN 'revisit' ELSE 'response' END AS record_type,
               CASE WHEN top > page_id THEN top END AS refers_to
        FROM m
    """,
    "op11_search": r"""
        WITH t AS (
            SELECT doc_id, unnest(regexp_extract_all(
                translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM documents
        ), tf AS (SELECT doc_id, term, count(*) AS tf FROM t GROUP BY ALL),
        len AS (SELECT doc_id, sum(tf)::BIGINT AS n FROM tf GROUP BY doc_id),
        total AS (SELECT count(*)::BIGINT AS big_n, sum(n)::BIGINT AS big_l FROM len),
        w AS (
            SELECT term, floor(1000 * ln((2 * big_n + 2)::DOUBLE / (2 * count(*) + 1)::DOUBLE))::BIGINT AS w
            FROM tf, total GROUP BY term, big_n
        ), q AS (
            SELECT item_id, term, count(*) AS r FROM (
                SELECT item_id, unnest(regexp_extract_all(
                    translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                    '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM benchmark
            ) GROUP BY ALL
        ), s AS (
            SELECT item_id, doc_id,
                   sum(r * w * ((1000000000 * tf) // (1000 * tf + 12 * (75 + (25 * n * big_n) // big_l))))::BIGINT AS score
            FROM q JOIN tf USING (term) JOIN w USING (term) JOIN len USING (doc_id), total
            GROUP BY item_id, doc_id
        ), ranked AS (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS rank FROM s WHERE score > 0)
        SELECT item_id, rank::INT AS rank, doc_id, score FROM ranked WHERE rank <= 20
    """,
    "op12_filter_audit": r"""
        WITH d AS (
            SELECT doc_id, coalesce(source, '') AS part, coalesce(text, '') AS t,
                   list_filter(regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda w: w <> '') AS w
            FROM documents
        ), f AS (
            SELECT d.doc_id, part,
                   CASE WHEN len(w) < 200 THEN 1 ELSE 0 END
                   + CASE WHEN 100 * len(list_distinct(w)) < 50 * len(w) THEN 2 ELSE 0 END
                   + CASE WHEN 100 * length(regexp_replace(t, '[^A-Z]', '', 'g')) > 2 * length(t) THEN 4 ELSE 0 END
                   + CASE WHEN regexp_matches(t, '[#$%&*|]') THEN 8 ELSE 0 END
                   + CASE WHEN doc_id > min(doc_id) OVER (PARTITION BY t) THEN 16 ELSE 0 END AS mask
            FROM d
        ), g AS (
            SELECT f.part, f.mask, coalesce(q.good, 0) AS good, coalesce(q.toxic, 0) AS toxic
            FROM f LEFT JOIN (
                SELECT doc_id, max(CASE WHEN quality = 1 THEN 1 ELSE 0 END) AS good, max(CASE WHEN toxic = 1 THEN 1 ELSE 0 END) AS toxic
                FROM labels GROUP BY doc_id
            ) q USING (doc_id)
        ), letters AS (SELECT unnest(range(0, 5)) AS b),
        orders AS (
            SELECT [p1.b, p2.b, p3.b, p4.b, p5.b] AS o FROM letters p1, letters p2, letters p3, letters p4, letters p5
            WHERE len(list_distinct([p1.b, p2.b, p3.b, p4.b, p5.b])) = 5
        ), steps AS (
            SELECT array_to_string(list_transform(o, lambda b: chr(CAST(65 + b AS INT))), '') AS filter_order, s AS step,
                   CAST(1 << o[s] AS INT) AS own,
                   CAST(list_sum(list_transform(o[1 : s - 1], lambda b: 1 << b)) AS INT) AS before
            FROM orders, unnest(range(1, 6)) AS u(s)
        ), cells AS (SELECT part, mask, count(*) AS n, sum(good) AS good, sum(toxic) AS toxic FROM g GROUP BY part, mask),
        r AS (
            SELECT part, filter_order, step, own,
                   sum(CASE WHEN mask & (own | coalesce(before, 0)) = 0 THEN n ELSE 0 END) AS kept,
                   sum(CASE WHEN mask & own > 0 AND mask & coalesce(before, 0) = 0 THEN n ELSE 0 END) AS removed,
                   sum(CASE WHEN mask & own > 0 AND mask & coalesce(before, 0) > 0 THEN n ELSE 0 END) AS redundant,
                   sum(CASE WHEN mask = own THEN n ELSE 0 END) AS unique_fails,
                   sum(CASE WHEN mask & own > 0 AND mask & coalesce(before, 0) = 0 THEN good ELSE 0 END) AS good_lost,
                   sum(CASE WHEN mask & own > 0 AND mask & coalesce(before, 0) = 0 THEN toxic ELSE 0 END) AS toxic_lost
            FROM cells, steps GROUP BY part, filter_order, step, own
        )
        SELECT part, filter_order, CAST(step AS INT) AS step, CAST(kept AS BIGINT) AS kept, CAST(removed AS BIGINT) AS removed,
               CAST(redundant AS BIGINT) AS redundant, CAST(unique_fails AS BIGINT) AS unique_fails,
               CAST(good_lost AS BIGINT) AS good_lost, CAST(toxic_lost AS BIGINT) AS toxic_lost,
               CAST(sum(removed) OVER (PARTITION BY part, own) AS BIGINT) AS shapley
        FROM r
    """,
    "op13_line_dedup": r"""
        WITH l AS (
            SELECT doc_id, i AS pos, string_split(coalesce(text, ''), chr(10))[i] AS line
            FROM (SELECT doc_id, text, unnest(range(1, len(string_split(coalesce(text, ''), chr(10))) + 1)) AS i FROM documents)
        ), k AS (
            SELECT *, translate(trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)),
                                'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key
            FROM l
        ), m AS (SELECT *, length(key) >= 10 AND doc_id > min(doc_id) OVER (PARTITION BY key) AS gone FROM k)
        SELECT doc_id, count(*) AS n_lines, CAST(count(*) FILTER (gone) AS BIGINT) AS n_dropped,
               sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (NOT gone), '')) AS kept_sha256
        FROM m GROUP BY doc_id
    """,
}
