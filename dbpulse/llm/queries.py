"""The registered queries of this subpackage and their DuckDB statements."""

from __future__ import annotations

from collections.abc import Callable

import corpus_pipeline
from pyspark.sql import DataFrame, SparkSession

from dbpulse.sources.tables import load_table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def register(name: str, oracle: str | None = None):
    def deco(fn):
        QUERIES[name] = fn
        if oracle is not None:
            ORACLES[name] = oracle
        return fn
    return deco


@register("op1_url_filter")
def op1_url_filter(spark, sf_dir):
    from dbpulse.llm.url_filter import judge_urls

    return judge_urls(load_table(spark, sf_dir, "pages"))


@register("op2_pii")
def op2_pii(spark, sf_dir):
    from dbpulse.llm.pii_crf import find_pii

    return find_pii(load_table(spark, sf_dir, "documents"))


@register("op3_bpe")
def op3_bpe(spark, sf_dir):
    from dbpulse.llm.bpe import encode_documents

    return encode_documents(load_table(spark, sf_dir, "documents"))


@register("op4_topk", """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS v
  FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (
  SELECT q.vec_id AS query_id, c.vec_id,
         CAST(list_sum(list_transform(list_zip(q.v, c.v), lambda p: p[1] * p[2])) AS BIGINT) AS score
  FROM v q JOIN v c ON q.vec_id <> c.vec_id AND q.vec_id % 50 = 0 AND len(q.v) = len(c.v)),
r AS (SELECT *, ROW_NUMBER() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM s)
SELECT query_id, CAST(rank AS INTEGER) AS rank, vec_id, score FROM r WHERE rank <= 5
""")
def op4_topk(spark, sf_dir):
    from pyspark.sql import functions as F

    from dbpulse.llm.topk import top_k

    return top_k(load_table(spark, sf_dir, "embeddings"), "vec_id", "embedding", F.col("id") % 50 == 0)


@register("op5_source_mix")
def op5_source_mix(spark, sf_dir):
    from dbpulse.llm.mixing import mix_documents

    return mix_documents(load_table(spark, sf_dir, "documents"))


@register("op6_warc", """
WITH p AS (
  SELECT page_id, coalesce(html, '') AS html, strlen(coalesce(html, '')) AS payload_bytes,
         sha256(coalesce(html, '')) AS payload_digest FROM pages),
f AS (SELECT html, MIN(page_id) AS first_id FROM p WHERE payload_bytes >= 100 GROUP BY html)
SELECT p.page_id, CAST(p.payload_bytes AS BIGINT) AS payload_bytes, p.payload_digest,
       CASE WHEN f.first_id <> p.page_id THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN f.first_id <> p.page_id THEN f.first_id END AS refers_to
FROM p LEFT JOIN f ON f.html = p.html
""")
def op6_warc(spark, sf_dir):
    from dbpulse.llm.warc import archived_pages

    return archived_pages(load_table(spark, sf_dir, "pages")).select(
        "page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


@register("op7_ngram_join")
def op7_ngram_join(spark, sf_dir):
    from dbpulse.llm.ngram_join import join_documents

    return join_documents(load_table(spark, sf_dir, "documents"), k=4, percent=85)


@register("op8_exact_dedup", r"""
WITH d AS (
  SELECT doc_id, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g') AS norm FROM documents),
g AS (SELECT norm, MIN(doc_id) AS keep_id, COUNT(*) AS group_size FROM d GROUP BY norm)
SELECT d.doc_id, g.keep_id, g.group_size, d.doc_id = g.keep_id AS kept, sha256(d.norm) AS text_sha256
FROM d JOIN g ON d.norm = g.norm
""")
def op8_exact_dedup(spark, sf_dir):
    from dbpulse.llm.exact_dedup import exact_groups

    return exact_groups(load_table(spark, sf_dir, "documents"))


@register("op9_quality")
def op9_quality(spark, sf_dir):
    from dbpulse.llm.quality_fm import judge_quality

    return judge_quality(load_table(spark, sf_dir, "documents"), load_table(spark, sf_dir, "labels"))


@register("op10_language")
def op10_language(spark, sf_dir):
    from dbpulse.llm.lang_id import identify

    return identify(load_table(spark, sf_dir, "documents"))


@register("op11_hard_negatives", """
WITH v AS (
  SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
         list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS v
  FROM embeddings
  WHERE label IS NOT NULL AND embedding IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (
  SELECT a.vec_id AS anchor_id, c.vec_id, a.label = c.label AS alike,
         CAST(list_sum(list_transform(list_zip(a.v, c.v), lambda p: p[1] * p[2])) AS BIGINT) AS score
  FROM v a JOIN v c ON a.vec_id <> c.vec_id AND a.vec_id % 50 = 0 AND len(a.v) = len(c.v)),
p AS (
  SELECT anchor_id, vec_id AS positive_id, score AS positive_score FROM s WHERE alike
  QUALIFY ROW_NUMBER() OVER (PARTITION BY anchor_id ORDER BY score DESC, vec_id) <= 5),
n AS (
  SELECT p.*, s.vec_id AS negative_id, s.score AS negative_score,
         ROW_NUMBER() OVER (PARTITION BY p.anchor_id, p.positive_id ORDER BY s.score DESC, s.vec_id) AS rank
  FROM p JOIN s ON s.anchor_id = p.anchor_id AND NOT s.alike
    AND 100 * s.score BETWEEN 50 * p.positive_score AND 95 * p.positive_score)
SELECT anchor_id, positive_id, CAST(rank AS INTEGER) AS rank, negative_id, positive_score, negative_score
FROM n WHERE rank <= 3
""")
def op11_hard_negatives(spark, sf_dir):
    from pyspark.sql import functions as F

    from dbpulse.llm.common import pick
    from dbpulse.llm.hard_negatives import hard_negatives

    rows = pick(load_table(spark, sf_dir, "embeddings"), "vec_id", "embedding", "label")
    noisy = rows.withColumn("label", F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10)
                            .otherwise(F.col("label")))
    return hard_negatives(noisy, "vec_id", "embedding", "label", F.col("id") % 50 == 0)


@register("op12_binary_index")
def op12_binary_index(spark, sf_dir):
    from pyspark.sql import functions as F

    from dbpulse.llm.binary_index import nearest

    return nearest(load_table(spark, sf_dir, "embeddings"), "vec_id", "embedding", F.col("id") % 100 == 0)


@register("op13_phrases", r"""
WITH d AS (
  SELECT coalesce(lang, 'und') AS lang, unnest(string_split_regex(
    translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[.,;:!?\x0A-\x0D]')) AS piece FROM documents),
w AS (SELECT lang, list_filter(string_split_regex(piece, '[\x20\x09]+'), lambda x: x <> '') AS ws FROM d),
n AS (SELECT lang, CAST(SUM(len(ws)) AS BIGINT) AS n FROM w GROUP BY lang),
g AS (
  SELECT lang, k, unnest(list_transform(range(1, len(ws) - k + 2),
                                        lambda i: array_to_string(ws[i:i + k - 1], ' '))) AS phrase
  FROM w, (SELECT unnest(range(1, 5)) AS k)),
f AS (SELECT lang, k, phrase, COUNT(*) AS f FROM g GROUP BY ALL HAVING COUNT(*) >= 30),
c AS (
  SELECT lang, k AS words, phrase, f AS a, string_split(phrase, ' ') AS ws, unnest(range(1, k)) AS at
  FROM f WHERE k >= 2),
s AS (
  SELECT c.lang, c.phrase, c.a, l.f AS l, r.f AS r, c.at,
         CAST((2000000::HUGEINT * c.a) // (l.f::HUGEINT + r.f) AS BIGINT) AS score
  FROM c JOIN f l ON l.lang = c.lang AND l.phrase = array_to_string(c.ws[1:c.at], ' ')
  JOIN f r ON r.lang = c.lang AND r.phrase = array_to_string(c.ws[c.at + 1:], ' ')
  QUALIFY ROW_NUMBER() OVER (PARTITION BY c.lang, c.phrase ORDER BY score, c.at) = 1),
p AS (
  SELECT lang, f, string_split(phrase, ' ') AS ws, k, unnest(range(2, k)) AS size FROM f WHERE k >= 3),
h AS (
  SELECT lang, phrase, MAX(f) AS holder FROM (
    SELECT lang, f, unnest(list_transform(range(1, k - size + 2),
                                          lambda i: array_to_string(ws[i:i + size - 1], ' '))) AS phrase FROM p)
  GROUP BY lang, phrase)
SELECT s.lang, ROW_NUMBER() OVER (PARTITION BY s.lang ORDER BY s.score DESC, s.a DESC, s.phrase) AS rank,
       s.phrase, s.a, s.l, s.r, n.n, s.score
FROM s JOIN n ON n.lang = s.lang LEFT JOIN h ON h.lang = s.lang AND h.phrase = s.phrase
WHERE h.holder IS NULL OR 100::HUGEINT * h.holder < 80::HUGEINT * s.a
QUALIFY rank <= 2000
""")
def op13_phrases(spark, sf_dir):
    from dbpulse.llm.phrases import collocations

    return collocations(load_table(spark, sf_dir, "documents"))


@register("pipeline", corpus_pipeline.ORACLE_SQL)
def pipeline(spark, sf_dir):
    return corpus_pipeline.run(spark, sf_dir)
