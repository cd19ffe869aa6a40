"""The registered queries of this subpackage and their DuckDB SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from hornloom.llm import minhash_dedup, pfair_mixing, piece_sampling, pii_weak, quality_rules, ring_shards, topk_search, toxicity, url_rules, warc_revisits
from hornloom.llm._shared import light_batches, table


def op1_pii_weak_supervision(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii_weak.find(table(spark, sf_dir, "documents")).drop("span_list")


def op2_minhash_bottom_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash_dedup.near_duplicates(table(spark, sf_dir, "documents"), width=3, num=85, den=100)


def op3_warc_revisits(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc_revisits.resolve(warc_revisits.captures(table(spark, sf_dir, "pages")))


def op4_exact_topk_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return topk_search.top_k(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 50 == 0, k=5, scale=256)


def op5_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    q = quality_rules.quality(table(spark, sf_dir, "documents"))
    return q.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


def op6_toxicity_lexicon(spark: SparkSession, sf_dir: str) -> DataFrame:
    light_batches(spark)
    return toxicity.toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op7_pfair_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pfair_mixing.mix(table(spark, sf_dir, "documents"), columns=["doc_id", "source"])


def op8_bounded_ring_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ring_shards.place(table(spark, sf_dir, "documents"))


def op9_url_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_rules.judge(table(spark, sf_dir, "pages"))


def op10_piece_sampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    light_batches(spark)
    return piece_sampling.sample_pieces(table(spark, sf_dir, "documents"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (
        op1_pii_weak_supervision, op2_minhash_bottom_k, op3_warc_revisits, op4_exact_topk_search, op5_quality_rules,
        op6_toxicity_lexicon, op7_pfair_mixing, op8_bounded_ring_shards, op9_url_rules, op10_piece_sampling,
    )}


_TOPK = """
WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS v FROM embeddings
           WHERE embedding IS NOT NULL AND vec_id IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0),
s AS (SELECT q.vec_id AS query_id, c.vec_id AS vec_id, CAST(list_dot_product(CAST(q.v AS DOUBLE[]), CAST(c.v AS DOUBLE[])) AS BIGINT) AS score
      FROM v q JOIN v c ON q.vec_id % 50 = 0 AND c.vec_id <> q.vec_id),
r AS (SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank FROM s)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 5"""


#: All pairs, and the smallest id that each id can reach.
_NEAR = r"""
WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS ws FROM documents),
s AS (SELECT doc_id, CASE WHEN len(ws) = 0 THEN [] WHEN len(ws) < 3 THEN [array_to_string(ws, ' ')]
                          ELSE list_distinct(list_transform(range(1, len(ws) - 1), lambda i: ws[i] || ' ' || ws[i + 1] || ' ' || ws[i + 2])) END AS sh FROM w),
x AS (SELECT doc_id, len(sh) AS n, unnest(sh) AS g FROM s),
l AS (SELECT a.doc_id AS a, b.doc_id AS b FROM x a JOIN x b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY a.doc_id, b.doc_id, a.n, b.n HAVING 100 * count(*) >= 85 * (a.n + b.n - count(*))),
e AS (SELECT a, b FROM l UNION ALL SELECT b, a FROM l),
r(id, c) AS (SELECT doc_id, doc_id FROM s UNION SELECT e.b, r.c FROM r JOIN e ON r.id = e.a WHERE r.c < e.b),
m AS (SELECT id, min(c) AS c FROM r GROUP BY id)
SELECT doc_id, CAST(len(sh) AS BIGINT) AS n_shingles, c AS component_id, doc_id = c AS kept FROM s JOIN m ON s.doc_id = m.id"""


def oracle_sql() -> dict[str, str]:
    return {"op2_minhash_bottom_k": _NEAR, "op3_warc_revisits": warc_revisits.SQL, "op7_pfair_mixing": pfair_mixing.sql(), "op4_exact_topk_search": _TOPK, "op5_quality_rules": quality_rules.sql(), "op9_url_rules": url_rules.sql()}
