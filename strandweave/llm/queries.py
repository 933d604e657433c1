"""Queries of the corpus operators over whole tables, with their production parameters."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from strandweave.llm.binary_ids import binary_ids
from strandweave.llm.decontaminate import leaks
from strandweave.llm.embedding_dedup import embedding_components
from strandweave.llm.jaccard import jaccard_components
from strandweave.llm.line_dedup import line_report
from strandweave.llm.mixing import mix
from strandweave.llm.packing import pack_digest
from strandweave.llm.quality import quality_scores
from strandweave.llm.search import search
from strandweave.llm.secrets import secret_report
from strandweave.llm.spelling import spelling_variants
from strandweave.llm.tables import read
from strandweave.llm.token_counts import token_counts
from strandweave.llm.toxicity import toxicity_scores

BYTE_BPE, WORD_BPE = "byte_bpe_50k.json", "word_bpe_49k.json"


def _documents(spark: SparkSession, sf: str) -> DataFrame:
    return read(spark, sf, "documents")


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_quality": lambda spark, sf: quality_scores(_documents(spark, sf), read(spark, sf, "labels")),
    "op2_decontaminate": lambda spark, sf: leaks(_documents(spark, sf), read(spark, sf, "benchmark")),
    "op3_token_counts": lambda spark, sf: token_counts(_documents(spark, sf), public_tokenizers.path(BYTE_BPE)),
    "op4_line_dedup": lambda spark, sf: line_report(_documents(spark, sf)),
    "op5_secrets": lambda spark, sf: secret_report(_documents(spark, sf)),
    "op6_toxicity": lambda spark, sf: toxicity_scores(_documents(spark, sf), read(spark, sf, "labels")),
    "op7_packing": lambda spark, sf: pack_digest(_documents(spark, sf), public_tokenizers.path(WORD_BPE)),
    "op8_jaccard_join": lambda spark, sf: jaccard_components(_documents(spark, sf)),
    "op9_embedding_dedup": lambda spark, sf: embedding_components(read(spark, sf, "embeddings")),
    "op10_binary_ids": lambda spark, sf: binary_ids(_documents(spark, sf), public_tokenizers.path(WORD_BPE)),
    "op11_search": lambda spark, sf: search(_documents(spark, sf), read(spark, sf, "benchmark")),
    "op12_mixing": lambda spark, sf: mix(_documents(spark, sf)),
    "op13_spelling": lambda spark, sf: spelling_variants(_documents(spark, sf)),
}

# The other queries have no SQL form (tokenizers, learned scores, alignment, test batteries) or
# only one that is too slow on whole tables (all pairs of shingle sets).
SQL: dict[str, str] = {
    "op9_embedding_dedup": """
        WITH RECURSIVE v AS (
            SELECT vec_id, label, embedding::DOUBLE[] AS e FROM embeddings
            WHERE label IS NOT NULL AND list_dot_product(embedding::DOUBLE[], embedding::DOUBLE[]) > 0
        ), l AS (
            SELECT a.vec_id AS x, b.vec_id AS y FROM v a JOIN v b ON a.label = b.label AND a.vec_id <> b.vec_id
            WHERE list_cosine_similarity(a.e, b.e) >= 0.98
        ), r(vec_id, reached) AS (
            SELECT vec_id, vec_id FROM embeddings
            UNION
            SELECT r.vec_id, l.y FROM r JOIN l ON r.reached = l.x
        )
        SELECT vec_id, coalesce(any_value(n), 0)::BIGINT AS n_links, min(reached)::BIGINT AS component_id, vec_id = min(reached) AS kept
        FROM r LEFT JOIN (SELECT x AS vec_id, count(*) AS n FROM l GROUP BY x) USING (vec_id) GROUP BY vec_id""",
    "op11_search": r"""
        WITH t AS (
            SELECT doc_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM documents
        ), d AS (SELECT doc_id, count(*) AS n FROM t GROUP BY doc_id
        ), g AS (SELECT count(*) AS nn, sum(n)::BIGINT AS ll FROM d
        ), m AS (SELECT doc_id, 100 - 90 + (90 * n * nn) // ll AS m FROM d, g
        ), p AS (SELECT doc_id, term, count(*) AS tf FROM t GROUP BY doc_id, term
        ), w AS (SELECT term, floor(1000 * ln((2 * nn + 2)::DOUBLE / (2 * count(*) + 1)::DOUBLE))::BIGINT AS w FROM p, g GROUP BY term, nn
        ), q AS (
            SELECT DISTINCT item_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM benchmark
        ), s AS (
            SELECT item_id, doc_id, sum(w * ((1000000000 * tf) // (1000 * tf + 8 * m)))::BIGINT AS score
            FROM q JOIN p USING (term) JOIN w USING (term) JOIN m USING (doc_id) GROUP BY item_id, doc_id
        )
        SELECT item_id, rank::INTEGER AS rank, doc_id, score FROM (
            SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS rank FROM s WHERE score > 0
        ) WHERE rank <= 10""",
}
