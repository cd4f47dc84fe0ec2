"""The queries of this subpackage, by name, and the SQL of those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from spindrift.llm.langid import op4_language
from spindrift.llm.line_dedup import op6_line_dedup
from spindrift.llm.lm_scoring import op3_lm_scoring
from spindrift.llm.mixing import op9_mixing
from spindrift.llm.near_dedup import op7_near_dedup
from spindrift.llm.packing import op8_packing
from spindrift.llm.token_counts import op1_token_counts
from spindrift.llm.toxicity import op10_toxicity
from spindrift.llm.vector_dedup import op5_vector_dedup
from spindrift.llm.vector_search import op2_vector_topk

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_token_counts": op1_token_counts,
    "op2_vector_topk": op2_vector_topk,
    "op3_lm_scoring": op3_lm_scoring,
    "op4_language": op4_language,
    "op5_vector_dedup": op5_vector_dedup,
    "op6_line_dedup": op6_line_dedup,
    "op7_near_dedup": op7_near_dedup,
    "op8_packing": op8_packing,
    "op9_mixing": op9_mixing,
    "op10_toxicity": op10_toxicity,
}

#: Integer scores and ids only, so that both engines agree to the last digit.
ORACLE_SQL: dict[str, str] = {
    "op2_vector_topk": """
        WITH v AS (
            SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS DOUBLE)) AS e
            FROM embeddings
            WHERE len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
        ), s AS (
            SELECT q.vec_id AS query_id, c.vec_id, CAST(list_dot_product(q.e, c.e) AS BIGINT) AS score
            FROM v q JOIN v c ON q.vec_id % 50 = 0 AND q.vec_id <> c.vec_id AND len(q.e) = len(c.e)
        ), r AS (
            SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank FROM s
        )
        SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 5
    """,
    "op5_vector_dedup": """
        WITH RECURSIVE v AS (
            SELECT vec_id, label, list_transform(embedding, lambda x: CAST(x AS DOUBLE)) AS e FROM embeddings
            WHERE label IS NOT NULL AND len(embedding) > 0
              AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
              AND len(list_filter(embedding, lambda x: x <> 0)) > 0
        ), l AS (
            SELECT a.vec_id AS a, b.vec_id AS b FROM v a JOIN v b
            ON a.label = b.label AND a.vec_id <> b.vec_id AND len(a.e) = len(b.e)
            WHERE list_cosine_similarity(a.e, b.e) >= 0.98
        ), reach AS (
            SELECT a, b FROM l UNION SELECT r.a, l.b FROM reach r JOIN l ON r.b = l.a
        ), c AS (SELECT a, least(a, min(b)) AS component_id FROM reach GROUP BY a),
        n AS (SELECT a, count(*) AS n_links FROM l GROUP BY a)
        SELECT e.vec_id, coalesce(n.n_links, 0) AS n_links, coalesce(c.component_id, e.vec_id) AS component_id,
               coalesce(c.component_id, e.vec_id) = e.vec_id AS kept
        FROM embeddings e LEFT JOIN c ON c.a = e.vec_id LEFT JOIN n ON n.a = e.vec_id
    """,
}


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages of corpus_pipeline.py over all documents."""
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


QUERIES["pipeline"] = pipeline
