"""The corpus operators as named queries over whole tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from petroloom.llm import hardneg, jaccard, langid, media, mixing, packing, pii, quality, secretscan, sharding, topk, toxicity, trie


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    found = (packing.op1_best_fit_packing, toxicity.op2_toxicity, mixing.op3_mixing, media.op4_progressive_jpeg, topk.op5_exact_top_k, langid.op6_language_id, secretscan.op7_secret_scan, quality.op8_importance_resampling, jaccard.op9_ngram_jaccard, sharding.op10_kd_sharding, trie.op11_prefix_trie, pii.op12_personal_data, hardneg.op13_hard_negatives)
    return {f.__name__: f for f in found}


JACCARD = r"""
WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
s AS (SELECT doc_id, CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 4 THEN [array_to_string(w, ' ')] ELSE list_distinct([array_to_string(w[i:i + 3], ' ') for i in range(1, len(w) - 2)]) END AS g FROM w),
g AS (SELECT doc_id, len(g) AS n, unnest(g) AS gram FROM s),
links AS (SELECT a.doc_id AS i, b.doc_id AS j FROM g a JOIN g b ON a.gram = b.gram AND a.doc_id < b.doc_id GROUP BY a.doc_id, b.doc_id, a.n, b.n HAVING 100 * count(*) >= 85 * (a.n + b.n - count(*))),
e AS (SELECT i, j FROM links UNION ALL SELECT j, i FROM links),
reach AS (SELECT doc_id, doc_id AS r FROM documents UNION SELECT e.j, reach.r FROM reach JOIN e ON e.i = reach.doc_id)
SELECT doc_id, len(g) AS n_shingles, component_id FROM s JOIN (SELECT doc_id, min(r) AS component_id FROM reach GROUP BY doc_id) USING (doc_id)
"""


def oracle_sql() -> dict[str, str]:
    """SQL for those of the queries that it can express on whole tables."""
    return {"op5_exact_top_k": topk.SQL, "op9_ngram_jaccard": JACCARD, "op11_prefix_trie": trie.SQL, "op13_hard_negatives": hardneg.SQL}
