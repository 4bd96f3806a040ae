"""Queries of this subpackage, and their SQL where SQL can express them."""

from __future__ import annotations

from importlib import import_module

from . import divergence, exact_dedup

OPERATORS = {
    "op1_huffman_tokens": "token_output",
    "op2_bm25_decontamination": "decontaminate",
    "op3_karmarkar_karp_packing": "packing",
    "op4_nn_descent_embedding_dedup": "embedding_dedup",
    "op5_boosted_html_text": "html_text",
    "op6_prefix_token_counts": "prefix_counts",
    "op7_hyperdimensional_language": "language_id",
    "op8_simhash_near_duplicates": "simhash",
    "op9_factorization_machine_toxicity": "toxicity",
    "op10_randomness_battery_secrets": "secrets",
    "op11_importance_resampling": "importance",
    "op12_salted_exact_dedup": "exact_dedup",
    "op13_sorted_run_divergence": "divergence",
}


def queries() -> dict:
    import corpus_pipeline

    return {name: getattr(import_module(f"{__package__}.{module}"), name) for name, module in OPERATORS.items()} | {"pipeline": corpus_pipeline.run}


#: op4 over tables with unique vec_ids: all pairs of a label, and everything that links reach.
_EMBEDDINGS = """WITH RECURSIVE usable AS (SELECT vec_id, label, list_transform(embedding, lambda x: x::DOUBLE) AS e FROM embeddings WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(embedding) > 0
  AND len(list_filter(embedding, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0 AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
sized AS (SELECT *, sqrt(list_sum(list_transform(e, lambda x: x * x))) AS size FROM usable), unit AS (SELECT vec_id, label, len(e) AS dim, list_transform(e, lambda x: x / size) AS u FROM sized),
links AS (SELECT a.vec_id AS a, b.vec_id AS b FROM unit a JOIN unit b ON a.label = b.label AND a.dim = b.dim AND a.vec_id <> b.vec_id WHERE list_sum(list_transform(list_zip(a.u, b.u), lambda p: p[1] * p[2])) >= 0.98),
reach AS (SELECT vec_id AS node, vec_id AS seen FROM embeddings UNION SELECT reach.node, links.b FROM reach JOIN links ON reach.seen = links.a)
SELECT vec_id, (SELECT count(*) FROM links WHERE links.a = vec_id)::BIGINT AS n_links, component_id, vec_id = component_id AS kept
FROM embeddings JOIN (SELECT node AS vec_id, min(seen) AS component_id FROM reach GROUP BY node) USING (vec_id)"""


def oracle_sql() -> dict[str, str]:
    return {"op4_nn_descent_embedding_dedup": _EMBEDDINGS, "op12_salted_exact_dedup": exact_dedup.ORACLE_SQL, "op13_sorted_run_divergence": divergence.ORACLE_SQL}
