"""The registered queries of this subpackage and their SQL."""

from __future__ import annotations

from . import centroids, exact_dedup, hard_negatives, jaccard, language, lattice_lm, mixing, packing, quality, substring_dedup, token_ids, topk, toxicity


def queries() -> dict:
    return {
        "op1_mix_sources": mixing.op1_mix_sources,
        "op2_exact_dedup": exact_dedup.op2_exact_dedup,
        "op3_lattice_score": lattice_lm.op3_lattice_score,
        "op4_toxicity": toxicity.op4_toxicity,
        "op5_token_ids": token_ids.op5_token_ids,
        "op6_jaccard_join": jaccard.op6_jaccard_join,
        "op7_top_k": topk.op7_top_k,
        "op8_ordinal_quality": quality.op8_ordinal_quality,
        "op9_language_id": language.op9_language_id,
        "op10_best_fit_packing": packing.op10_best_fit_packing,
        "op11_hard_negatives": hard_negatives.op11_hard_negatives,
        "op12_substring_dedup": substring_dedup.op12_substring_dedup,
        "op13_centroid_clusters": centroids.op13_centroid_clusters,
    }


def oracle_sql() -> dict[str, str]:
    """Where SQL can express a query; the others are tested against plain versions of themselves."""
    return {"op2_exact_dedup": exact_dedup.SQL, "op6_jaccard_join": jaccard.SQL, "op7_top_k": topk.SQL, "op11_hard_negatives": hard_negatives.SQL, "op12_substring_dedup": substring_dedup.SQL, "op13_centroid_clusters": centroids.SQL}
