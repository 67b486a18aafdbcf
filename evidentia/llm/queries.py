"""Registered queries of the operators for training data, and the SQL of those that SQL can express."""

from __future__ import annotations

from . import clustering, jaccard, langid, maxent, media, mixing, packing, quality, sharding, substring, suffixes, urls, whitening

QUERIES = {
    "op1_substring_dedup": substring.op1_query,
    "op2_language_id": langid.op2_query,
    "op3_quality_rules": quality.op3_query,
    "op4_mixing": mixing.op4_query,
    "op5_jaccard_join": jaccard.op5_query,
    "op6_best_fit_packing": packing.op6_query,
    "op7_sharding": sharding.op7_query,
    "op8_url_filters": urls.op8_query,
    "op9_suffix_dedup": suffixes.op9_query,
    "op10_media": media.op10_query,
    "op11_centroid_clustering": clustering.op11_query,
    "op12_embedding_whitening": whitening.op12_query,
    "op13_lm_scoring": maxent.op13_query,
}

ORACLE_SQL = {"op8_url_filters": urls.OP8_SQL}
