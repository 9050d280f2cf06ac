"""Queries of the training-data operators, and their SQL where there is one."""

from __future__ import annotations

from . import ann, bpe, exact_dedup, filter_audit, jaccard, langid, packing, repair, resampling, sharding, simhash, suffix_dedup, toxicity


def queries():
    return {
        "op1_sharding": sharding.op1_sharding,
        "op2_ann": ann.op2_ann,
        "op3_bpe": bpe.op3_bpe,
        "op4_suffix_dedup": suffix_dedup.op4_suffix_dedup,
        "op5_toxicity": toxicity.op5_toxicity,
        "op6_exact_dedup": exact_dedup.op6_exact_dedup,
        "op7_packing": packing.op7_packing,
        "op8_token_ids": repair.op8_token_ids,
        "op9_language_id": langid.op9_language_id,
        "op10_simhash": simhash.op10_simhash,
        "op11_jaccard_join": jaccard.op11_jaccard_join,
        "op12_filter_audit": filter_audit.op12_filter_audit,
        "op13_resampling": resampling.op13_resampling,
    }


def oracle_sql():
    return {"op6_exact_dedup": exact_dedup.SQL, "op11_jaccard_join": jaccard.SQL, "op12_filter_audit": filter_audit.SQL, "op13_resampling": resampling.SQL}
