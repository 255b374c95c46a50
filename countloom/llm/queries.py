"""Registered queries of the training-data operators, with SQL where SQL expresses them."""

from __future__ import annotations

from countloom.llm import jaccard, lexical, mixing, near_vectors, neighbours, pages, pii, quality, repeats, resampling, tokens, toxicity


def queries():
    found = {
        "op1_nearest": neighbours.op1_nearest,
        "op2_ngram_jaccard": jaccard.op2_ngram_jaccard,
        "op3_quality": quality.op3_quality,
        "op4_near_vectors": near_vectors.op4_near_vectors,
        "op5_pii": pii.op5_pii,
        "op6_bpe": tokens.op6_bpe,
        "op7_toxicity": toxicity.op7_toxicity,
        "op8_token_orc": tokens.op8_token_orc,
        "op9_repeats": repeats.op9_repeats,
        "op10_mix": mixing.op10_mix,
        "op11_resample": resampling.op11_resample,
        "op12_main_text": pages.op12_main_text,
        "op13_wand": lexical.op13_wand,
    }
    return found


def oracle_sql() -> dict[str, str]:
    return {
        "op1_nearest": neighbours.OP1_SQL,
        "op2_ngram_jaccard": jaccard.OP2_SQL,
        "op4_near_vectors": near_vectors.OP4_SQL,
        "op11_resample": resampling.OP11_SQL,
        "op13_wand": lexical.OP13_SQL,
    }
