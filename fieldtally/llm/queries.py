"""Queries of the operators, by name, and their SQL where SQL can say it."""

from __future__ import annotations

from fieldtally.llm import decontamination, jaccard, language, packing, pii, quality, resampling, scoring, search, secrets, substrings, suffixes, toxicity
from fieldtally.llm.sql import ORACLE_SQL

__all__ = ["ORACLE_SQL", "QUERIES"]

QUERIES = {
    "op1_substring_dedup": substrings.op1_substring_dedup,
    "op2_best_fit_packing": packing.op2_best_fit_packing,
    "op3_suffix_dedup": suffixes.op3_suffix_dedup,
    "op4_decontamination": decontamination.op4_decontamination,
    "op5_ngram_jaccard": jaccard.op5_ngram_jaccard,
    "op6_toxicity": toxicity.op6_toxicity,
    "op7_pii": pii.op7_pii,
    "op8_language_id": language.op8_language_id,
    "op9_quality_rules": quality.op9_quality_rules,
    "op10_lm_scoring": scoring.op10_lm_scoring,
    "op11_lexical_search": search.op11_lexical_search,
    "op12_secret_scan": secrets.op12_secret_scan,
    "op13_importance_resampling": resampling.op13_importance_resampling,
}
