"""Queries of the training-data operators, by name, and the SQL of those that SQL can express.

Tests hold the others against brute force.
"""

from __future__ import annotations

from pagelens.llm import (
    decontaminate,
    jaccard,
    language,
    packing,
    phrases,
    private,
    quality,
    quotes,
    repeats,
    scoring,
    secrets,
    whitening,
    winnowing,
)

QUERIES = {
    "op1_lm_scoring": scoring.query,
    "op2_quality_rules": quality.query,
    "op3_pii": private.query,
    "op4_suffix_dedup": repeats.query,
    "op5_packing": packing.query,
    "op6_secret_scan": secrets.query,
    "op7_chat_formatting": quotes.query,
    "op8_decontamination": decontaminate.query,
    "op9_jaccard_join": jaccard.query,
    "op10_language_id": language.query,
    "op11_phrases": phrases.query,
    "op12_fingerprints": winnowing.query,
    "op13_whitening": whitening.query,
}

ORACLES = {"op11_phrases": phrases.ORACLE, "op12_fingerprints": winnowing.ORACLE}
