"""Registered queries of the corpus operators and the SQL that says the same, where SQL can."""

from __future__ import annotations

from florapark.llm import (
    checks, divergence, fillmiddle, fingerprints, fixity, langid, licenses, mixing, neardup, packing, quality, secrets, simhash, toxicity,
)

QUERIES = {
    "op1_quality_rules": quality.query,
    "op2_packing": packing.query,
    "op3_toxicity": toxicity.query,
    "op4_secret_scan": secrets.query,
    "op5_mixing": mixing.query,
    "op6_warc_fixity": fixity.query,
    "op7_minhash_dedup": neardup.query,
    "op8_license_scan": licenses.query,
    "op9_language_id": langid.query,
    "op10_document_fingerprints": fingerprints.query,
    "op11_source_divergence": divergence.query,
    "op12_fill_in_middle": fillmiddle.query,
    "op13_simhash_dedup": simhash.query,
}

# the others need a trained model, a tokenizer or a particular hash, which SQL has not; see tests/llm
CHECKS: dict[str, str] = {
    "op1_quality_rules": checks.quality_rules(),
    "op6_warc_fixity": fixity.QUERY_SQL,
    "op7_minhash_dedup": checks.NEAR_DUPLICATES,
    "op11_source_divergence": checks.SOURCE_DIVERGENCE,
    "op12_fill_in_middle": checks.FILL_IN_MIDDLE,
}
