"""The queries of this subpackage and, where SQL can express them, their SQL."""

from __future__ import annotations

from . import bpe, fingerprints, licenses, mixing, secrets, simhash, token_files, topk, toxicity, url_filters

QUERIES = {
    "op1_document_fingerprints": fingerprints.op1_document_fingerprints,
    "op2_byte_level_bpe": bpe.op2_byte_level_bpe,
    "op3_secret_scans": secrets.op3_secret_scans,
    "op4_exact_top_k": topk.op4_exact_top_k,
    "op5_simhash_near_dedup": simhash.op5_simhash_near_dedup,
    "op6_mixing_sources": mixing.op6_mixing_sources,
    "op7_toxicity": toxicity.op7_toxicity,
    "op8_token_id_files": token_files.op8_token_id_files,
    "op9_license_scans": licenses.op9_license_scans,
    "op10_url_filters": url_filters.op10_url_filters,
}

ORACLE_SQL = {"op4_exact_top_k": topk.ORACLE, "op10_url_filters": url_filters.ORACLE}
