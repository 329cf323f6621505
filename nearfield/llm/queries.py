"""The text operators' registered queries and their SQL, by name."""

from __future__ import annotations

from . import language_model, licenses, order_minhash, packing, piece_bpe, quality, secrets, simhash, token_store, toxicity

QUERIES = {
    "op1_secret_scans": secrets.op1_secret_scans,
    "op2_language_model": language_model.op2_language_model,
    "op3_simhash": simhash.op3_simhash,
    "op4_order_minhash": order_minhash.op4_order_minhash,
    "op5_sentencepiece": piece_bpe.op5_sentencepiece,
    "op6_toxicity": toxicity.op6_toxicity,
    "op7_token_files": token_store.op7_token_files,
    "op8_quality_rules": quality.op8_quality_rules,
    "op9_license_scans": licenses.op9_license_scans,
    "op10_packing": packing.op10_packing,
}

#: Queries that SQL can express.
SQL = {
    "op1_secret_scans": secrets.sql,
    "op8_quality_rules": quality.sql,
    "op9_license_scans": licenses.sql,
}
