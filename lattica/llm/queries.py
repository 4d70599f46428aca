"""Queries and oracles of the training-data operators."""

from __future__ import annotations

from lattica.llm import bpe, decontaminate, fingerprints, hard_negatives, importance, language_id, line_dedup, minhash, pii, repeats, token_files, url_filters, warc

QUERIES = {
    "op1_suffix_dedup": repeats.op1_suffix_dedup,
    "op2_bpe": bpe.op2_bpe,
    "op3_language_id": language_id.op3_language_id,
    "op4_decontamination": decontaminate.op4_decontamination,
    "op5_pii": pii.op5_pii,
    "op6_fingerprints": fingerprints.op6_fingerprints,
    "op7_minhash": minhash.op7_minhash,
    "op8_token_files": token_files.op8_token_files,
    "op9_warc": warc.op9_warc,
    "op10_url_filters": url_filters.op10_url_filters,
    "op11_hard_negatives": hard_negatives.op11_hard_negatives,
    "op12_line_dedup": line_dedup.op12_line_dedup,
    "op13_importance": importance.op13_importance,
}
ORACLES = {
    "op4_decontamination": decontaminate.oracle(),
    "op7_minhash": minhash.oracle(),
    "op9_warc": warc.oracle(),
    "op10_url_filters": url_filters.oracle(),
    "op11_hard_negatives": hard_negatives.oracle(),
    "op12_line_dedup": line_dedup.oracle(),
    "op13_importance": importance.oracle(),
}
