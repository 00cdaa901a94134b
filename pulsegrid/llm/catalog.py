"""Queries of the training-data operators, and SQL for those that SQL can express."""

from __future__ import annotations

from . import bpe, decontaminate, fingerprint, near_dedup, ordinal_quality, packing, periodic, phrases, pii, secret_scan, sharding, token_file, tool_calls

QUERIES = {
    "op1_histogram_shards": sharding.op1_histogram_shards,
    "op2_secret_scan": secret_scan.op2_secret_scan,
    "op3_fingerprints": fingerprint.op3_fingerprints,
    "op4_decontaminate": decontaminate.op4_decontaminate,
    "op5_tool_calls": tool_calls.op5_tool_calls,
    "op6_ordinal_quality": ordinal_quality.op6_ordinal_quality,
    "op7_pii": pii.op7_pii,
    "op8_bpe": bpe.op8_bpe,
    "op9_token_file": token_file.op9_token_file,
    "op10_near_dedup": near_dedup.op10_near_dedup,
    "op11_phrases": phrases.op11_phrases,
    "op12_best_fit": packing.op12_best_fit,
    "op13_periodic_runs": periodic.op13_periodic_runs,
}

SQL: dict[str, str] = {"op11_phrases": phrases.SQL}
