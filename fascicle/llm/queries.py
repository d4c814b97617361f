"""The registered queries of this subpackage and their DuckDB SQL."""

from __future__ import annotations

import corpus_pipeline
from fascicle.llm import bpe, collocations, conversations, decontaminate, fingerprint, language, line_dedup, packing, pii, secrets, simhash, substrings, toxicity

QUERIES = {
    "op1_byte_bpe": bpe.query,
    "op2_line_dedup": line_dedup.query,
    "op3_simhash": simhash.query,
    "op4_language_id": language.query,
    "op5_toxicity": toxicity.query,
    "op6_fingerprint": fingerprint.query,
    "op7_substring_dedup": substrings.query,
    "op8_secret_scan": secrets.query,
    "op9_decontaminate": decontaminate.query,
    "op10_pii": pii.query,
    "op11_conversation_repair": conversations.query,
    "op12_best_fit_packing": packing.query,
    "op13_collocations": collocations.query,
    "pipeline": corpus_pipeline.run,
}

SQL = {
    "op2_line_dedup": line_dedup.SQL,
    "op7_substring_dedup": substrings.SQL,
    "op8_secret_scan": secrets.SQL,
    "op9_decontaminate": decontaminate.SQL,
    "op10_pii": pii.SQL,
    "op11_conversation_repair": conversations.SQL,
    "op13_collocations": collocations.SQL,
}
