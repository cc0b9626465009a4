"""Registered queries of this subpackage and their SQL."""

from __future__ import annotations

import corpus_pipeline
from signalsift.llm.alignment import op11_cross_tokenizer_alignment
from signalsift.llm.chat import op2_chat_formatting
from signalsift.llm.contamination import op10_benchmark_decontamination
from signalsift.llm.extraction import op1_html_extraction
from signalsift.llm.jaccard import op8_jaccard_join
from signalsift.llm.language import op12_language_id
from signalsift.llm.manifest import CONTRACT_SQL as MANIFEST_SQL
from signalsift.llm.manifest import op13_merkle_manifest
from signalsift.llm.packing import op3_best_fit_packing
from signalsift.llm.secrets import op6_secret_scan
from signalsift.llm.shards import op9_sharding
from signalsift.llm.shipping import ship
from signalsift.llm.toxicity import op4_toxicity
from signalsift.llm.urls import CONTRACT_SQL as URL_SQL
from signalsift.llm.urls import op7_url_filter
from signalsift.llm.vectors import op5_embedding_near_dedup


def _shipped(run):
    return lambda spark, folder: run(ship(spark), folder)


_RUNS = {
    "op1_html_extraction": op1_html_extraction,
    "op2_chat_formatting": op2_chat_formatting,
    "op3_best_fit_packing": op3_best_fit_packing,
    "op4_toxicity": op4_toxicity,
    "op5_embedding_near_dedup": op5_embedding_near_dedup,
    "op6_secret_scan": op6_secret_scan,
    "op7_url_filter": op7_url_filter,
    "op8_jaccard_join": op8_jaccard_join,
    "op9_sharding": op9_sharding,
    "op10_benchmark_decontamination": op10_benchmark_decontamination,
    "op11_cross_tokenizer_alignment": op11_cross_tokenizer_alignment,
    "op12_language_id": op12_language_id,
    "op13_merkle_manifest": op13_merkle_manifest,
    "pipeline": corpus_pipeline.run,
}

QUERIES = {name: _shipped(run) for name, run in _RUNS.items()}

ORACLES = {
    "op7_url_filter": URL_SQL,
    "op13_merkle_manifest": MANIFEST_SQL,
}
