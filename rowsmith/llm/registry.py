"""Registered queries of the training-data operators and the DuckDB SQL for those SQL can express."""

from __future__ import annotations

import corpus_pipeline
from rowsmith.llm import decontaminate, divergence, exactdedup, topk
from rowsmith.llm.langid import q_language
from rowsmith.llm.mixing import q_mixing
from rowsmith.llm.neardedup import q_near_duplicates
from rowsmith.llm.packing import q_packing
from rowsmith.llm.periodicruns import q_periodic_runs
from rowsmith.llm.pii import q_personal_data
from rowsmith.llm.sharding import q_sharding
from rowsmith.llm.tokenbin import q_token_ids
from rowsmith.llm.toxicity import q_toxicity

LLM_QUERIES = {
    "op1_virtual_slots": q_sharding,
    "op2_weak_supervision_pii": q_personal_data,
    "op3_rank_order_language": q_language,
    "op4_token_ids": q_token_ids,
    "op5_nnpu_toxicity": q_toxicity,
    "op6_curriculum_mix": q_mixing,
    "op7_packing": q_packing,
    "op8_bloom_dedup": exactdedup.q_exact_dedup,
    "op9_hyperminhash_dedup": q_near_duplicates,
    "op10_pivot_top_k": topk.q_top_k,
    "op11_periodic_runs": q_periodic_runs,
    "op12_ngram_decontamination": decontaminate.q_decontaminate,
    "op13_run_length_divergence": divergence.q_divergence,
    "pipeline": corpus_pipeline.run,
}

LLM_SQL: dict[str, str | None] = {
    "op8_bloom_dedup": exactdedup.SQL,
    "op10_pivot_top_k": topk.SQL,
    "op12_ngram_decontamination": decontaminate.SQL,
    "op13_run_length_divergence": divergence.SQL,
    "pipeline": corpus_pipeline.ORACLE_SQL,
}
