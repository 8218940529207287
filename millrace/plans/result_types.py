"""Whole numbers of the checking SQL in the types the queries give them.

Sums of whole numbers are 128 bits wide in DuckDB and 64 in Spark, counts of
list elements 64 and 32.
"""

from __future__ import annotations

# Query -> its columns of 64 and of 32 bits.
LONG = {
    "corpus_hash": "documents",
    "training_text_stats": "chars words",
    "build_shards": "token_start token_end",
    "manifest_validation": "token_count problems",
    "registry_summary": "tokens",
    "doc_layout": "tok_start tok_end",
    "pack_concat_chop": "offset length window_start",
    "packing_stats": "used",
    "window_supply": "tokens",
    "materialise_samples": "used",
    "loss_mask": "loss context pad",
    "attention_edges": "edges",
    "position_ids": "positions sum",
    "mixture_compliance": "tokens",
    "stage_of_step": "positions",
    "plan_cursors": "cursor",
    "plan_hash": "n",
    "unigram_loss": "words",
    "ledger_integrity": "records distinct_microbatches duplicates loss_bearing_tokens pad_tokens total_positions",
    "tokens_by_lane": "tokens",
    "tokens_by_stage_lane": "tokens",
    "efficiency": "total_positions loss_bearing_tokens context_only_tokens pad_tokens",
    "all_branch_totals": "loss_bearing_tokens",
    "shards_between_steps": "span_tokens",
    "span_tokens": "tokens",
    "learning_by_lane_phase": "loss_bearing_tokens",
    "batches_before_spike": "loss_bearing_tokens",
    "decision_reasons": "tokens",
}
INT = {
    "word_counts": "words",
    "ngram_fingerprints": "grams",
    "role_spans": "span_no chars",
    "pack_pad_only": "length truncated",
    "proxy_direction": "i",
}


def typed(name: str, sql: str) -> str:
    casts = [f'cast("{c}" as {kind}) as "{c}"' for kind, table in (("bigint", LONG), ("integer", INT)) for c in table.get(name, "").split()]
    return f"select * replace ({', '.join(casts)}) from ({sql})" if casts else sql
