"""The queries of this subpackage and their SQL, by name."""

from __future__ import annotations

from importlib import import_module

#: name: (module, function, name of its SQL)
_QUERIES = {
    "op1_weighted_minhash": ("weighted_minhash", "op1_weighted_minhash", None),
    "op2_sentence_spans": ("sentence_spans", "op2_sentence_spans", None),
    "op3_control_byte_files": ("token_files", "op3_control_byte_files", None),
    "op4_impact_ordered": ("impact_search", "op4_impact_ordered", "OP4_SQL"),
    "op5_line_blocks": ("html_blocks", "op5_line_blocks", None),
    "op6_additive_quality": ("quality", "op6_additive_quality", None),
    "op7_chosen_path": ("chosen_path", "op7_chosen_path", None),
    "op8_counterfactual_toxicity": ("toxicity", "op8_counterfactual_toxicity", None),
    "op9_length_buckets": ("packing", "op9_length_buckets", None),
    "op10_poisson_mix": ("mixing", "op10_poisson_mix", "OP10_SQL"),
}


def queries() -> dict:
    return {k: getattr(import_module(f"strandsift.llm.{m}"), f) for k, (m, f, _) in _QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    return {k: getattr(import_module(f"strandsift.llm.{m}"), s) for k, (m, _, s) in _QUERIES.items() if s}
