"""The numbered queries of this subpackage and their SQL."""

from __future__ import annotations

from vellum.llm import decontamination, exact_dedup, license_scan, line_templates, minhash_dedup, packing, quality, resharding, source_divergence, spelling_variants, suffix_dedup, toxicity, trie_counts

MODULES = {
    "op1_minhash_near_dedup": minhash_dedup,
    "op2_harmonic_packing": packing,
    "op3_min_cost_resharding": resharding,
    "op4_line_templates": line_templates,
    "op5_suffix_dedup": suffix_dedup,
    "op6_trie_token_counts": trie_counts,
    "op7_decontamination": decontamination,
    "op8_quality": quality,
    "op9_toxicity": toxicity,
    "op10_exact_dedup": exact_dedup,
    "op11_spelling_variants": spelling_variants,
    "op12_source_divergence": source_divergence,
    "op13_license_scan": license_scan,
}


def queries() -> dict:
    return {name: module.query for name, module in MODULES.items()} | {"op4_line_templates_long_lines": line_templates.query_long_lines}


def oracle_sql() -> dict[str, str]:
    own = {name: module.SQL for name, module in MODULES.items()} | {"op4_line_templates_long_lines": line_templates.SQL_LONG_LINES}
    return {name: sql for name, sql in own.items() if sql}
