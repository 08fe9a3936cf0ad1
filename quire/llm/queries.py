"""The queries of this subpackage and their SQL, as __spark_entry__ registers them."""

from __future__ import annotations

from importlib import import_module

_OPS = {
    "op1_simhash_components": "simhash",
    "op2_poisson_mixing": "mixing",
    "op3_pivot_permutations": "pivots",
    "op4_levenshtein_lexicon": "toxicity",
    "op5_surrogates": "pii",
    "op6_multi_index_hashing": "multi_index",
    "op7_backoff_automaton": "lm",
    "op8_path_templates": "url_filters",
    "op9_hilbert_packing": "packing",
    "op10_bit_planes": "token_files",
    "op11_merkle_manifest": "merkle",
    "op12_best_fit_packing": "best_fit",
    "op13_spelling_variants": "spelling",
}


def queries() -> dict:
    return {name: getattr(import_module(f"{__package__}.{module}"), name) for name, module in _OPS.items()}


def oracle_sql() -> dict[str, str]:
    found = {name: getattr(import_module(f"{__package__}.{module}"), "ORACLE", None) for name, module in _OPS.items()}
    return {name: sql for name, sql in found.items() if sql}
