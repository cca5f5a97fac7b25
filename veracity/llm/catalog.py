"""The registered queries of this subpackage, with DuckDB SQL where SQL can express them."""

from __future__ import annotations

from veracity.llm import (block_ann, bpe, digest_index, hyperminhash, importance, licences, mixing, packing, passages, suffixes, toxicity,
                          url_lists, variants)

_ALL = {
    "op1_packing": (packing.query, None),
    "op2_exact_dedup": (digest_index.query, digest_index.SQL),
    "op3_url_lists": (url_lists.query, url_lists.SQL),
    "op4_block_ann": (block_ann.query, block_ann.SQL),
    "op5_toxicity": (toxicity.query, None),
    "op6_substring_dedup": (passages.query, None),
    "op7_hyperminhash": (hyperminhash.query, None),
    "op8_suffix_array": (suffixes.query, None),
    "op9_bpe_round_trip": (bpe.query, None),
    "op10_licences": (licences.query, licences.SQL),
    "op11_importance": (importance.query, importance.SQL),
    "op12_mixing": (mixing.query, mixing.SQL),
    "op13_variants": (variants.query, variants.SQL),
}


def queries() -> dict:
    return {name: q for name, (q, _) in _ALL.items()}


def oracle_sql() -> dict[str, str]:
    return {name: sql for name, (_, sql) in _ALL.items() if sql}
