"""Queries of the corpus operators, and SQL where SQL can express them."""

from __future__ import annotations

from . import collocations, decontaminate, exact_dedup, lattice_lm, minmax_dedup, mixing, packing, prefix_trie, suffix_dedup, token_counts, toxicity, urls, warc

QUERIES = {
    "op1_lattice_lm": lattice_lm.op1_lattice_lm,
    "op2_warc_zstd": warc.op2_warc_zstd,
    "op3_exact_dedup": exact_dedup.op3_exact_dedup,
    "op4_suffix_dedup": suffix_dedup.op4_suffix_dedup,
    "op5_minmax_dedup": minmax_dedup.op5_minmax_dedup,
    "op6_decontamination": decontaminate.op6_decontamination,
    "op7_mixing": mixing.op7_mixing,
    "op8_packing": packing.op8_packing,
    "op9_toxicity": toxicity.op9_toxicity,
    "op10_url_filter": urls.op10_url_filter,
    "op11_token_counts": token_counts.op11_token_counts,
    "op12_prefix_trie": prefix_trie.op12_prefix_trie,
    "op13_collocations": collocations.op13_collocations,
}

ORACLE_SQL = {
    "op2_warc_zstd": warc.OP2_SQL,
    "op3_exact_dedup": exact_dedup.OP3_SQL,
    "op7_mixing": mixing.OP7_SQL,
    "op10_url_filter": urls.OP10_SQL,
    "op12_prefix_trie": prefix_trie.OP12_SQL,
    "op13_collocations": collocations.OP13_SQL,
}
