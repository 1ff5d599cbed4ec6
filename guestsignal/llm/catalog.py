"""Queries of the training-data operators and the SQL that some of them agree with."""

from __future__ import annotations

from guestsignal.llm import (
    op1_line_dedup,
    op2_token_output,
    op3_toxicity,
    op4_decontamination,
    op5_mixing,
    op6_html_extraction,
    op7_topk_search,
    op8_ngram_jaccard_join,
    op9_suffix_array_dedup,
    op10_substring_dedup,
    op11_fill_in_middle,
    op12_bpe_tree,
    op13_spelling_variants,
)

MODULES = (
    op1_line_dedup, op2_token_output, op3_toxicity, op4_decontamination, op5_mixing,
    op6_html_extraction, op7_topk_search, op8_ngram_jaccard_join, op9_suffix_array_dedup,
    op10_substring_dedup, op11_fill_in_middle, op12_bpe_tree, op13_spelling_variants,
)

QUERIES = {m.__name__.rpartition(".")[2]: m.query for m in MODULES}
ORACLES = {m.__name__.rpartition(".")[2]: m.SQL for m in MODULES if hasattr(m, "SQL")}
