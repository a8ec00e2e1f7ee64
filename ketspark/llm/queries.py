"""Queries of the training-data operators, and the SQL of those that SQL can express."""

from __future__ import annotations

from ketspark.llm.align import op13_token_alignment
from ketspark.llm.byte_bpe import op12_byte_bpe
from ketspark.llm.collocations import OP11_SQL, op11_collocations
from ketspark.llm.decontaminate import op9_benchmark_decontamination
from ketspark.llm.html_extract import op3_html_extraction
from ketspark.llm.jaccard_join import OP6_SQL, op6_ngram_jaccard_join
from ketspark.llm.packing import op2_best_fit_packing
from ketspark.llm.quality import op5_quality_rules
from ketspark.llm.substring_dedup import OP1_SQL, op1_substring_dedup
from ketspark.llm.suffix_dedup import OP8_SQL, op8_suffix_dedup
from ketspark.llm.suffix_tree_lm import op4_lm_scoring
from ketspark.llm.tokens import op7_token_files
from ketspark.llm.warc import OP10_SQL, op10_warc_revisits

QUERIES = {
    "op1_substring_dedup": op1_substring_dedup,
    "op2_best_fit_packing": op2_best_fit_packing,
    "op3_html_extraction": op3_html_extraction,
    "op4_lm_scoring": op4_lm_scoring,
    "op5_quality_rules": op5_quality_rules,
    "op6_ngram_jaccard_join": op6_ngram_jaccard_join,
    "op7_token_files": op7_token_files,
    "op8_suffix_dedup": op8_suffix_dedup,
    "op9_benchmark_decontamination": op9_benchmark_decontamination,
    "op10_warc_revisits": op10_warc_revisits,
    "op11_collocations": op11_collocations,
    "op12_byte_bpe": op12_byte_bpe,
    "op13_token_alignment": op13_token_alignment,
}

ORACLE_SQL: dict[str, str] = {
    "op1_substring_dedup": OP1_SQL,
    "op6_ngram_jaccard_join": OP6_SQL,
    "op8_suffix_dedup": OP8_SQL,
    "op10_warc_revisits": OP10_SQL,
    "op11_collocations": OP11_SQL,
}
