"""The subpackage's queries and their SQL, by name."""

from __future__ import annotations

from inkspark.llm import sql
from inkspark.llm.bpe import op13_bpe
from inkspark.llm.chaining import op9_substring_dedup
from inkspark.llm.covertree import op7_embedding_dedup
from inkspark.llm.divergence import op12_source_divergence
from inkspark.llm.langid import op1_language_id
from inkspark.llm.lines import op4_line_dedup
from inkspark.llm.mixing import op3_mixing
from inkspark.llm.multiindex import op8_topk_search
from inkspark.llm.negatives import op11_hard_negatives
from inkspark.llm.packing import op2_packing
from inkspark.llm.simhash import op10_simhash
from inkspark.llm.toxicity import op5_toxicity
from inkspark.llm.wrapper import op6_html_text


def queries():
    return {
        "op1_language_id": op1_language_id,
        "op2_packing": op2_packing,
        "op3_mixing": op3_mixing,
        "op4_line_dedup": op4_line_dedup,
        "op5_toxicity": op5_toxicity,
        "op6_html_text": op6_html_text,
        "op7_embedding_dedup": op7_embedding_dedup,
        "op8_topk_search": op8_topk_search,
        "op9_substring_dedup": op9_substring_dedup,
        "op10_simhash": op10_simhash,
        "op11_hard_negatives": op11_hard_negatives,
        "op12_source_divergence": op12_source_divergence,
        "op13_bpe": op13_bpe,
    }


def oracle_sql():
    return {
        "op4_line_dedup": sql.LINE_DEDUP,
        "op7_embedding_dedup": sql.EMBEDDING_DEDUP,
        "op8_topk_search": sql.TOPK_SEARCH,
        "op11_hard_negatives": sql.HARD_NEGATIVES,
        "op12_source_divergence": sql.SOURCE_DIVERGENCE,
    }
