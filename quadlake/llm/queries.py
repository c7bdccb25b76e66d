"""Queries of the corpus operators and their SQL, where SQL can express them."""

from __future__ import annotations

import corpus_pipeline
from quadlake.llm.decontaminate import op8_decontamination
from quadlake.llm.html_text import op10_html_text
from quadlake.llm.mixing import op5_mixing
from quadlake.llm.pii import op4_pii
from quadlake.llm.simhash import op2_simhash
from quadlake.llm.substring_dedup import op9_substring_dedup
from quadlake.llm.suffix_dedup import op3_suffix_dedup
from quadlake.llm.topk import OP7_SQL, op7_topk
from quadlake.llm.toxicity import op6_toxicity
from quadlake.llm.url_filter import OP1_SQL, op1_url_filter

QUERIES = {
    "op1_url_filter": op1_url_filter,
    "op2_simhash": op2_simhash,
    "op3_suffix_dedup": op3_suffix_dedup,
    "op4_pii": op4_pii,
    "op5_mixing": op5_mixing,
    "op6_toxicity": op6_toxicity,
    "op7_topk": op7_topk,
    "op8_decontamination": op8_decontamination,
    "op9_substring_dedup": op9_substring_dedup,
    "op10_html_text": op10_html_text,
    "pipeline": corpus_pipeline.run,
}

ORACLE_SQL = {
    "op1_url_filter": OP1_SQL,
    "op7_topk": OP7_SQL,
}
