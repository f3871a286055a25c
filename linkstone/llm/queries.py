"""The queries of this subpackage and, where SQL can express one, its DuckDB SQL."""

from __future__ import annotations

from linkstone.llm.ann import op3_ann
from linkstone.llm.bpe import op6_bpe
from linkstone.llm.html_text import op4_html
from linkstone.llm.line_dedup import op1_line_dedup
from linkstone.llm.ngram_join import op10_ngram_join
from linkstone.llm.packing import op8_packing
from linkstone.llm.suffix_dedup import op7_suffix_dedup
from linkstone.llm.topk_inner import OP2_SQL, op2_topk
from linkstone.llm.toxicity import op5_toxicity
from linkstone.llm.warc import op9_warc

QUERIES = {
    "op1_line_dedup": op1_line_dedup,
    "op2_topk": op2_topk,
    "op3_ann": op3_ann,
    "op4_html": op4_html,
    "op5_toxicity": op5_toxicity,
    "op6_bpe": op6_bpe,
    "op7_suffix_dedup": op7_suffix_dedup,
    "op8_packing": op8_packing,
    "op9_warc": op9_warc,
    "op10_ngram_join": op10_ngram_join,
}

ORACLE_SQL: dict[str, str] = {"op2_topk": OP2_SQL}
