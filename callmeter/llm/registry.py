"""The registered queries of this subpackage and their SQL."""

from __future__ import annotations

from callmeter.llm import bpe_codec as _op8
from callmeter.llm import decontaminate as _op9
from callmeter.llm import exact_dedup as _op7
from callmeter.llm import hard_negatives as _op11
from callmeter.llm import jaccard_join as _op5
from callmeter.llm import lang_id as _op1
from callmeter.llm import lexical_search as _op12
from callmeter.llm import licenses as _op10
from callmeter.llm import line_dedup as _op13
from callmeter.llm import lm_score as _op3
from callmeter.llm import pii as _op2
from callmeter.llm import token_files as _op6
from callmeter.llm import toxicity as _op4

QUERIES = {
    "op1_language_id": _op1.op1_language_id,
    "op2_pii": _op2.op2_pii,
    "op3_lm_score": _op3.op3_lm_score,
    "op4_toxicity": _op4.op4_toxicity,
    "op5_jaccard_join": _op5.op5_jaccard_join,
    "op6_token_files": _op6.op6_token_files,
    "op7_exact_dedup": _op7.op7_exact_dedup,
    "op8_bpe_codec": _op8.op8_bpe_codec,
    "op9_decontaminate": _op9.op9_decontaminate,
    "op10_licenses": _op10.op10_licenses,
    "op11_hard_negatives": _op11.op11_hard_negatives,
    "op12_lexical_search": _op12.op12_lexical_search,
    "op13_line_dedup": _op13.op13_line_dedup,
}
SQL = {"op7_exact_dedup": _op7.OP7_SQL, "op11_hard_negatives": _op11.OP11_SQL, "op12_lexical_search": _op12.OP12_SQL, "op13_line_dedup": _op13.OP13_SQL}
