"""The registered queries of this subpackage and, where SQL can express them, their DuckDB SQL."""

from __future__ import annotations

from . import op1_licenses, op3_mixing, op4_line_dedup, op6_exact_topk, op11_warc
from .op10_ngram_join import op10_ngram_join
from .op12_whitening import op12_whitening
from .op13_conversation_repair import op13_conversation_repair
from .op2_toxicity import op2_toxicity
from .op5_sentencepiece import op5_sentencepiece
from .op7_quality_rules import op7_quality_rules
from .op8_token_files import op8_token_files
from .op9_language import op9_language

QUERIES = {
    "op1_licenses": op1_licenses.op1_licenses,
    "op2_toxicity": op2_toxicity,
    "op3_mixing": op3_mixing.op3_mixing,
    "op4_line_dedup": op4_line_dedup.op4_line_dedup,
    "op5_sentencepiece": op5_sentencepiece,
    "op6_exact_topk": op6_exact_topk.op6_exact_topk,
    "op7_quality_rules": op7_quality_rules,
    "op8_token_files": op8_token_files,
    "op9_language": op9_language,
    "op10_ngram_join": op10_ngram_join,
    "op11_warc": op11_warc.op11_warc,
    "op12_whitening": op12_whitening,
    "op13_conversation_repair": op13_conversation_repair,
}

ORACLE_SQL: dict[str, str] = {
    "op1_licenses": op1_licenses.oracle_sql(),
    "op3_mixing": op3_mixing.oracle_sql(),
    "op6_exact_topk": op6_exact_topk.ORACLE_SQL,
    "op11_warc": op11_warc.ORACLE_SQL,
}
