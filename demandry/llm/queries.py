"""The queries of this subpackage and their SQL."""

from __future__ import annotations

from .audit import OP13_SQL, op13_filters
from .html import op10_html
from .langid import op4_language
from .licenses import OP7_SQL, op7_licenses
from .lines import OP3_SQL, op3_line_dedup
from .lloyd import OP12_SQL, op12_lloyd
from .lm import op5_lm_score
from .media import op9_media
from .mixing import OP2_SQL, op2_mixing
from .simhash import op1_simhash
from .suffix import op6_decontaminate
from .tokens import op11_tokens
from .toxicity import op8_toxicity

QUERIES = {
    "op1_simhash": op1_simhash,
    "op2_mixing": op2_mixing,
    "op3_line_dedup": op3_line_dedup,
    "op4_language": op4_language,
    "op5_lm_score": op5_lm_score,
    "op6_decontaminate": op6_decontaminate,
    "op7_licenses": op7_licenses,
    "op8_toxicity": op8_toxicity,
    "op9_media": op9_media,
    "op10_html": op10_html,
    "op11_tokens": op11_tokens,
    "op12_lloyd": op12_lloyd,
    "op13_filters": op13_filters,
}
SQL = {"op2_mixing": OP2_SQL, "op3_line_dedup": OP3_SQL, "op7_licenses": OP7_SQL, "op12_lloyd": OP12_SQL, "op13_filters": OP13_SQL}
