"""The queries of this subpackage and their SQL."""

from __future__ import annotations

from .ctw import op1_lm_score
from .decontamination import OP2_SQL, op2_decontamination
from .html_text import op9_html_text
from .line_dedup import OP8_SQL, op8_line_dedup
from .mixing import OP7_SQL, op7_mixing
from .near_dedup import OP3_SQL, op3_near_dedup
from .passages import op10_passages
from .quality import OP6_SQL, op6_quality
from .token_records import op5_token_records
from .toxicity import op4_toxicity

QUERIES = {
    "op1_lm_score": op1_lm_score,
    "op2_decontamination": op2_decontamination,
    "op3_near_dedup": op3_near_dedup,
    "op4_toxicity": op4_toxicity,
    "op5_token_records": op5_token_records,
    "op6_quality": op6_quality,
    "op7_mixing": op7_mixing,
    "op8_line_dedup": op8_line_dedup,
    "op9_html_text": op9_html_text,
    "op10_passages": op10_passages,
}
SQL = {"op2_decontamination": OP2_SQL, "op3_near_dedup": OP3_SQL, "op6_quality": OP6_SQL, "op7_mixing": OP7_SQL, "op8_line_dedup": OP8_SQL}
