"""The registered queries of this subpackage, and SQL where SQL can express them."""

from __future__ import annotations

from .decontamination import op9_decontamination
from .embedding_dedup import op5_embedding_dedup
from .html_text import op8_html_extraction
from .language_id import op10_language_id
from .minhash_dedup import op2_minhash_dedup
from .mixing import op7_mixing
from .suffix_dedup import op4_suffix_dedup
from .token_output import op1_token_output
from .toxicity import op3_toxicity
from .url_filter import op6_sql, op6_url_filter

QUERIES = {
    f.__name__: f
    for f in (
        op1_token_output, op2_minhash_dedup, op3_toxicity, op4_suffix_dedup, op5_embedding_dedup, op6_url_filter,
        op7_mixing, op8_html_extraction, op9_decontamination, op10_language_id,
    )
}
ORACLE_SQL = {"op6_url_filter": op6_sql()}
