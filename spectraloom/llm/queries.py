"""The queries of this subpackage, by name, and the SQL of those that SQL can express."""

from . import chat, url_filter
from .chat import op1_chat_formatting
from .fingerprints import op8_fingerprints
from .html_text import op7_html_extraction
from .minhash_dedup import op2_minhash_dedup
from .mixing import op4_mixing
from .packing import op3_best_fit_packing
from .quality import op9_quality_rules
from .substring_dedup import op6_substring_dedup
from .toxicity import op5_toxicity
from .url_filter import op10_url_filter

QUERIES = {
    "op1_chat_formatting": op1_chat_formatting,
    "op2_minhash_dedup": op2_minhash_dedup,
    "op3_best_fit_packing": op3_best_fit_packing,
    "op4_mixing": op4_mixing,
    "op5_toxicity": op5_toxicity,
    "op6_substring_dedup": op6_substring_dedup,
    "op7_html_extraction": op7_html_extraction,
    "op8_fingerprints": op8_fingerprints,
    "op9_quality_rules": op9_quality_rules,
    "op10_url_filter": op10_url_filter,
}

SQL: dict[str, str] = {"op1_chat_formatting": chat.SQL, "op10_url_filter": url_filter.SQL}
