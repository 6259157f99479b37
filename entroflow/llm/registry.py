"""Queries of this subpackage and, where SQL can express them, the SQL with the same result."""

from .alignment import op12_alignment
from .bpe import op7_bpe
from .collocation import OP11_SQL, op11_collocation
from .exact_dedup import OP4_SQL, op4_exact_dedup
from .html_text import op3_html_text
from .language import op1_language
from .lm_score import op9_lm_score
from .minhash import op2_minhash
from .packing import op8_packing
from .privacy import op13_privacy
from .quality import op10_quality
from .vector_dedup import OP5_SQL, op5_vectors
from .warc import OP6_SQL, op6_warc

QUERIES = {
    "op1_language": op1_language,
    "op2_minhash": op2_minhash,
    "op3_html_text": op3_html_text,
    "op4_exact_dedup": op4_exact_dedup,
    "op5_vectors": op5_vectors,
    "op6_warc": op6_warc,
    "op7_bpe": op7_bpe,
    "op8_packing": op8_packing,
    "op9_lm_score": op9_lm_score,
    "op10_quality": op10_quality,
    "op11_collocation": op11_collocation,
    "op12_alignment": op12_alignment,
    "op13_privacy": op13_privacy,
}

ORACLES = {
    "op4_exact_dedup": OP4_SQL,
    "op5_vectors": OP5_SQL,
    "op6_warc": OP6_SQL,
    "op11_collocation": OP11_SQL,
}
