"""The registered queries of this subpackage and their SQL."""

from leadloom.llm.bpe import op6_byte_bpe
from leadloom.llm.centroids import OP13_SQL, op13_centroids
from leadloom.llm.fingerprints import op5_fingerprints
from leadloom.llm.html_extract import op2_html_text
from leadloom.llm.importance import op12_importance
from leadloom.llm.language_id import op9_language_id
from leadloom.llm.lm_score import op4_lm_score
from leadloom.llm.mixing import OP8_SQL, op8_mix_sources
from leadloom.llm.near_dedup import op3_near_dedup
from leadloom.llm.piece_bpe import op11_piece_bpe
from leadloom.llm.quality_rules import OP1_SQL, op1_quality_rules
from leadloom.llm.toxicity import op10_toxicity
from leadloom.llm.url_filter import op7_url_filter

QUERIES = {
    "op1_quality_rules": op1_quality_rules,
    "op2_html_text": op2_html_text,
    "op3_near_dedup": op3_near_dedup,
    "op4_lm_score": op4_lm_score,
    "op5_fingerprints": op5_fingerprints,
    "op6_byte_bpe": op6_byte_bpe,
    "op7_url_filter": op7_url_filter,
    "op8_mix_sources": op8_mix_sources,
    "op9_language_id": op9_language_id,
    "op10_toxicity": op10_toxicity,
    "op11_piece_bpe": op11_piece_bpe,
    "op12_importance": op12_importance,
    "op13_centroids": op13_centroids,
}
#: The others learn, hash or parse in ways that SQL cannot express; tests hold them against brute force.
SQL = {"op1_quality_rules": OP1_SQL, "op8_mix_sources": OP8_SQL, "op13_centroids": OP13_SQL}
