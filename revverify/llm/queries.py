"""The queries of this subpackage, and the SQL of those that SQL can express."""

from __future__ import annotations

from .conversations import ORACLE_OP11, op11_conversation_repair
from .jaccard import ORACLE_OP5, op5_ngram_jaccard_join
from .licenses import ORACLE_OP10, op10_license_scan
from .mixing import op9_source_mixing
from .phrases import ORACLE_OP13, op13_phrase_mining
from .pieces import op2_piece_encoding
from .pii import op7_pii_surrogates
from .quality import op4_quality_classifier
from .repeats import ORACLE_OP12, op12_substring_dedup
from .sharding import op6_histogram_sharding
from .tokenfiles import op3_token_files
from .vectors import ORACLE_OP1, ORACLE_OP8, op1_embedding_near_dedup, op8_exact_top_k

QUERIES = {
    f.__name__: f
    for f in (
        op1_embedding_near_dedup, op2_piece_encoding, op3_token_files, op4_quality_classifier, op5_ngram_jaccard_join,
        op6_histogram_sharding, op7_pii_surrogates, op8_exact_top_k, op9_source_mixing, op10_license_scan,
        op11_conversation_repair, op12_substring_dedup, op13_phrase_mining,
    )
}
ORACLES = {"op1_embedding_near_dedup": ORACLE_OP1, "op5_ngram_jaccard_join": ORACLE_OP5, "op8_exact_top_k": ORACLE_OP8, "op10_license_scan": ORACLE_OP10, "op11_conversation_repair": ORACLE_OP11, "op12_substring_dedup": ORACLE_OP12, "op13_phrase_mining": ORACLE_OP13}
