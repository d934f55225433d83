"""The queries of the ten operators, with their SQL where it can express them."""

from __future__ import annotations

from dovetail.llm.language_id import op2_language_id
from dovetail.llm.media import op10_progressive_jpeg
from dovetail.llm.ngram_join import OP7_SQL, op7_ngram_jaccard_join
from dovetail.llm.packing import op1_hierarchical_packing
from dovetail.llm.pitman_yor import op3_pitman_yor
from dovetail.llm.pivot_search import OP4_SQL, op4_pivot_top_k
from dovetail.llm.quality import op9_quality_knn
from dovetail.llm.secrets import OP8_SQL, op8_secret_scan
from dovetail.llm.sentencepiece import op5_sentencepiece
from dovetail.llm.toxicity import op6_toxicity_kneser_ney

QUERIES = {
    f.__name__: f
    for f in (
        op1_hierarchical_packing,
        op2_language_id,
        op3_pitman_yor,
        op4_pivot_top_k,
        op5_sentencepiece,
        op6_toxicity_kneser_ney,
        op7_ngram_jaccard_join,
        op8_secret_scan,
        op9_quality_knn,
        op10_progressive_jpeg,
    )
}
ORACLES = {"op4_pivot_top_k": OP4_SQL, "op7_ngram_jaccard_join": OP7_SQL, "op8_secret_scan": OP8_SQL}
