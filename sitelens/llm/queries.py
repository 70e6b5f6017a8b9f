"""Queries of this subpackage by name, and their SQL where SQL can express them."""

from __future__ import annotations

from .alignment import op13_cross_tokenizer_alignment
from .decontaminate import op6_benchmark_decontamination
from .html_text import op5_html_extraction
from .jaccard import op11_ngram_jaccard_join
from .language_model import op2_kneser_ney_scoring
from .line_dedup import OP10_SQL, op10_line_dedup
from .packing import op1_best_fit_packing
from .quality import op9_quality_rules
from .secrets import op4_secret_scan
from .sharding import op8_two_pass_sharding
from .simhash import op7_simhash_near_dedup
from .toxicity import op3_toxicity
from .whitening import op12_embedding_whitening

QUERIES = {
    f.__name__: f
    for f in (
        op1_best_fit_packing,
        op2_kneser_ney_scoring,
        op3_toxicity,
        op4_secret_scan,
        op5_html_extraction,
        op6_benchmark_decontamination,
        op7_simhash_near_dedup,
        op8_two_pass_sharding,
        op9_quality_rules,
        op10_line_dedup,
        op11_ngram_jaccard_join,
        op12_embedding_whitening,
        op13_cross_tokenizer_alignment,
    )
}
ORACLE_SQL = {"op10_line_dedup": OP10_SQL}
