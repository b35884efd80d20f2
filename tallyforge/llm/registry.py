"""Queries of this subpackage, and their SQL where there is one."""

from __future__ import annotations

from .ann import op8_ann
from .centroids import OP13_SQL, op13_centroid_clustering
from .decontaminate import OP3_SQL, op3_decontaminate
from .html_text import op6_html_extraction
from .language_id import op2_language_id
from .license_scan import OP1_SQL, op1_license_scan
from .line_dedup import OP5_SQL, op5_line_dedup
from .mixing import OP12_SQL, op12_source_mixing
from .ngram_join import OP9_SQL, op9_ngram_jaccard_join
from .packing import op4_best_fit_packing
from .phrases import OP11_SQL, op11_phrase_collocations
from .token_counts import op10_token_counts
from .training_order import op7_training_order

QUERIES = {
    f.__name__: f
    for f in (
        op1_license_scan, op2_language_id, op3_decontaminate, op4_best_fit_packing, op5_line_dedup,
        op6_html_extraction, op7_training_order, op8_ann, op9_ngram_jaccard_join, op10_token_counts, op11_phrase_collocations, op12_source_mixing, op13_centroid_clustering,
    )
}
SQL = {"op1_license_scan": OP1_SQL, "op3_decontaminate": OP3_SQL, "op5_line_dedup": OP5_SQL, "op9_ngram_jaccard_join": OP9_SQL, "op11_phrase_collocations": OP11_SQL, "op12_source_mixing": OP12_SQL, "op13_centroid_clustering": OP13_SQL}
