"""The queries of this subpackage, by the names under which they are registered."""

from __future__ import annotations

from .ann_search import op10_ann_search
from .bpe_codec import op9_bpe_codec
from .decontamination import SQL as DECONTAMINATION_SQL
from .decontamination import op13_benchmark_decontamination
from .embedding_dedup import op8_embedding_near_dedup
from .html_extract import op2_html_extraction
from .langid_crf import op3_language_id
from .line_dedup import op7_line_dedup
from .ngram_join import op1_ngram_jaccard_join
from .packing import op4_best_two_fit_packing
from .prefix_trie import SQL as PREFIX_TRIE_SQL
from .prefix_trie import op11_conversation_prefix_trie
from .token_counts import op5_token_counts
from .toxicity import op6_toxicity
from .whitening import op12_embedding_whitening

QUERIES = {
    f.__name__: f
    for f in (
        op1_ngram_jaccard_join,
        op2_html_extraction,
        op3_language_id,
        op4_best_two_fit_packing,
        op5_token_counts,
        op6_toxicity,
        op7_line_dedup,
        op8_embedding_near_dedup,
        op9_bpe_codec,
        op10_ann_search,
        op11_conversation_prefix_trie,
        op12_embedding_whitening,
        op13_benchmark_decontamination,
    )
}

# The others can't be written in SQL at the size of the tables: tokenizers, learned models,
# graph searches, eigenvectors and iterated links are tested against brute force.
ORACLE_SQL: dict[str, str] = {"op11_conversation_prefix_trie": PREFIX_TRIE_SQL, "op13_benchmark_decontamination": DECONTAMINATION_SQL}
