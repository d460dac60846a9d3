"""The queries of this subpackage, by name, and their SQL where SQL can express them."""

from __future__ import annotations

from sluice.llm.bpe import op3_bpe_tree
from sluice.llm.chunks import op9_chunk_fingerprints
from sluice.llm.flac import op5_flac_media
from sluice.llm.infill import OP11_SQL, op11_skip_list_infill
from sluice.llm.negatives import OP12_SQL, op12_residue_negatives
from sluice.llm.ngrams import op6_ngram_jaccard
from sluice.llm.packing import op2_best_fit_packing
from sluice.llm.private import op7_private_data
from sluice.llm.quality import op4_quality_classifier
from sluice.llm.secrets import op1_secret_scan
from sluice.llm.sharding import op10_histogram_sharding
from sluice.llm.simhash import op13_pigeonring_simhash
from sluice.llm.suffixes import op8_suffix_dedup

QUERIES = {
    f.__name__: f
    for f in (
        op1_secret_scan,
        op2_best_fit_packing,
        op3_bpe_tree,
        op4_quality_classifier,
        op5_flac_media,
        op6_ngram_jaccard,
        op7_private_data,
        op8_suffix_dedup,
        op9_chunk_fingerprints,
        op10_histogram_sharding,
        op11_skip_list_infill,
        op12_residue_negatives,
        op13_pigeonring_simhash,
    )
}

ORACLE_SQL: dict[str, str] = {"op11_skip_list_infill": OP11_SQL, "op12_residue_negatives": OP12_SQL}
