"""The registered queries of this subpackage and, where SQL can express them, their DuckDB oracles."""

from __future__ import annotations

from .ann import op7_multi_index_search
from .decontaminate import op4_automaton_decontamination
from .katz import op5_katz_scores
from .licenses import op11_license_join
from .merkle import OP12_SQL, op12_jumped_manifest
from .neardup import op3_fast_sketch_dedup
from .packing import op2_pattern_packing
from .preferences import OP8_SQL, op8_preference_pairs
from .quality import op1_ordinal_quality
from .records import op9_token_records
from .spelling import op13_sorted_spelling
from .toxicity import op10_toxicity
from .warc import OP6_SQL, op6_seekable_warc

QUERIES = {
    "op1_ordinal_quality": op1_ordinal_quality,
    "op2_pattern_packing": op2_pattern_packing,
    "op3_fast_sketch_dedup": op3_fast_sketch_dedup,
    "op4_automaton_decontamination": op4_automaton_decontamination,
    "op5_katz_scores": op5_katz_scores,
    "op6_seekable_warc": op6_seekable_warc,
    "op7_multi_index_search": op7_multi_index_search,
    "op8_preference_pairs": op8_preference_pairs,
    "op9_token_records": op9_token_records,
    "op10_toxicity": op10_toxicity,
    "op11_license_join": op11_license_join,
    "op12_jumped_manifest": op12_jumped_manifest,
    "op13_sorted_spelling": op13_sorted_spelling,
}

ORACLE_SQL: dict[str, str] = {
    "op6_seekable_warc": OP6_SQL,
    "op8_preference_pairs": OP8_SQL,
    "op12_jumped_manifest": OP12_SQL,
}
