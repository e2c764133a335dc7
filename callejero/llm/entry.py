"""Queries of the corpus operators and the SQL that states the same, where SQL can."""

from __future__ import annotations

from .decontamination import OP2_SQL, op2_decontamination
from .html_extraction import op8_html_extraction
from .jaccard_join import OP12_SQL, op12_jaccard_join
from .language_id import op1_language_id
from .merkle_manifest import OP13_SQL, op13_merkle_manifest
from .mixing import op3_mixing
from .near_dedup import op9_near_dedup
from .pii import op5_pii
from .prefix_trie import OP11_SQL, op11_prefix_trie
from .quality_classifier import op10_quality_classifier
from .quality_rules import OP7_SQL, op7_quality_rules
from .sharding import op4_sharding
from .substring_dedup import OP6_SQL, op6_substring_dedup

QUERIES = {
    "op1_language_id": op1_language_id,
    "op2_decontamination": op2_decontamination,
    "op3_mixing": op3_mixing,
    "op4_sharding": op4_sharding,
    "op5_pii": op5_pii,
    "op6_substring_dedup": op6_substring_dedup,
    "op7_quality_rules": op7_quality_rules,
    "op8_html_extraction": op8_html_extraction,
    "op9_near_dedup": op9_near_dedup,
    "op10_quality_classifier": op10_quality_classifier,
    "op11_prefix_trie": op11_prefix_trie,
    "op12_jaccard_join": op12_jaccard_join,
    "op13_merkle_manifest": op13_merkle_manifest,
}

ORACLE_SQL: dict[str, str] = {
    "op2_decontamination": OP2_SQL,
    "op6_substring_dedup": OP6_SQL,
    "op7_quality_rules": OP7_SQL,
    "op11_prefix_trie": OP11_SQL,
    "op12_jaccard_join": OP12_SQL,
    "op13_merkle_manifest": OP13_SQL,
}
