"""The queries of this subpackage and their DuckDB SQL where SQL can express them."""

from __future__ import annotations

from isovox.llm.fingerprints import op1_fingerprints
from isovox.llm.hidden_markov import op10_hidden_markov
from isovox.llm.language_id import op8_language_id
from isovox.llm.mixing import OP6_SQL, op6_mix_sources
from isovox.llm.near_dedup import OP5_SQL, op5_near_dedup
from isovox.llm.packing import op2_pack
from isovox.llm.quality_model import op3_quality_model
from isovox.llm.quality_rules import OP7_SQL, op7_quality_rules
from isovox.llm.substring_dedup import OP9_SQL, op9_substring_dedup
from isovox.llm.surrogates import op4_surrogates

QUERIES = {
    "op1_fingerprints": op1_fingerprints,
    "op2_pack": op2_pack,
    "op3_quality_model": op3_quality_model,
    "op4_surrogates": op4_surrogates,
    "op5_near_dedup": op5_near_dedup,
    "op6_mix_sources": op6_mix_sources,
    "op7_quality_rules": op7_quality_rules,
    "op8_language_id": op8_language_id,
    "op9_substring_dedup": op9_substring_dedup,
    "op10_hidden_markov": op10_hidden_markov,
}
ORACLE_SQL = {
    "op5_near_dedup": OP5_SQL,
    "op6_mix_sources": OP6_SQL,
    "op7_quality_rules": OP7_SQL,
    "op9_substring_dedup": OP9_SQL,
}
