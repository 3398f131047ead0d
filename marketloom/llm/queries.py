"""The queries of this folder and their SQL, by name."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from marketloom.llm.collocations import OP11_SQL, op11_collocations
from marketloom.llm.decontamination import OP1_SQL, op1_decontamination
from marketloom.llm.language_model import op3_lm_scoring
from marketloom.llm.licenses import OP9_SQL, op9_license_scan
from marketloom.llm.mixing import OP7_SQL, op7_mixing
from marketloom.llm.near_dups import OP2_SQL, op2_near_dups
from marketloom.llm.packing import op12_packing
from marketloom.llm.quality_classifier import op6_quality_classifier
from marketloom.llm.quality_rules import OP4_SQL, op4_quality_rules
from marketloom.llm.ranked_search import OP13_SQL, op13_ranked_search
from marketloom.llm.sharding import OP10_SQL, op10_sharding
from marketloom.llm.substrings import OP8_SQL, op8_substring_dedup
from marketloom.llm.tokens import op5_token_ids

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_decontamination": op1_decontamination,
    "op2_near_dups": op2_near_dups,
    "op3_lm_scoring": op3_lm_scoring,
    "op4_quality_rules": op4_quality_rules,
    "op5_token_ids": op5_token_ids,
    "op6_quality_classifier": op6_quality_classifier,
    "op7_mixing": op7_mixing,
    "op8_substring_dedup": op8_substring_dedup,
    "op9_license_scan": op9_license_scan,
    "op10_sharding": op10_sharding,
    "op11_collocations": op11_collocations,
    "op12_packing": op12_packing,
    "op13_ranked_search": op13_ranked_search,
}

SQL: dict[str, str] = {
    "op1_decontamination": OP1_SQL,
    "op2_near_dups": OP2_SQL,
    "op4_quality_rules": OP4_SQL,
    "op7_mixing": OP7_SQL,
    "op8_substring_dedup": OP8_SQL,
    "op9_license_scan": OP9_SQL,
    "op10_sharding": OP10_SQL,
    "op11_collocations": OP11_SQL,
    "op13_ranked_search": OP13_SQL,
}
