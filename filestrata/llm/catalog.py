"""The registered queries of this subpackage."""
from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import (alignment, byte_bpe, decontaminate, fill_middle, language, lattice_lm, licences, main_text, near_copies, private_data, quality_rules,
               token_counts, toxicity)

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_toxicity": toxicity.op1_toxicity,
    "op2_licences": licences.op2_licences,
    "op3_surrogates": private_data.op3_surrogates,
    "op4_decontamination": decontaminate.op4_decontamination,
    "op5_byte_bpe": byte_bpe.op5_byte_bpe,
    "op6_near_copies": near_copies.op6_near_copies,
    "op7_token_counts": token_counts.op7_token_counts,
    "op8_lattice_lm": lattice_lm.op8_lattice_lm,
    "op9_main_text": main_text.op9_main_text,
    "op10_quality_rules": quality_rules.op10_quality_rules,
    "llm_quality_base": quality_rules.base_counts,
    "op11_language": language.op11_language,
    "op12_token_alignment": alignment.op12_token_alignment,
    "op13_fill_middle": fill_middle.op13_fill_middle,
}
#: The other operators' results cannot be said in SQL as a whole; tests compare them with brute force.
ORACLES: dict[str, str] = {"op6_near_copies": near_copies.OP6_SQL, "llm_quality_base": quality_rules.BASE_SQL, "op13_fill_middle": fill_middle.OP13_SQL}
