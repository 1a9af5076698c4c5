"""The registered queries of this subpackage and their SQL."""

from __future__ import annotations

from . import decontaminate, exact_dedup, language, lm, packing, pii, quality, simhash, substring_dedup, token_output


def queries() -> dict:
    return {
        "op1_pii": pii.op1_pii,
        "op2_token_output": token_output.op2_token_output,
        "op3_lm_score": lm.op3_lm_score,
        "op4_exact_dedup": exact_dedup.op4_exact_dedup,
        "op5_quality": quality.op5_quality,
        "op6_substring_dedup": substring_dedup.op6_substring_dedup,
        "op7_language": language.op7_language,
        "op8_decontaminate": decontaminate.op8_decontaminate,
        "op9_packing": packing.op9_packing,
        "op10_simhash": simhash.op10_simhash,
    }


def oracle_sql() -> dict[str, str]:
    return exact_dedup.SQL | substring_dedup.SQL | decontaminate.SQL
