"""The queries of this package, by name, and their SQL where SQL can express them."""

from __future__ import annotations

from lumenq.llm import chat, classifier, decontamination, line_dedup, mixing, near_dedup, quality_rules, sharding, substring_dedup, token_output


def queries() -> dict:
    import corpus_pipeline

    return {
        "op1_quality_rules": quality_rules.op1_quality_rules,
        "op2_line_dedup": line_dedup.op2_line_dedup,
        "op3_near_dedup": near_dedup.op3_near_dedup,
        "op4_substring_dedup": substring_dedup.op4_substring_dedup,
        "op5_sharding": sharding.op5_sharding,
        "op6_decontamination": decontamination.op6_decontamination,
        "op7_mixing": mixing.op7_mixing,
        "op8_chat": chat.op8_chat,
        "op9_quality_classifier": classifier.op9_quality_classifier,
        "op10_token_output": token_output.op10_token_output,
        "pipeline": corpus_pipeline.run,
    }


def oracle_sql() -> dict[str, str]:
    return {
        "op1_quality_rules": quality_rules.ORACLE,
        "op2_line_dedup": line_dedup.ORACLE,
        "op3_near_dedup": near_dedup.ORACLE,
        "op4_substring_dedup": substring_dedup.ORACLE,
        "op7_mixing": mixing.ORACLE,
        "op8_chat": chat.ORACLE,
    }
