"""The queries of this folder and the SQL that some of them equal."""

from __future__ import annotations

from kinweave.llm import bpe, exact_dedup, fingerprints, language, line_dedup, near_dedup, packing, quality, sharding, token_counts


def queries() -> dict:
    return {
        "op1_sharding": sharding.op1_sharding,
        "op2_bpe": bpe.op2_bpe,
        "op3_line_dedup": line_dedup.op3_line_dedup,
        "op4_language": language.op4_language,
        "op5_packing": packing.op5_packing,
        "op6_near_dedup": near_dedup.op6_near_dedup,
        "op7_token_counts": token_counts.op7_token_counts,
        "op8_exact_dedup": exact_dedup.op8_exact_dedup,
        "op9_quality": quality.op9_quality,
        "op10_fingerprints": fingerprints.op10_fingerprints,
    }


def oracle_sql() -> dict[str, str]:
    return {"op3_line_dedup": line_dedup.OP3_SQL, "op8_exact_dedup": exact_dedup.OP8_SQL}
