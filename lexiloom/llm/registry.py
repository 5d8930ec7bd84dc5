"""Queries of the subpackage and their DuckDB SQL, for __spark_entry__."""

from __future__ import annotations

from . import exact_dedup, extraction, language, media, middle, mixing, near_dup, packing, pii, quality, resampling, secrets, sharding


def queries() -> dict:
    return {
        "op1_secret_forest": secrets.op1_secret_forest,
        "op2_vector_packing": packing.op2_vector_packing,
        "op3_jump_sharding": sharding.op3_jump_sharding,
        "op4_avi_mjpeg": media.op4_avi_mjpeg,
        "op5_bbit_minhash": near_dup.op5_bbit_minhash,
        "op6_template_extraction": extraction.op6_template_extraction,
        "op7_exact_dedup": exact_dedup.op7_exact_dedup,
        "op8_pivotal_mix": mixing.op8_pivotal_mix,
        "op9_quality": quality.op9_quality,
        "op10_personal_data": pii.op10_personal_data,
        "op11_language": language.op11_language,
        "op12_fill_in_middle": middle.op12_fill_in_middle,
        "op13_importance_resampling": resampling.op13_importance_resampling,
    }


def oracle_sql() -> dict[str, str]:
    return {"op3_jump_sharding": sharding.OP3_SQL, "op7_exact_dedup": exact_dedup.OP7_SQL, "op12_fill_in_middle": middle.OP12_SQL}
