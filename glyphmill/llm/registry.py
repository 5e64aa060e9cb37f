"""Queries of this subpackage and their SQL oracles."""

from __future__ import annotations

from . import exact_dedup, line_dedup, mixing, near_dup, packing, quality, secret_scan, substring_dedup, toxicity, warc


def _pipeline(spark, sf_dir):
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


def queries() -> dict:
    return {
        "pipeline": _pipeline,
        "op1_best_fit_packing": packing.op1_best_fit_packing,
        "op2_quality_rules": quality.op2_quality_rules,
        "op3_secret_scan": secret_scan.op3_secret_scan,
        "op4_near_dup": near_dup.op4_near_dup,
        "op5_mixing": mixing.op5_mixing,
        "op6_line_dedup": line_dedup.op6_line_dedup,
        "op7_exact_dedup": exact_dedup.op7_exact_dedup,
        "op8_warc": warc.op8_warc,
        "op9_suffix_array_dedup": substring_dedup.op9_suffix_array_dedup,
        "op10_toxicity": toxicity.op10_toxicity,
    }


def oracle_sql() -> dict[str, str]:
    return {"op2_quality_rules": quality.OP2_SQL, "op5_mixing": mixing.OP5_SQL, "op6_line_dedup": line_dedup.OP6_SQL, "op7_exact_dedup": exact_dedup.OP7_SQL, "op8_warc": warc.OP8_SQL}
