"""Queries of the package and their SQL, added to the driver's entry where the package is there."""

from __future__ import annotations

import corpus_pipeline

from . import bpe, cpjoin, decontam, imatch, linedup, quality, sharding, suffix, toxicity, warc


def queries() -> dict:
    return {
        "pipeline": corpus_pipeline.run,
        "op1_imatch": imatch.op1_imatch,
        "op2_toxicity": toxicity.op2_toxicity,
        "op3_decontam": decontam.op3_decontam,
        "op4_warc": warc.op4_warc,
        "op5_quality": quality.op5_quality,
        "op6_linedup": linedup.op6_linedup,
        "op7_cpjoin": cpjoin.op7_cpjoin,
        "op8_suffix": suffix.op8_suffix,
        "op9_bpe": bpe.op9_bpe,
        "op10_sharding": sharding.op10_sharding,
    }


def oracle_sql() -> dict[str, str]:
    return {} if corpus_pipeline.ORACLE_SQL is None else {"pipeline": corpus_pipeline.ORACLE_SQL}
