"""Queries and SQL of this subpackage, by name."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import covertree, licences, minhash, mixing, packing, quality, simhash, suffixes, toxicity, warc

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_minhash": minhash.op1_minhash,
    "op2_mixing": mixing.op2_mixing,
    "op3_quality": quality.op3_quality,
    "op4_suffixes": suffixes.op4_suffixes,
    "op5_licences": licences.op5_licences,
    "op6_simhash": simhash.op6_simhash,
    "op7_warc": warc.op7_warc,
    "op8_toxicity": toxicity.op8_toxicity,
    "op9_top_k": covertree.op9_top_k,
    "op10_packing": packing.op10_packing,
}


def oracle_sql() -> dict[str, str]:
    return {
        "op1_minhash": minhash.OP1_SQL,
        "op4_suffixes": suffixes.OP4_SQL,
        "op5_licences": licences.op5_sql(),
        "op7_warc": warc.OP7_SQL,
        "op9_top_k": covertree.OP9_SQL,
    }
