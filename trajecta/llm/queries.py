"""The queries of the training-data operators and their SQL, by name."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from trajecta.llm import fill_in_middle, licenses, merkle, near_dedup, warc
from trajecta.llm.ann import op10_ann
from trajecta.llm.decontamination import op5_decontamination
from trajecta.llm.fill_in_middle import op11_fill_in_middle
from trajecta.llm.language_id import op3_language_id
from trajecta.llm.licenses import op1_license_scans
from trajecta.llm.merkle import op13_merkle_manifest
from trajecta.llm.near_dedup import op6_minhash_near_dedup
from trajecta.llm.packing import op7_best_fit_packing
from trajecta.llm.sharding import op4_sharding
from trajecta.llm.token_binary import op2_token_binary
from trajecta.llm.token_counts import op9_token_counts
from trajecta.llm.toxicity import op8_toxicity
from trajecta.llm.warc import op12_warc


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    found = [
        op1_license_scans, op2_token_binary, op3_language_id, op4_sharding, op5_decontamination,
        op6_minhash_near_dedup, op7_best_fit_packing, op8_toxicity, op9_token_counts, op10_ann,
        op11_fill_in_middle, op12_warc, op13_merkle_manifest,
    ]
    return {f.__name__: f for f in found}


def oracle_sql() -> dict[str, str]:
    return {
        "op1_license_scans": licenses.oracle(), "op6_minhash_near_dedup": near_dedup.ORACLE_SQL, "op11_fill_in_middle": fill_in_middle.ORACLE_SQL,
        "op12_warc": warc.ORACLE_SQL, "op13_merkle_manifest": merkle.ORACLE_SQL,
    }
