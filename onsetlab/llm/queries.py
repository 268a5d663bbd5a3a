"""The registered queries of the text operators, and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

import corpus_pipeline
from onsetlab.llm import align, exact, iblt, lengths, mixing, packing, pieces, pii, sharding, simhash, substrings, toxicity, variants


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/labels.parquet")


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "pipeline": corpus_pipeline.run,
        "op1_mix": lambda spark, sf: mixing.query(documents(spark, sf)),
        "op2_shards": lambda spark, sf: sharding.query(documents(spark, sf)),
        "op3_simhash": lambda spark, sf: simhash.query(documents(spark, sf)),
        "op4_fingerprints": lambda spark, sf: iblt.query(documents(spark, sf)),
        "op5_exact_dedup": lambda spark, sf: exact.query(documents(spark, sf)),
        "op6_token_lengths": lambda spark, sf: lengths.query(documents(spark, sf)),
        "op7_personal_data": lambda spark, sf: pii.query(documents(spark, sf)),
        "op8_repeated_substrings": lambda spark, sf: substrings.query(documents(spark, sf)),
        "op9_sentencepiece": lambda spark, sf: pieces.query(documents(spark, sf)),
        "op10_toxicity": lambda spark, sf: toxicity.query(documents(spark, sf), labels(spark, sf)),
        "op11_alignment": lambda spark, sf: align.query(documents(spark, sf)),
        "op12_packing": lambda spark, sf: packing.query(documents(spark, sf)),
        "op13_variants": lambda spark, sf: variants.query(documents(spark, sf)),
    }


def oracle_sql() -> dict[str, str]:
    return {
        "op1_mix": mixing.oracle(),
        "op5_exact_dedup": exact.ORACLE,
    }
