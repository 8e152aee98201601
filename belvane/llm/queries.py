"""The registered queries of this subpackage, over whole tables, and their SQL where there is any."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from belvane.llm import bpe, collocations, fingerprints, language_id, licenses, mixing, ngram_join, pii, quality_classifier, quality_rules, runs, sharding, simhash


def _over_documents(operator: Callable[[DataFrame], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    def query(spark: SparkSession, sf_dir: str) -> DataFrame:
        return operator(spark.read.parquet(f"{sf_dir}/documents.parquet"))

    return query


OPERATORS: dict[str, Callable[[DataFrame], DataFrame]] = {
    "op1_quality_rules": quality_rules.judge_hosts,
    "op2_pii": pii.find,
    "op3_simhash": simhash.near_duplicates,
    "op4_quality_classifier": quality_classifier.score,
    "op5_bpe": bpe.encode_digests,
    "op6_mixing": mixing.mix,
    "op7_fingerprints": fingerprints.compare,
    "op8_sharding": sharding.shard,
    "op9_licenses": licenses.scan,
    "op10_language_id": language_id.identify,
    "op11_collocations": collocations.collocations,
    "op12_ngram_join": ngram_join.join,
    "op13_periodic_runs": runs.digests,
}


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {name: _over_documents(operator) for name, operator in OPERATORS.items()}


def oracle_sql() -> dict[str, str]:
    """None: over whole tables these operators are models, sketches, or too slow in SQL; tests/llm has brute force."""
    return {}
