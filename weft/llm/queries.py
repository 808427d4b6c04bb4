"""The registered queries of the corpus operators, and SQL for those that SQL can express."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from . import decontaminate, licenses, manifest, ranking, rules
from ._common import table


def op8_interleave(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .sharding import interleave

    return interleave(table(spark, sf_dir, "documents"))


def op1_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op2_pii_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .pii import find_spans

    return find_spans(table(spark, sf_dir, "documents"))


def op3_bloom_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .lm import score

    return score(table(spark, sf_dir, "documents"))


def op4_license_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scan(table(spark, sf_dir, "documents"))


def op5_simhash_classes(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .simhash import as_hex, near_duplicates

    found = near_duplicates(table(spark, sf_dir, "documents"))
    return found.select("doc_id", as_hex("fp").alias("fingerprint"), "component_id")


def op6_pack(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .packing import pack

    return pack(table(spark, sf_dir, "documents"))


def op7_hilbert_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .neighbours import nearest

    return nearest(table(spark, sf_dir, "embeddings"), lambda vec_id: vec_id % 100 == 0)


def op9_line_crf_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .quality import classify

    return classify(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op10_shared_passages(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .passages import passages

    return passages(table(spark, sf_dir, "documents"))


def op11_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return manifest.without_line_ends(table(spark, sf_dir, "documents"))


def op12_ranked_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ranking.search(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op13_weak_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rules.judged(table(spark, sf_dir, "documents"))


QUERIES = {
    "op1_decontaminate": op1_decontaminate,
    "op2_pii_spans": op2_pii_spans,
    "op3_bloom_lm": op3_bloom_lm,
    "op4_license_join": op4_license_join,
    "op5_simhash_classes": op5_simhash_classes,
    "op6_pack": op6_pack,
    "op7_hilbert_neighbours": op7_hilbert_neighbours,
    "op9_line_crf_quality": op9_line_crf_quality,
    "op8_interleave": op8_interleave,
    "op10_shared_passages": op10_shared_passages,
    "op11_merkle_manifest": op11_merkle_manifest,
    "op12_ranked_search": op12_ranked_search,
    "op13_weak_rules": op13_weak_rules,
}

#: The other methods are beyond SQL (hash functions, trained models, tokens, approximate search); tests/llm has brute force for them.
ORACLES: dict[str, str] = {
    "op1_decontaminate": decontaminate.ORACLE,
    "op4_license_join": licenses.oracle(),
    "op11_merkle_manifest": manifest.ORACLE,
    "op12_ranked_search": ranking.ORACLE,
    "op13_weak_rules": rules.oracle(),
}
