"""Registered queries of the subpackage, and their DuckDB SQL where there is one."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from convprep.llm import centroids, jaccard, language, linecrf, lm, mixing, neardup, packing, pii, quality, sharding, substrings, trie
from convprep.llm.common import load


def op1_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.op1_quality_rules(load(spark, sf_dir, "documents"))


def op2_nn_descent(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neardup.op2_nn_descent(load(spark, sf_dir, "embeddings"))


def op3_super_kmers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substrings.op3_super_kmers(load(spark, sf_dir, "documents"))


def op4_cross_entropy(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lm.op4_cross_entropy(load(spark, sf_dir, "documents"), load(spark, sf_dir, "labels"))


def op5_minhash_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard.op5_minhash_join(load(spark, sf_dir, "documents"))


def op6_pareto_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.op6_pareto_mix(load(spark, sf_dir, "documents"))


def op7_anchor_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.op7_anchor_pii(load(spark, sf_dir, "documents"))


def op8_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.op8_best_fit_packing(load(spark, sf_dir, "documents"))


def op9_virtual_slots(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.op9_virtual_slots(load(spark, sf_dir, "documents"))


def op10_string_kernel(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language.op10_string_kernel(load(spark, sf_dir, "documents"))


def op11_line_crf(spark: SparkSession, sf_dir: str) -> DataFrame:
    return linecrf.op11_line_crf(load(spark, sf_dir, "documents"), load(spark, sf_dir, "labels"))


def op12_walsh_hadamard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return centroids.op12_walsh_hadamard(load(spark, sf_dir, "embeddings"))


def op13_double_array(spark: SparkSession, sf_dir: str) -> DataFrame:
    return trie.op13_double_array(load(spark, sf_dir, "conversations"))


QUERIES = {
    "op1_quality_rules": op1_quality_rules,
    "op2_nn_descent": op2_nn_descent,
    "op3_super_kmers": op3_super_kmers,
    "op4_cross_entropy": op4_cross_entropy,
    "op5_minhash_join": op5_minhash_join,
    "op6_pareto_mix": op6_pareto_mix,
    "op7_anchor_pii": op7_anchor_pii,
    "op8_best_fit_packing": op8_best_fit_packing,
    "op9_virtual_slots": op9_virtual_slots,
    "op10_string_kernel": op10_string_kernel,
    "op11_line_crf": op11_line_crf,
    "op12_walsh_hadamard": op12_walsh_hadamard,
    "op13_double_array": op13_double_array,
}

ORACLE = {
    "op1_quality_rules": quality.ORACLE_OP1,
    "op2_nn_descent": neardup.ORACLE_OP2,
    "op3_super_kmers": substrings.ORACLE_OP3,
    "op6_pareto_mix": mixing.ORACLE_OP6,
    "op12_walsh_hadamard": centroids.ORACLE_OP12,
    "op13_double_array": trie.ORACLE_OP13,
}
