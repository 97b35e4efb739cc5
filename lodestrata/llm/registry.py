"""Queries of this folder and their SQL, by name."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from lodestrata.llm import bpe_tree, exact_dedup, license_scan, line_dedup, mixing, nn_descent, packing, prefix_trie, ptolemy_kmeans, quality, secret_scan, simhash_dedup, url_filter

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_nn_descent": nn_descent.op1_nn_descent,
    "op2_pack": packing.op2_pack,
    "op3_license_scan": license_scan.op3_license_scan,
    "op4_exact_dedup": exact_dedup.op4_exact_dedup,
    "op5_simhash_dedup": simhash_dedup.op5_simhash_dedup,
    "op6_secret_scan": secret_scan.op6_secret_scan,
    "op7_url_filter": url_filter.op7_url_filter,
    "op8_quality_classifier": quality.op8_quality_classifier,
    "op9_line_dedup": line_dedup.op9_line_dedup,
    "op10_mix_sources": mixing.op10_mix_sources,
    "op11_ptolemy_kmeans": ptolemy_kmeans.op11_ptolemy_kmeans,
    "op12_bpe_tree": bpe_tree.op12_bpe_tree,
    "op13_prefix_trie": prefix_trie.op13_prefix_trie,
}

ORACLES: dict[str, str] = {
    "op4_exact_dedup": exact_dedup.ORACLE,
    "op7_url_filter": url_filter.ORACLE,
    "op11_ptolemy_kmeans": ptolemy_kmeans.ORACLE,
    "op13_prefix_trie": prefix_trie.ORACLE,
}
