"""The registered queries of this subpackage and their DuckDB SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from retentio.llm import (op1_licenses, op2_syncmers, op3_jaccard, op4_topk, op5_mixing, op6_urls, op7_language, op8_toxicity,
                          op9_packing, op10_warc, op11_trie, op12_vectors, op13_divergence)


def _t(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_licenses": lambda s, d: op1_licenses.op1_query(_t(s, d, "documents")),
    "op2_syncmers": lambda s, d: op2_syncmers.op2_query(_t(s, d, "documents")),
    "op3_jaccard": lambda s, d: op3_jaccard.op3_query(_t(s, d, "documents")),
    "op4_topk": lambda s, d: op4_topk.op4_query(_t(s, d, "embeddings")),
    "op5_mixing": lambda s, d: op5_mixing.op5_query(_t(s, d, "documents"), _t(s, d, "labels")),
    "op6_urls": lambda s, d: op6_urls.op6_query(s, _t(s, d, "pages")),
    "op7_language": lambda s, d: op7_language.op7_query(_t(s, d, "documents")),
    "op8_toxicity": lambda s, d: op8_toxicity.op8_query(_t(s, d, "documents"), _t(s, d, "labels")),
    "op9_packing": lambda s, d: op9_packing.op9_query(_t(s, d, "documents")),
    "op10_warc": lambda s, d: op10_warc.op10_query(_t(s, d, "pages")),
    "op11_trie": lambda s, d: op11_trie.op11_query(_t(s, d, "conversations")),
    "op12_vectors": lambda s, d: op12_vectors.op12_query(_t(s, d, "embeddings")),
    "op13_divergence": lambda s, d: op13_divergence.op13_query(_t(s, d, "documents")),
}

ORACLE: dict[str, str] = {
    "op3_jaccard": op3_jaccard.ORACLE_SQL,
    "op4_topk": op4_topk.ORACLE_SQL,
    "op11_trie": op11_trie.ORACLE_SQL,
    "op12_vectors": op12_vectors.ORACLE_SQL,
    "op13_divergence": op13_divergence.ORACLE_SQL,
}
