"""The queries of this subpackage and their SQL, by name."""

from __future__ import annotations

from collections.abc import Callable
from functools import wraps
from importlib import import_module

from pyspark.sql import DataFrame, SparkSession

from ..shipping import ship_code

#: (query, module); a query's function has its name, and its SQL, if any, is the module's SQL.
MODULES = [
    ("op1_license_scan", "license_scan"),
    ("op2_exact_dedup", "exact_dedup"),
    ("op3_simhash_near_dedup", "simhash"),
    ("op4_token_output", "token_output"),
    ("op5_embedding_near_dedup", "embedding_dedup"),
    ("op6_toxicity", "toxicity"),
    ("op7_url_filter", "url_filter"),
    ("op8_mixing", "mixing"),
    ("op9_sharding", "sharding"),
    ("op10_byte_bpe", "byte_bpe"),
    ("op11_periodic_runs", "periodic_runs"),
    ("op12_piece_bpe", "piece_bpe"),
    ("op13_conversation_trie", "conversation_trie"),
]


def shipped(query: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    """The query, with this package's code sent to the executors first."""

    @wraps(query)
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        ship_code(spark)
        return query(spark, sf_dir)

    return run


def queries() -> dict:
    found = {name: getattr(import_module(f"{__package__}.{module}"), name) for name, module in MODULES}
    return {name: shipped(f) for name, f in found.items()}


def oracle_sql() -> dict[str, str]:
    found = {name: getattr(import_module(f"{__package__}.{module}"), "SQL", None) for name, module in MODULES}
    return {name: sql for name, sql in found.items() if sql}
