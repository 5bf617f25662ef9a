"""The corpus operators' queries, and DuckDB SQL for those that SQL expresses."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from ..session import ship
from . import sql
from .langid import op13_langid
from .lines import op8_lines
from .lm import op4_lm
from .merkle import op9_fingerprints
from .negatives import op12_negatives
from .packing import op10_packing
from .pii import op6_pii
from .quality import op3_quality
from .runs import op11_runs
from .sentencepiece import op5_sentencepiece
from .sharding import op7_sharding
from .simhash import op2_simhash
from .toxicity import op1_toxicity

def _shipped(query: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    """The query, after the package has been sent to the Python workers."""

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        ship(spark)
        return query(spark, sf_dir)

    return run


_QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_toxicity": op1_toxicity,
    "op2_simhash": op2_simhash,
    "op3_quality": op3_quality,
    "op4_lm": op4_lm,
    "op5_sentencepiece": op5_sentencepiece,
    "op6_pii": op6_pii,
    "op7_sharding": op7_sharding,
    "op8_lines": op8_lines,
    "op9_fingerprints": op9_fingerprints,
    "op10_packing": op10_packing,
    "op11_runs": op11_runs,
    "op12_negatives": op12_negatives,
    "op13_langid": op13_langid,
}
QUERIES = {name: _shipped(query) for name, query in _QUERIES.items()}
ORACLE_SQL: dict[str, str] = {
    "op3_quality": sql.OP3_QUALITY,
    "op7_sharding": sql.OP7_SHARDING,
    "op12_negatives": sql.OP12_NEGATIVES,
}
