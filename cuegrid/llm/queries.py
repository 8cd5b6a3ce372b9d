"""The queries of this package and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from cuegrid.llm.centroids import OP12_SQL, op12_centroids
from cuegrid.llm.decontaminate import op2_decontamination
from cuegrid.llm.importance import OP11_SQL, op11_importance
from cuegrid.llm.language_model import op6_language_model
from cuegrid.llm.licenses import op10_licenses
from cuegrid.llm.mixing import op8_mixing
from cuegrid.llm.ngram_join import OP1_SQL, op1_ngram_join
from cuegrid.llm.packing import op13_packing
from cuegrid.llm.quality_classifier import op5_quality_classifier
from cuegrid.llm.quality_rules import op4_quality_rules
from cuegrid.llm.token_counts import op7_token_counts
from cuegrid.llm.toxicity import op9_toxicity
from cuegrid.llm.url_filter import OP3_SQL, op3_url_filter

QUERIES = [
    op1_ngram_join,
    op2_decontamination,
    op3_url_filter,
    op4_quality_rules,
    op5_quality_classifier,
    op6_language_model,
    op7_token_counts,
    op8_mixing,
    op9_toxicity,
    op10_licenses,
    op11_importance,
    op12_centroids,
    op13_packing,
]


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in QUERIES}


def oracle_sql() -> dict[str, str]:
    return {"op1_ngram_join": OP1_SQL, "op3_url_filter": OP3_SQL, "op11_importance": OP11_SQL, "op12_centroids": OP12_SQL}
