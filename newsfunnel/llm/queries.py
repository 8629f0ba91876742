"""Queries of the training-data operators and, where SQL can state them, their DuckDB SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from newsfunnel.llm import op1_ngram_join as op1, op2_decontaminate as op2, op3_url_filter as op3
from newsfunnel.llm.op4_quality_classifier import op4_quality_classifier
from newsfunnel.llm.op5_quality_rules import op5_quality_rules
from newsfunnel.llm.op6_language import op6_language
from newsfunnel.llm.op7_warc import op7_warc
from newsfunnel.llm.op8_html_text import op8_html_text
from newsfunnel.llm.op9_substring import op9_substring
from newsfunnel.llm.op10_packing import op10_packing
from newsfunnel.llm import op11_sharding as op11, op12_phrases as op12, op13_search as op13

_QUERIES = [
    op1.op1_ngram_join, op2.op2_decontaminate, op3.op3_url_filter, op4_quality_classifier,
    op5_quality_rules, op6_language, op7_warc, op8_html_text, op9_substring, op10_packing,
    op11.op11_sharding, op12.op12_phrases, op13.op13_search,
]
_ORACLES: dict[str, str] = {
    "op1_ngram_join": op1.SQL, "op2_decontaminate": op2.SQL, "op3_url_filter": op3.SQL,
    "op11_sharding": op11.SQL, "op12_phrases": op12.SQL, "op13_search": op13.SQL,
}


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The five stages of corpus_pipeline.py over all documents."""
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {fn.__name__: fn for fn in [*_QUERIES, pipeline]}


def oracle_sql() -> dict[str, str]:
    return dict(_ORACLES)
