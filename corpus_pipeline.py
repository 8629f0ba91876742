"""The corpus pipeline: quality, near duplicates, repeated passages, decontamination, packing.

Each stage takes (spark, docs, sf_dir) and returns a table that is written as Parquet and read
again as the next one's docs. All but the last return the columns of `documents`.

Defined results: rows with a null id stay where a decision needs no id (quality, decontamination,
packing) and are never duplicates of anything; null and empty texts go in the first stage; rows
that share an id are judged one by one, except that they form one near-duplicate node, of which
the rows of the smallest id stay, one of each text, each with passages of its own; further columns,
whatever their names, are carried along; empty tables stay empty.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from newsfunnel.llm.op1_ngram_join import jaccard_components
from newsfunnel.llm.op2_decontaminate import find_contamination
from newsfunnel.llm.op4_quality_classifier import classify
from newsfunnel.llm.op9_substring import passage_spans, repeated_passages, without_copies
from newsfunnel.llm.op10_packing import pack_documents
from newsfunnel.llm.textkit import broadcast_if_small, stage, table

#: SQL cannot train a classifier, chain fuzzy passages or tokenise: the run is tested stage by
#: stage against brute force instead.
ORACLE_SQL = None


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the weak-label classifier keeps."""
    rows = docs.select(F.struct(*docs.columns).alias("doc"))
    judged = classify(rows, table(spark, sf_dir, "labels"), id_col="doc.doc_id", text_col="doc.text")
    return judged.filter("keep").select("doc.*")


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near duplicates the document with the smallest id, and of rows that repeat
    id and text one."""
    parts = stage(jaccard_components(docs).select("doc_id", "component_id"), "parts")
    # A null id joins nothing, so such rows stay.
    later = stage(parts.filter("component_id < doc_id").select("doc_id").distinct(), "later")
    kept = docs.join(broadcast_if_small(later), "doc_id", "left_anti").select(*docs.columns)
    repeated = stage(parts.filter("doc_id is not null").groupBy("doc_id").count().filter("count > 1").select("doc_id"), "repeated")
    if repeated.isEmpty():
        return kept
    again = kept.join(repeated, "doc_id", "left_semi").select(
        F.struct(*docs.columns).alias("doc"), "doc_id", F.md5(F.coalesce("text", F.lit(""))).alias("same"))
    return kept.join(repeated, "doc_id", "left_anti").select(*docs.columns).unionByName(
        again.dropDuplicates(["doc_id", "same"]).select("doc.*"))


def passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the passages that a document with a smaller id has too."""
    spans = stage(passage_spans(repeated_passages(docs)), "spans")
    return without_copies(docs, spans)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without any window of a benchmark item."""
    rows = docs.select(F.struct(*docs.columns).alias("doc"), "text")
    found = find_contamination(rows, table(spark, sf_dir, "benchmark"), carry=("doc",))
    return found.filter("n_hit = 0").select("doc.*")


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token sequences: one row per piece of a document."""
    return pack_documents(docs)


STAGES = [
    ("quality", quality),
    ("near_duplicates", near_duplicates),
    ("passages", passages),
    ("decontamination", decontamination),
    ("packing", packing),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, step in STAGES:
        docs = stage(step(spark, docs, sf_dir), f"pipeline-{name}")
    return docs
