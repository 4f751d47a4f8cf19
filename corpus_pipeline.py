"""Corpus pipeline: quality rules, line dedup, near-dedup, benchmark decontamination and packing, in that order.

Each stage takes (spark, docs, sf_dir) and works on all rows that its predecessor kept; all but the last return
the columns of documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vecspan.llm import decontaminate, line_dedup, packing, quality_rules, simhash
from vecspan.llm.common import Stash, table


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rejected documents go."""
    return quality_rules.keep_quality(docs)


def line_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Boilerplate lines go from texts; documents stay, with n_chars counted anew."""
    out = line_dedup.keep_lines(docs)
    return out.withColumn("n_chars", F.length("text").cast("long")) if "n_chars" in docs.columns else out


def near_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies stays, the one with the smallest doc_id. Candidates come from the fingerprints and
    the bit-sliced comparison of operator 9; shingles verify them, and find what fingerprints leave apart."""
    return simhash.keep_first(docs)


def benchmark_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark item go."""
    return decontaminate.decontaminate(docs, table(spark, sf_dir, "benchmark"))


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """What is left, as pieces in sequences, with their token ids (little-endian unsigned 32-bit numbers)."""
    return packing.pack_documents(docs, keep_ids=True)


STAGES = [
    ("quality rules", quality_stage),
    ("line dedup", line_stage),
    ("near dedup", near_stage),
    ("benchmark decontamination", benchmark_stage),
    ("best-fit packing", packing_stage),
]

#: Compression ratios, fingerprints and token ids are not SQL; tests/llm holds the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents, each one's rows written to shared storage before the next; a stage's own tables go then."""
    stash = Stash(spark)
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        mark = Stash.mark()
        docs = stash.cut(stage(spark, docs, sf_dir), name.replace(" ", "-"))
        Stash.drop_since(mark)
    return STAGES[-1][1](spark, docs, sf_dir)
