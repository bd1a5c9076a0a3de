"""The corpus pipeline: from ``documents`` to packed training sequences, in five stages.

Each stage reads what the stage before has written. All but the last return the columns of ``documents``.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rowtrail.llm.decontaminate import decontaminate
from rowtrail.llm.lines import line_duplicates
from rowtrail.llm.minhash import near_duplicates
from rowtrail.llm.packing import pack
from rowtrail.llm.quality import classify
from rowtrail.llm.shared import Scratch, table, with_ids

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier of weak labels takes for good; junk and toxic ones go, and so do those without words."""
    return classify(docs, table(spark, sf_dir, "labels")).filter("kept").select(*docs.columns)


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Repeated runs of lines go but for their first copy. A document that loses all its lines goes; ``n_chars`` follows the text."""
    cut = line_duplicates(docs).filter("n_removed < n_lines")
    kept = cut.withColumn("n_chars", F.when(F.col("n_removed") > 0, F.length("text")).otherwise(F.col("n_chars")).cast("long"))
    return kept.select(*docs.columns)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near-duplicates (five-word shingles, similarity 0.8) the document with the smallest doc_id stays."""
    found = near_duplicates(docs, shingle_words=5)
    gone = Scratch(spark, "copies").write(found.filter("NOT kept").select("doc_id").distinct(), "gone")
    return with_ids(docs, gone, "doc_id", "left_anti").select(*docs.columns)


def benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with passages of the benchmark go."""
    return decontaminate(docs, table(spark, sf_dir, "benchmark")).filter("kept").select(*docs.columns)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents that are left, packed into sequences of 2,048 tokens."""
    return pack(docs)


STAGES: list[tuple[str, Stage]] = [
    ("quality_classifier", quality),
    ("line_dedup", lines),
    ("minhash_near_dedup", near_dedup),
    ("benchmark_decontamination", benchmark),
    ("best_fit_packing", packing),
]

ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Applies the stages to ``documents``; each reads what the one before has written to the shared folder."""
    scratch = Scratch(spark, "pipeline")
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = scratch.write(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
