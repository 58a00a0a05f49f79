"""The corpus pipeline: each stage takes the documents that its predecessor kept and returns what it keeps."""

from __future__ import annotations

from collections.abc import Callable
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

from tidemark.llm import decontaminate, neardup, packing, quality, repeats
from tidemark.llm.common import read, release, small_batches, tables_made, written
from tidemark.llm.queries import tokenizer_path

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality rules reject go."""
    with small_batches(spark):
        return quality.passing(docs, read(spark, sf_dir, "labels"))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of the documents that links of a Jaccard similarity of 0.8 or more join, the one of the least doc_id stays."""
    with small_batches(spark):
        return neardup.without_near_duplicates(docs, 80)


def suffix_array(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Bytes in strings of 240 (about 40 words) that also start elsewhere go, and with them documents of nothing else."""
    with small_batches(spark):
        return repeats.without_repeats(docs, 240)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a copy of a test item, edited or not, go."""
    with small_batches(spark):
        return decontaminate.without_contaminated(docs, read(spark, sf_dir, "benchmark"))


def best_fit_packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The kept documents, tokenized, cut and packed: a row for each piece."""
    with small_batches(spark):
        return packing.pack(docs, Path(tokenizer_path()).read_bytes(), 4096, 1)


STAGES: list[tuple[str, Stage]] = [
    ("quality_rules", quality_rules),
    ("near_duplicates", near_duplicates),
    ("suffix_array", suffix_array),
    ("decontamination", decontamination),
    ("best_fit_packing", best_fit_packing),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents of ``sf_dir``; what a stage keeps is written, and read again by the next."""
    docs, before = read(spark, sf_dir, "documents"), []
    for i, (name, stage) in enumerate(STAGES):
        if i + 1 == len(STAGES):
            return stage(spark, docs, sf_dir)
        with tables_made() as made:
            docs = written(stage(spark, docs, sf_dir), name)
        release(*before, *made[:-1])  # the last one made is what the stage keeps
        before = [docs]
    return docs


#: Learned cutoffs, tokenization and alignment are beyond SQL; tests/llm holds every stage against a brute-force version.
ORACLE_SQL = None
