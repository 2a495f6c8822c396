"""A training corpus from documents: quality, near-duplicates, decontamination, personal data, packing.

Each stage gets what its predecessor kept, read again from Parquet, and all but the last return the
columns of ``documents``, whatever their names; columns beside ``doc_id`` and ``text`` are carried along
(``n_chars`` follows the text).

Defined results: null and empty texts are documents like others (the classifier may reject them, no stage
else does, and they are packed as the closing id); a null id is an id that no label fits; of rows that
repeat id and text one stays, of other ties the smallest id; very long texts are read whole; without labels
of both classes nothing is rejected, without benchmark items nothing is contaminated, and empty documents
give an empty result.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyfield.llm import common, decontaminate, near_duplicates, packing, passage_quality, sanitise
from tallyfield.llm.queries import tokenizer_path

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the passage classifier does not reject; of rows that are alike all or none."""
    return passage_quality.good(docs, common.table(spark, sf_dir, "labels"))


def near_duplicate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group that shares five-word shingles to 80 percent, that of the smallest id; texts without words are no group."""
    return near_duplicates.deduplicate(docs, size=5, percent=80)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without any ten-word window of a benchmark item; a null or empty text has none."""
    return decontaminate.clean(docs, common.table(spark, sf_dir, "benchmark"))


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents with personal data, and the terms that reveal it, replaced; no row goes, a null text stays null."""
    clean = sanitise.sanitise(docs)
    return clean.withColumn("n_chars", F.length("text").cast("long")) if "n_chars" in docs.columns else clean


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of token sequences with their places; a null or empty text is one piece of one token."""
    return packing.pack(docs, tokenizer_path("byte_bpe_50k.json"))


STAGES: list[tuple[str, Stage]] = [
    ("quality", quality),
    ("near_duplicates", near_duplicate),
    ("decontamination", decontamination),
    ("personal_data", personal_data),
    ("packing", pack),
]

#: No SQL expresses a learned classifier or a tokenizer; the stages are tested against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents."""
    docs = common.table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = common.written(stage(spark, docs, sf_dir), f"stage-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
