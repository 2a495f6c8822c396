"""Schema changes and backfills as projections."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def add_progress(projects: DataFrame) -> DataFrame:
    """``completion_progress`` with its default 0."""
    return projects.withColumn("completion_progress", F.lit(0).cast("decimal(5,4)"))


def drop_rank(snapshot: DataFrame) -> DataFrame:
    return snapshot.drop("rank_no", "calculated_at")


def backfill_proof_date(proofs: DataFrame) -> DataFrame:
    """Rows from before the column: the day of the upload."""
    return proofs.withColumn("proof_date", F.coalesce("proof_date", F.to_date("created_at")))


def backfill_delta(proofs: DataFrame) -> DataFrame:
    """Rows from before the column: the judged amount was the increase."""
    return proofs.withColumn("progress_delta", F.col("increase"))
