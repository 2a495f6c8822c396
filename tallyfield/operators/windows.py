"""Ordered rules as windows over one season_user and project, or one user: bounded groups, one shuffle on their key."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .filters import counted

GROUP = ("season_user_id", "project_id")
_AMOUNT = "decimal(15,4)"


def _before(amount: Column, order: Sequence[str]) -> Column:
    """Sum of an amount over the earlier rows of the group."""
    earlier = Window.partitionBy(*GROUP).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    return F.coalesce(F.sum(amount).over(earlier), F.lit(0)).cast(_AMOUNT)


def _clamped(amount: Column, room: Column) -> Column:
    return F.greatest(F.lit(0).cast(_AMOUNT), F.least(amount.cast(_AMOUNT), room.cast(_AMOUNT))).cast("decimal(5,4)")


def allocate(proofs: DataFrame, order: Sequence[str] = ("created_at", "id")) -> DataFrame:
    """``increase`` from scratch: each counted proof takes what is left of 1 in the given order, others take nothing."""
    delta = F.when(counted(), F.col("progress_delta")).otherwise(0).cast("decimal(5,4)")
    return proofs.withColumn("increase", F.when(counted(), _clamped(delta, 1 - _before(delta, order))).otherwise(0).cast("decimal(5,4)"))


def allocate_new(proofs: DataFrame, fresh: Column, order: Sequence[str] = ("created_at", "id")) -> DataFrame:
    """Proofs marked ``fresh`` take, in order, what the stored increases leave; stored amounts stay."""
    group = Window.partitionBy(*GROUP)
    used = F.sum(F.when(counted() & ~fresh, F.col("increase")).otherwise(0)).over(group)
    delta = F.when(counted() & fresh, F.col("progress_delta")).otherwise(0).cast("decimal(5,4)")
    return proofs.withColumn("increase", F.when(counted() & fresh, _clamped(delta, 1 - used - _before(delta, order))).otherwise(F.col("increase")).cast("decimal(5,4)"))


def refill(proofs: DataFrame) -> DataFrame:
    """Space freed in a group goes to counted proofs with headroom, by (created_at, id); closed form of the sequential rule."""
    group = Window.partitionBy(*GROUP)
    space = 1 - F.sum(F.when(counted(), F.col("increase")).otherwise(0)).over(group)
    head = F.when(counted(), F.col("progress_delta") - F.col("increase")).otherwise(0).cast("decimal(5,4)")
    more = _clamped(head, space - _before(head, ("created_at", "id")))
    return proofs.withColumn("increase", (F.col("increase") + more).cast("decimal(5,4)"))


def running_balance(points: DataFrame) -> DataFrame:
    """``points_after``: the user's valid changes up to each ledger row, by (created_at, id)."""
    upto = Window.partitionBy("user_id").orderBy("created_at", "id").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return points.withColumn("points_after", F.sum(F.when(F.col("status") == 1, F.col("change_points")).otherwise(0)).over(upto).cast("long"))


def latest_proof(proofs: DataFrame) -> DataFrame:
    """The newest valid proof of each season_user, project and day."""
    newest = F.row_number().over(Window.partitionBy(*GROUP, "proof_date").orderBy(F.desc("created_at"), F.desc("id")))
    return proofs.where("status = 1").withColumn("_n", newest).where("_n = 1").drop("_n")


def with_rank(snapshot: DataFrame, season_key: str | None = None) -> DataFrame:
    """Competition rank by check-ins, without a single-partition sort: ranks come from the counts of each distinct value.

    Distinct counts are bounded by the days of a season, so their window is small however many users there are.
    """
    keys = [season_key] if season_key else []
    values = snapshot.groupBy(*keys, "checkin_count").agg(F.count("*").alias("n"))
    higher = Window.partitionBy(*keys).orderBy(F.desc("checkin_count")).rowsBetween(Window.unboundedPreceding, -1)
    ranks = values.select(*keys, "checkin_count", (F.coalesce(F.sum("n").over(higher), F.lit(0)) + 1).cast("long").alias("rank_no"))
    return snapshot.join(ranks, [*keys, "checkin_count"])
