"""Aggregates: Spark combines them partially before each shuffle, so hot groups cost one row per task."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .filters import valid_approved


def checkins(proofs: DataFrame, month_start: Iterable[int], month_end: Iterable[int]) -> DataFrame:
    """Counted proofs per season_user: month-start rows do not count, month-end rows at most once."""
    config = F.col("project_upload_config_id")
    start, end = config.isin(*month_start), config.isin(*month_end)
    total = F.count_if(~start & ~end) + F.least(F.lit(1).cast("long"), F.count_if(end))
    return valid_approved(proofs).groupBy("season_user_id").agg(total.alias("checkin_count")).where("checkin_count > 0")


def progress(proofs: DataFrame) -> DataFrame:
    """Sum of the counted increases per season_user and project."""
    total = F.sum("increase").cast("decimal(5,4)").alias("completion_progress")
    return valid_approved(proofs).groupBy("season_user_id", "project_id").agg(total)


def locked_count(projects: DataFrame) -> DataFrame:
    return projects.groupBy("season_user_id").agg(F.count_if(F.col("status") == 1).alias("locked"))


def balance(points: DataFrame) -> DataFrame:
    return points.where("status = 1").groupBy("user_id").agg(F.sum("change_points").alias("balance"))


def settlement_facts(season_user: DataFrame, projects: DataFrame, proofs: DataFrame) -> DataFrame:
    """Per season_user: locked and completed projects, the least progress, and proofs not finally reviewed."""
    done = projects.where("status = 1").groupBy("season_user_id").agg(
        F.count("*").alias("n_projects"), F.count_if(F.col("completion_progress") >= 1).alias("n_completed"), F.min("completion_progress").alias("min_progress")
    )
    waiting = proofs.where(F.col("status") == 1).groupBy("season_user_id").agg(F.count_if(F.col("review_status").isin("pending", "preliminary_approved")).alias("n_open"))
    base = season_user.select(F.col("id").alias("season_user_id"))
    joined = base.join(done, "season_user_id", "left").join(waiting, "season_user_id", "left")
    return joined.select("season_user_id", *[F.coalesce(c, F.lit(0)).cast("long").alias(c) for c in ("n_projects", "n_completed", "n_open")], "min_progress")


def exchange_stats(points: DataFrame) -> DataFrame:
    used = points.where((F.col("change_type") == "exchange") & (F.col("status") == 1))
    return used.groupBy("product_id").agg(F.count("*").alias("n_exchanges"), (-F.sum("change_points")).alias("points_paid"))


def department_stats(departments: DataFrame, users: DataFrame, points: DataFrame, season_user: DataFrame, projects: DataFrame) -> DataFrame:
    """Per department: users, balance, season users and completed projects; every side is aggregated by user before it is joined."""
    completed = projects.where("status = 1").groupBy("season_user_id").agg(F.count_if(F.col("completion_progress") >= 1).alias("n_completed"))
    entered = season_user.join(completed, F.col("id") == F.col("season_user_id"), "left").groupBy("user_id").agg(
        F.count("*").alias("n_entries"), F.sum(F.coalesce("n_completed", F.lit(0))).alias("n_completed")
    )
    per_user = (
        users.select(F.col("id").alias("user_id"), "department_id").join(balance(points), "user_id", "left").join(entered, "user_id", "left")
        .groupBy("department_id")
        .agg(F.count("*").alias("n_users"), *[F.sum(F.coalesce(c, F.lit(0))).cast("long").alias(c) for c in ("balance", "n_entries", "n_completed")])
    )
    return departments.select(F.col("id").alias("department_id"), "name").join(per_user, "department_id")


def duplicates(frame: DataFrame, keys: Iterable[str]) -> DataFrame:
    """Key values that occur more than once."""
    return frame.groupBy(*keys).agg(F.count("*").alias("n")).where("n > 1")


def duplicate_proofs(proofs: DataFrame) -> DataFrame:
    """Days with more than one valid proof of a season_user and project."""
    return duplicates(proofs.where("status = 1"), ("season_user_id", "project_id", "proof_date"))


def running_seasons(seasons: DataFrame) -> DataFrame:
    """The number of running seasons, if there is more than one."""
    return seasons.agg(F.count_if(F.col("status") == 1).alias("n")).where("n > 1")
