"""Equi-joins on foreign keys. Spark picks the strategy from sizes; nothing that grows is hinted to be broadcast."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .filters import counted


def leaderboard_view(snapshot: DataFrame, season_user: DataFrame, users: DataFrame, departments: DataFrame, levels: DataFrame) -> DataFrame:
    """The snapshot with names; the level may be missing."""
    entry = season_user.select(F.col("id").alias("season_user_id"), "user_id", "level_id")
    user = users.select(F.col("id").alias("user_id"), F.col("name").alias("user_name"), "department_id")
    department = departments.select(F.col("id").alias("department_id"), F.col("name").alias("department_name"))
    level = levels.select(F.col("id").alias("level_id"), F.col("name").alias("level_name"))
    joined = snapshot.join(entry, "season_user_id").join(user, "user_id").join(department, "department_id").join(level, "level_id", "left")
    return joined.select("season_user_id", "user_name", "department_name", "level_name", "checkin_count")


def with_season(proofs: DataFrame, season_user: DataFrame, season: DataFrame) -> DataFrame:
    """Proofs with their season's bounds."""
    entry = season_user.select(F.col("id").alias("season_user_id"), "season_id", "user_id")
    bounds = season.select(F.col("id").alias("season_id"), "start_date", "end_date")
    return proofs.join(entry, "season_user_id").join(bounds, "season_id")


def locked_only(proofs: DataFrame, projects: DataFrame) -> DataFrame:
    """Proofs whose project the season_user has validly locked."""
    return proofs.join(projects.where("status = 1"), ["season_user_id", "project_id"], "left_semi")


def with_config(proofs: DataFrame, configs: DataFrame) -> DataFrame:
    """Proofs with their upload configuration: same id, same project, enabled."""
    fit = configs.where("status = 1").select(F.col("id").alias("project_upload_config_id"), "project_id", "record_type", "sort_order")
    return proofs.join(fit, ["project_upload_config_id", "project_id"])


def with_rule(projects: DataFrame, season_user: DataFrame, rules: DataFrame) -> DataFrame:
    """Locked projects with the enabled rule of the season_user's level."""
    entry = season_user.select(F.col("id").alias("season_user_id"), "level_id")
    rule = rules.where("status = 1").select(F.col("id").alias("rule_id"), "project_id", "level_id", "rule_content")
    return projects.join(entry, "season_user_id").join(rule, ["project_id", "level_id"])


def weight_pairs(proofs: DataFrame, month_start: Iterable[int], month_end: Iterable[int]) -> DataFrame:
    """Month-end proofs with the earliest valid month-start proof, by (proof_date, id), of the same season_user and project."""
    valid = proofs.where("status = 1")
    start = valid.where(F.col("project_upload_config_id").isin(*month_start)).groupBy("season_user_id", "project_id").agg(F.min(F.struct("proof_date", "id")).alias("first"))
    end = valid.where(F.col("project_upload_config_id").isin(*month_end)).select(F.col("id").alias("end_id"), "season_user_id", "project_id", F.col("proof_date").alias("end_date"))
    return end.join(start, ["season_user_id", "project_id"]).select("season_user_id", "project_id", "end_id", "end_date", F.col("first.id").alias("start_id"), F.col("first.proof_date").alias("start_date"))


def write_back(proofs: DataFrame, results: DataFrame) -> DataFrame:
    """Model results (id, created_at, verdict, delta, comment) beside the pending proofs whose version they were made for."""
    return proofs.where("status = 1 AND review_status = 'pending'").join(results, ["id", "created_at"])


def exchanges(points: DataFrame, products: DataFrame) -> DataFrame:
    """Exchange rows with their product's name and today's price; what was paid is in the row."""
    product = products.select(F.col("id").alias("product_id"), F.col("name").alias("product_name"), "points_required")
    paid = points.where("change_type = 'exchange'").select("id", "user_id", "product_id", (-F.col("change_points")).alias("points_paid"), "status")
    return paid.join(product, "product_id", "left")


def suggestions(feedback: DataFrame, users: DataFrame) -> DataFrame:
    """Feedback with its author; ids are compared without regard to case and accents."""
    author = users.select(F.col("id").alias("author_id"), F.col("name").alias("user_name"))
    return feedback.join(author, F.collate("user_id", "UNICODE_CI_AI") == F.collate("author_id", "UNICODE_CI_AI")).drop("author_id")


def with_department(users: DataFrame, departments: DataFrame) -> DataFrame:
    department = departments.select(F.col("id").alias("department_id"), F.col("name").alias("department_name"))
    return users.join(department, "department_id")


def orphans(child: DataFrame, parent: DataFrame, column: str) -> DataFrame:
    """Child rows whose key has no parent; a null key is no orphan."""
    keys = parent.select(F.col("id").alias(column))
    return child.where(F.col(column).isNotNull()).join(keys, column, "left_anti")


def counted_only(proofs: DataFrame) -> DataFrame:
    return proofs.where(counted())
