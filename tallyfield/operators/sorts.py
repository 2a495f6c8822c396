"""Orderings and pages. A page is a top-k: Spark keeps k rows per task and never sorts the whole table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def history(proofs: DataFrame, season_user_id: int) -> DataFrame:
    return proofs.where(F.col("season_user_id") == season_user_id).orderBy(F.desc("created_at"), F.desc("id"))


def upload_configs(configs: DataFrame, project_id: int | None = None) -> DataFrame:
    chosen = configs if project_id is None else configs.where(F.col("project_id") == project_id)
    return chosen.where("status = 1").orderBy("sort_order", "id")


def levels(frame: DataFrame) -> DataFrame:
    return frame.where("status = 1").orderBy("reward", "id")


def ledger(points: DataFrame, user_id: str) -> DataFrame:
    return points.where(F.col("user_id") == user_id).orderBy("created_at", "id")


def leaderboard(view: DataFrame) -> DataFrame:
    return view.orderBy(F.desc("checkin_count"), "season_user_id")


def suggestions_by_user(feedback: DataFrame) -> DataFrame:
    return feedback.orderBy("user_id", "created_at", "id")


def suggestions_by_time(feedback: DataFrame) -> DataFrame:
    return feedback.where("is_visible = 1").orderBy("created_at", "id")


def products(frame: DataFrame) -> DataFrame:
    return frame.where("status = 1").orderBy("points_required", "id")


def page(frame: DataFrame, key: str, size: int, after: int | None = None, descending: bool = False) -> DataFrame:
    """The next ``size`` rows by a unique key, after the last one seen."""
    column = F.col(key)
    rest = frame if after is None else frame.where(column < after if descending else column > after)
    return rest.orderBy(column.desc() if descending else column.asc()).limit(size)
