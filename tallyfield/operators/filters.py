"""Predicates as DataFrame filters, and labels as projections. All are narrow: they reach the scan."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..schema import COUNTED


def enabled(frame: DataFrame) -> DataFrame:
    return frame.where(F.col("status") == 1)


#: Products that users see are the enabled ones.
on_shelf = enabled
#: One season runs at a time; the audit of single seasons checks that.
current_season = enabled


def visible(suggestions: DataFrame) -> DataFrame:
    return suggestions.where(F.col("is_visible") == 1)


def counted(prefix: str = "") -> Column:
    """Valid and approved, preliminarily or finally: the predicate that progress, refill and leaderboard share."""
    return (F.col(f"{prefix}status") == 1) & F.col(f"{prefix}review_status").isin(*COUNTED)


def valid_approved(proofs: DataFrame) -> DataFrame:
    return proofs.where(counted())


def date_ok(proofs_with_season: DataFrame, as_of: str) -> DataFrame:
    """Proofs dated inside their season and not after ``as_of``."""
    last = F.least(F.col("end_date"), F.lit(as_of).cast("date"))
    return proofs_with_season.where(F.col("proof_date").between(F.col("start_date"), last))


def _season_facts(season_user: DataFrame, season: DataFrame) -> DataFrame:
    facts = season.select(F.col("id").alias("season_id"), "required_project_count")
    return season_user.join(facts, "season_id")


def participants(season_user: DataFrame, season: DataFrame) -> DataFrame:
    """Formal participants: the required number locked, a level, and a time of entry."""
    joined = _season_facts(season_user, season)
    return joined.where((F.col("status") == F.col("required_project_count")) & F.col("level_id").isNotNull() & F.col("participated_at").isNotNull())


def legacy_participants(season_user: DataFrame, season: DataFrame) -> DataFrame:
    """Rows with a level but no time of entry, reported apart from formal participants."""
    joined = _season_facts(season_user, season)
    return joined.where((F.col("status") == F.col("required_project_count")) & F.col("level_id").isNotNull() & F.col("participated_at").isNull())


def unsettled(season_user: DataFrame) -> DataFrame:
    return season_user.where(F.col("final_points").isNull())


def eligible(season_user: DataFrame, season: DataFrame) -> DataFrame:
    """Unsettled rows with at least the required number of locked projects."""
    return unsettled(_season_facts(season_user, season)).where(F.col("status") >= F.col("required_project_count"))


def settlement_due(season_user: DataFrame, season: DataFrame, as_of: str) -> DataFrame:
    """Unsettled formal participants of seasons that have ended by their status and their last day."""
    over = season.where((F.col("status") == 2) & (F.col("end_date") < F.lit(as_of).cast("date")))
    return unsettled(participants(season_user, over))


def pending_due(proofs: DataFrame, as_of: str, wait: str) -> DataFrame:
    """Valid pending proofs that have waited at least ``wait`` (an interval such as '2 HOURS')."""
    since = F.lit(as_of).cast("timestamp_ntz") - F.expr(f"INTERVAL {wait}")
    return proofs.where((F.col("status") == 1) & (F.col("review_status") == "pending") & (F.col("created_at") <= since))


def headroom(proofs: DataFrame) -> DataFrame:
    """Counted proofs whose judged amount was not used up."""
    return valid_approved(proofs).where(F.col("progress_delta") > F.col("increase"))


def locked_label(season_user: DataFrame, season: DataFrame) -> DataFrame:
    joined = _season_facts(season_user, season)
    return joined.select("id", F.format_string("locked %d / %d", F.col("status").cast("int"), F.col("required_project_count").cast("int")).alias("label"))


def settlement_state(points: Column) -> Column:
    return F.when(points.isNull(), "unsettled").when(points == 0, "settled without reward").otherwise("settled with reward")


def review_label(status: Column) -> Column:
    names = {
        "pending": "waiting for review", "preliminary_approved": "approved, final review open", "preliminary_rejected": "rejected by preliminary review",
        "approved": "approved", "rejected": "rejected",
    }
    labels = F.create_map(*[F.lit(x) for pair in names.items() for x in pair])
    return labels[status]
